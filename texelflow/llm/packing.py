"""Packing along a space-filling curve.

1. Each document is encoded once, by the tokenizer file; its hashed token vector is projected to DIMS dimensions, which give a
   Hilbert key. Ids, key and length go to a written table, two bytes an id where the vocabulary allows it.
2. Only (key, id, row, length) are range-sorted. Equal keys are told apart by id and row, so a large group of
   equal documents is split over ranges. Each range adds up its lengths; the ranges' totals (one row a range)
   give every document its place in the one stream of ids along the curve.
3. The stream is cut at every multiple of the sequence length; a document's pieces follow from its place.
   Only the last sequence may need padding.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; null ids are kept
and sort first; ties on the curve go by id, then by row; a text of any length is encoded whole; extra columns
aren't read, so they may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, text_of

DIMS, BITS = 4, 12
#: Documents of a range of the curve, about: there are more ranges than the session's partitions if need be.
RANGE_ROWS = 1_000_000
#: Tokens fall into so many hashed features before the projection.
FEATURES = 1 << 14


def _bytes_of_letters() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes, in order, for 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in seen}
    return out | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(seen)))}


class FileTokenizer:
    """Ids that the tokenizers library gives by one of its files, without adding special tokens.

    Where the ids of the file are the ranks of its merges and its parts are those of plain byte-level BPE, which is
    checked, a faster engine encodes with the file's vocabulary and special tokens; the ids are the same. Otherwise
    the library encodes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:  # an installed file of each executor's Python, not a data table
            said = json.load(f)
        letters = _bytes_of_letters()
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.size = 1 + max([*said["model"]["vocab"].values(), *added.values()])
        self.engine = self.whole = None  # one of them is loaded
        if self._plain(said, letters):
            ranks = {bytes(map(letters.__getitem__, k)): v for k, v in said["model"]["vocab"].items() if k not in added}
            self.engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        else:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(path)

    @staticmethod
    def _plain(said: dict, letters: dict[str, int]) -> bool:
        model, split = said["model"], said["pre_tokenizer"] or {}
        vocab, added = model["vocab"], {t["content"] for t in said["added_tokens"]}
        if model["type"] != "BPE" or said["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return False
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            return False
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(m, -1) for m in made]
        singles = [vocab.get(c, 1 << 40) for c in letters]
        return ids == sorted(ids) and max(singles) < min(ids, default=1 << 41) and set(vocab) - added == set(made) | set(letters)

    def encode(self, text: str) -> np.ndarray:
        if self.engine is not None:
            return self.engine.encode_to_numpy(text, allowed_special="all")
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def _loaded(path: str, pattern: str) -> FileTokenizer:
    return FileTokenizer(path, pattern)


def tokenizer(name: str) -> FileTokenizer:
    import public_tokenizers  # installed with each Python

    return _loaded(public_tokenizers.path(name), public_tokenizers.PATTERN)


@functools.cache
def projection(vocabulary: int) -> np.ndarray:
    """Row of token t: the +-1 projections of its hashed feature."""
    feature = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FEATURES)
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), size=(FEATURES, DIMS))
    return signs[feature.astype(np.int64)]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows, dimensions) below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[:, i] & q) != 0
            t = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(flip, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _wide(of: FileTokenizer) -> str:
    return "<u2" if of.size <= 1 << 16 else "<u4"


def _encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(vocabulary)
        project, wide = projection(of.size), _wide(of)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            mean = np.zeros((batch.num_rows, DIMS))
            kept, n = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(of.encode(text.as_py() or ""), np.uint32(end_id))
                mean[k] = project.take(ids, 0).sum(0) / len(ids)
                kept.append(ids.astype(wide).tobytes())
                n.append(len(ids))
            cells = ((np.tanh(mean * 3) * 0.5 + 0.5) * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n)), pa.int64()), batch.column(0), pa.array(hilbert_keys(cells), pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], ["row", "id", "curve", "n", "ids"])
            row += len(n)

    return arrow_map(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), run, f"row bigint, id {kind}, curve bigint, n bigint, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = at + np.cumsum(n)
        at = int(ends[-1]) if len(n) else at
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), batch.column(0), pa.array(n), pa.array(ends - n)], ["part", "row", "n", "before"])


def pack(docs: DataFrame, length: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) its ids."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark, "packing")
    coded = scratch.save(_encoded(docs, vocabulary, end_id, id_col, text_col, kind), "encoded")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-coded.count() // RANGE_ROWS))
    by = ["curve", "id", "row"]
    light = coded.select(*by, "n").repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("row", "n")
    placed = scratch.save(arrow_map(light, _running, "part int, row bigint, n bigint, before bigint"), "placed")
    starts, total = [], 0
    for part, n in sorted(placed.groupBy("part").agg(F.sum("n")).collect()):  # one row a range
        starts.append((part, total))
        total += n
    bases = spark.createDataFrame(starts, "part int, base bigint")
    scratch.keep("encoded", "placed")
    placed = placed.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("before")).alias("at"))
    wide = _wide(tokenizer(vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for k, (at, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), wide).astype("<u4")
                begin = 0
                while begin < len(ids):
                    end = min(len(ids), begin + length - (at + begin) % length)
                    part = ids[begin:end].tobytes()
                    for column, value in zip(rows, (k, begin, end - begin, zlib.crc32(part), len(ids), (at + begin) // length, (at + begin) % length, part), strict=True):
                        column.append(value)
                    begin = end
            arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:7])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[7]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    joined = coded.select("row", "id", "ids").join(placed, "row").select("id", "at", "ids")
    out = arrow_map(joined, cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (array): the pieces put together. Sequences whose length isn't a power of two are padded."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # at most `length` pieces
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(length) - n)
    return whole.select("sequence_id", ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
