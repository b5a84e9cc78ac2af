"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every byte that a string of `window` bytes covers goes, if the string also starts anywhere else. Sorting all
suffixes would take many times the input on disk, so suffixes are taken at content-defined anchors only: equal
windows have the same anchor, so nothing is lost (see anchors.py).

1. Rule out: anchors whose gram is unique in the corpus can't be in a repeat. Which aren't is kept in a bitmap of
   fixed size (2**FOLD_BITS bits); folding only lets some unique ones pass. Grams with at least 1 / 2**COMMON_BITS
   of all anchors (so there are at most 2**COMMON_BITS) come last as anchors, so that windows that hold such a
   gram meet at their rarer ones.
2. Sort: tasks sort runs of suffixes at the other anchors. A suffix is its right context up to the end of the
   anchor's last window, then its left context. Equal suffixes of a run are neighbours: their windows all repeat,
   and one goes on for all. A run is front-coded and cut by ranges of the gram's hash, in as many ranges as the
   number of suffixes asks for.
3. Merge: each range merges its runs with a loser tree that passes on known common prefixes. Suffixes that agree
   to depth d are neighbours; in such a cluster the longest common left context L of any two is found by sorting
   the left contexts. If L + d reaches the window, these bytes are covered. Equal suffixes are one member of a
   cluster, so a hot string is as many members as there are different contexts of it.

Only compared bytes decide; hashes rule out and place.

Defined results: null text is empty; repeated rows are copies of each other; texts shorter than the window stay
whole; an empty table gives an empty result; long texts are cut into parts that share all but one byte of a
window; no ties arise; extra columns aren't read, so they may have any name. Windows of GRAM bytes or fewer are
refused.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, Common, of_all
from .common import Scratch, arrow_map, text_of
from .lcp_merge import common_prefix, decoded, front_code, merge

WINDOW = 200
FOLD_BITS = 27
COMMON_BITS, COMMON_LEAST = 20, 1024
#: Bytes of a run's suffixes; a run is sorted in memory.
RUN_BYTES = 1 << 23
#: Suffixes of a range, about; and the most tasks: beyond, a task merges several ranges, one after the other.
RANGE, TASKS = 50_000, 20_000
#: Rows of covered bytes given out at once.
GIVEN = 4096
END = b"\xff"  # in no UTF-8 text
#: Anchors have small hashes; an odd factor spreads them over the ranges.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
DOC = ["d1", "d2"]
REF = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("p", "<i4")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d1, d2 (a row's name: equal only for repeated rows), text, id."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.select(F.xxhash64("id", "text").alias("d1"), F.xxhash64(F.lit(0x5BD1E995), F.col("id"), F.col("text")).alias("d2"), "text", "id")


def _grams(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in of_all([t.encode() for t in batch.column(0).to_pylist()], window):
                yield pa.RecordBatch.from_arrays([pa.array(found["gram"])], ["gram"])

    return arrow_map(rows.select("text"), run, "gram bigint")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' folded values: 2**FOLD_BITS of them, whatever the number of grams."""
    place = F.pmod("gram", F.lit(1 << FOLD_BITS)) + 1
    parts = grams.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << FOLD_BITS) // 8, np.uint8)
    for k, bits in parts.collect():  # bucket k holds the 32768 places from (k - 1) * 32768 + 1 on
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


#: part; a run's slice (sizes, rests; alone: whether the run had the suffix once; refs of those) or covered bytes (spans of a row)
_RUNS = "part int, sizes binary, rests binary, alone binary, refs binary, d1 bigint, d2 bigint, spans binary"


class _Covered:
    """Covered bytes by row, given out as packed (begin, end) pairs."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int], list[int]] = defaultdict(list)

    def add(self, ref: tuple[int, int, int], left: int, right: int) -> None:
        self.of[ref[0], ref[1]] += (ref[2] - left, ref[2] + right)

    def take(self) -> tuple[list[int], list[int], list[bytes]]:
        got = [d[0] for d in self.of], [d[1] for d in self.of], [np.array(s, "<i4").tobytes() for s in self.of.values()]
        self.of = defaultdict(list)
        return got


def _slices(items: list[tuple[bytes, tuple[int, int, int]]], parts: int, covered: _Covered) -> pa.RecordBatch:
    """A sorted run's slices by range of the gram's hash; what repeats within the run is covered."""
    items.sort(key=lambda x: x[0])
    by_part: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
    k = 0
    while k < len(items):
        key, ref = items[k]
        strings, alone, refs = by_part[int.from_bytes(key[:4], "big") * parts >> 32]
        strings.append(key)
        end = k + 1
        while end < len(items) and items[end][0] == key:
            end += 1
        alone.append(end == k + 1)
        if alone[-1]:
            refs.append(ref)
        else:
            cut = key.index(END, 8)
            for _, again in items[k:end]:
                covered.add(again, len(key) - cut - 2, cut - 8)
        k = end
    out: list[list] = [[] for _ in range(8)]
    for part, (strings, alone, refs) in by_part.items():
        values = (part, *front_code(strings), np.array(alone, bool).tobytes(), np.array(refs, REF).tobytes(), None, None, None)
        for column, v in zip(out, values, strict=True):
            column.append(v)
    for n, (d1, d2, spans) in enumerate(zip(*covered.take(), strict=True)):  # these only pass through the ranges
        for column, v in zip(out, (n % parts, None, None, None, None, d1, d2, spans), strict=True):
            column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], _NAMES)


_NAMES = [x.split()[0] for x in _RUNS.split(", ")]
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def _runs(rows: DataFrame, parts: int, window: int, bits, common) -> DataFrame:
    """Sorted runs of the suffixes that aren't ruled out, in slices by range."""
    mask = (1 << FOLD_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = bits.value, Common(common.value)
        items: list[tuple[bytes, tuple[int, int, int]]] = []
        size, covered = 0, _Covered()
        for batch in batches:
            d1, d2 = (batch.column(i).to_pylist() for i in (0, 1))
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for found in of_all(texts, window, last):
                place = found["gram"] & mask
                some = np.flatnonzero((known[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool) | found["moved"])
                heads = (found["gram"][some].view(np.uint64) * SPREAD).astype(">u8").tobytes()
                for k, (t, a, b, p) in enumerate(zip(*(found[c][some].tolist() for c in ("text", "a", "b", "p")), strict=True)):
                    raw = texts[t]
                    key = b"%b%b\xff%b\xff" % (heads[8 * k : 8 * k + 8], raw[p : b + window], raw[a:p][::-1])
                    items.append((key, (d1[t], d2[t], p)))
                    size += len(key)
                    if size >= RUN_BYTES:
                        yield _slices(items, parts, covered)
                        items, size = [], 0
        if items:
            yield _slices(items, parts, covered)

    return arrow_map(rows.select(*DOC, "text"), run, _RUNS)


def clusters(rights: list[int], lefts: list[bytes], reach: list[int], window: int) -> list[tuple[int, int]]:
    """Of different members sorted by right context: how far (left, right) of its anchor each is covered by windows
    that it has in common with any other. rights: common prefix of a member's right context with the one before."""
    found = [(0, 0)] * len(lefts)
    todo = [(0, len(lefts))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        depth = min(rights[lo + 1 : hi])
        order = sorted(range(lo, hi), key=lefts.__getitem__)
        best = dict.fromkeys(order, 0)
        for x, y in zip(order, order[1:], strict=False):
            h = common_prefix(lefts[x], lefts[y])
            best[x], best[y] = max(best[x], h), max(best[y], h)
        for x, h in best.items():
            if h + depth >= window:  # all such strings hold the anchor, so together they are one
                found[x] = max(found[x][0], h), max(found[x][1], depth)
        if depth >= max(reach[lo:hi]):
            continue
        cut = lo
        for k in range(lo + 1, hi + 1):
            if k == hi or rights[k] == depth:
                todo.append((cut, k))
                cut = k
    return found


def _solved(slices: list[tuple[bytes, bytes, bytes, bytes]], window: int, covered: _Covered) -> Iterator[None]:
    """Merge a range's slices; stops whenever `covered` holds enough to be given out."""
    alone = [np.frombuffer(s[2], bool) for s in slices]
    refs = [iter(np.frombuffer(s[3], REF).tolist()) for s in slices]
    at = [0] * len(slices)
    #: of one gram: different suffixes, their prefix in common with the one before, the row if the corpus has it once
    group: list[list] = []

    def close() -> None:
        if len(group) < 2:
            return
        rights, lefts = [], []
        for key, _, _ in group:
            end = key.index(END, 8)
            rights.append(key[8:end])
            lefts.append(key[end + 1 : -1])
        # the shared prefix of two keys ends at the shorter right context at the latest
        shared = [min(max(0, h - 8), len(r), len(q)) for (_, h, _), r, q in zip(group, rights, [b"", *rights], strict=False)]
        for (_, _, ref), (left, right) in zip(group, clusters(shared, lefts, [len(r) for r in rights], window), strict=True):
            if ref is not None and right:
                covered.add(ref, left, right)

    for key, run, h in merge([decoded(s[0], s[1]) for s in slices]):
        ref = next(refs[run]) if alone[run][at[run]] else None
        at[run] += 1
        if group and h == len(key) == len(group[-1][0]):  # the same suffix again: both are covered as a whole
            cut = key.index(END, 8)
            for one in (group[-1][2], ref):
                if one is not None:
                    covered.add(one, len(key) - cut - 2, cut - 8)
            group[-1][2] = None
            continue
        if group and h < 8:
            close()
            group.clear()
            if len(covered.of) >= GIVEN:
                yield
        group.append([key, h, ref])
    close()
    yield


def _merged(runs: DataFrame, parts: int, window: int) -> DataFrame:
    """d1, d2, spans: covered bytes, range by range."""

    def given(columns: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], [*DOC, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list = []
        now, covered = None, _Covered()

        def solve() -> Iterator[pa.RecordBatch]:
            for _ in _solved(slices, window, covered):
                yield given(covered.take())

        for batch in batches:
            passing = batch.filter(batch.column("spans").is_valid()).select([*DOC, "spans"])
            if passing.num_rows:
                yield passing
            rows = batch.filter(batch.column("sizes").is_valid())
            for part, *one in zip(*(rows.column(c).to_pylist() for c in _NAMES[:5]), strict=True):
                if part != now and slices:
                    yield from solve()
                    slices.clear()
                now = part
                slices.append(one)
        if slices:
            yield from solve()

    spread = runs.repartitionById(min(parts, TASKS), "part")  # one range a task, while there are tasks.sortWithinPartitions("part")
    return arrow_map(spread, run, "d1 bigint, d2 bigint, spans binary")


def _fold(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 20)).cast("int")


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with what the table has for them; rows whose fold isn't in the table's (at most 2**20) aren't shuffled."""
    folds = F.broadcast(table.select(_fold(*DOC).alias("fold")).distinct().withColumn("there", F.lit(True)))
    marked = rows.withColumn("fold", _fold(*DOC)).join(folds, "fold", "left")
    some = marked.filter("there").drop("fold", "there").join(table, DOC, "left")
    return some.unionByName(marked.filter("there is null").drop("fold", "there"), allowMissingColumns=True)


def covered(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, common_least: int = COMMON_LEAST, range_size: int = RANGE) -> DataFrame:
    """d1, d2, spans (array of packed begins and ends): for each row with repeated strings, what they cover."""
    if window <= GRAM:
        raise ValueError(f"windows have more than {GRAM} bytes")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    rows = _keyed(docs, id_col, text_col)
    twice = scratch.save(_grams(rows, window).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    total = twice.agg(F.sum("n")).first()[0] or 0
    most = max(common_least, total >> COMMON_BITS)
    common = twice.filter(F.col("n") >= most).select("gram").toPandas()["gram"].to_numpy(np.int64)  # at most 2**COMMON_BITS
    shared = spark.sparkContext.broadcast
    bits, last = shared(_bitmap(twice)), shared(common)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_size))
    spans = _merged(_runs(rows, parts, window, bits, last), parts, window)
    out = scratch.save(spans.groupBy(*DOC).agg(F.collect_list("spans").alias("spans")), "covered")  # at most a row's own
    scratch.keep("covered")
    return out


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, common_least: int = COMMON_LEAST, range_size: int = RANGE) -> DataFrame:
    """One row for each of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) the bytes kept."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    kind = docs.schema[id_col].dataType.simpleString()
    spans = covered(docs, window, id_col, text_col, scratch, common_least, range_size)
    rows = _keyed(docs, id_col, text_col)
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                pairs = np.frombuffer(b"".join(packed or ()), "<i4").reshape(-1, 2)
                kept, at, removed, n = [], 0, 0, 0
                for begin, end in sorted(map(tuple, pairs.tolist())):
                    if n and begin <= at:
                        removed += max(0, end - at)
                        at = max(at, end)
                        continue
                    kept.append(raw[at:begin])
                    n, removed, at = n + 1, removed + end - begin, end
                kept.append(raw[at:])
                left = b"".join(kept)
                for column, v in zip(out, (len(raw), removed, n, hashlib.sha256(left).hexdigest(), left), strict=False):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names)

    joined = _joined(rows, spans).select("id", "text", "spans")
    out = arrow_map(joined, run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))
    return out.withColumnRenamed("id", id_col)
