"""Near-duplicate detection with DartMinHash over word shingles.

Signatures: every shingle throws darts, a Poisson process over its weight and rank that depends only on the
shingle's hash. Darts that land below the shingle's weight count; each belongs to one of COORDINATES coordinates,
and the earliest dart a coordinate gets is its value, so two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. The rank axis is cut into widening regions; a text throws into the next one only
until all its coordinates have a dart.

Weights and similarity are the same measure throughout: by default every distinct shingle weighs 1 and links are
decided by the Jaccard similarity of the sets; with weight="count" a shingle weighs as often as it occurs and links
are decided by the sum of the lesser weights over that of the greater ones, so that a text isn't like itself twice.

Links: texts with the same weighted set of shingles are one node. Nodes that agree in a band of ROWS coordinates
share a bucket. Within buckets, pairs whose signatures don't rule it out are compared (similarity of their whole
sets, 40 bits a shingle, SIMILARITY or more) until the bucket's nodes are joined as far as they can be; only links
that join two classes are written. Buckets of more than BLOCK nodes are solved in random blocks first; then those of
their nodes that are outside the bucket's largest class are compared with all its nodes, block by block. So no link
is given up and no group meets in one task.

Defined results: null and empty texts have no shingles and are copies of each other; texts of fewer than `words`
words have one shingle; null ids are the smallest; of a class the row with the largest id stays (of fully
repeated rows exactly one); texts of any length are shingled whole; an empty table gives an empty result; extra
columns aren't read by near_duplicates() and passed on by keep_one(), so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hot_keys, if_small, keep_decided, row_key, salted_join, text_of
from .text_hash import grouped, mix, shingles, words

SIMILARITY = 0.8
SHINGLE_WORDS = 5
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
BLOCK = 384
FOLD_BITS = 20
#: Signatures that agree in a smaller share are at least six standard deviations below SIMILARITY.
RULED_OUT = SIMILARITY - 6 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
#: Rank regions: the first is this wide, each next one as wide as all before.
FIRST_REGION = 0.125
_G = np.uint64(0x9E3779B97F4A7C15)


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities as thresholds of a 53-bit number."""
    top = int(mean + 12 * mean**0.5 + 12)
    p = np.exp(-mean + np.arange(top) * np.log(mean) - np.concatenate([[0], np.cumsum(np.log(np.arange(1, top)))]))
    return (np.cumsum(p) * 2.0**53).clip(0, 2**53).astype(np.int64)


_CDF: dict[float, np.ndarray] = {}


def _darts(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, region: int, best: np.ndarray) -> None:
    """Throw the darts of one rank region; keep the earliest per owner and coordinate in `best`."""
    width = FIRST_REGION * (1 if region == 0 else 2 ** (region - 1))
    cdf = _CDF.setdefault(width, _poisson(width))
    level = 0
    while len(h):
        seed = np.uint64(((region << 20) + level * 2 + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))
        u = mix(h + seed)
        count = np.searchsorted(cdf, (u >> np.uint64(11)).astype(np.int64), side="right")
        hit = np.flatnonzero(count)
        n = count[hit]
        which = np.repeat(hit, n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(u[which] + (nth.astype(np.uint64) + np.uint64(1)) * _G)
        if level or (weight < 1).any():
            at = level + (mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            below = at < weight[which]
            which, dart = which[below], dart[below]
        place = mix(dart + np.uint64(2))
        coordinate = (place >> np.uint64(32)).astype(np.int64) * COORDINATES >> 32
        # the region's number and the place within it order the ranks; the low bits name the dart
        value = (np.uint64(region) << np.uint64(58)) | ((dart >> np.uint64(6)) & ~np.uint64(0xFFFF)) | (place & np.uint64(0xFFFF))
        np.minimum.at(best.reshape(-1), owner[which] * COORDINATES + coordinate, value)
        level += 1
        more = weight > level
        h, weight, owner = h[more], weight[more], owner[more]


EMPTY = np.uint64(2**64 - 1)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, COORDINATES) of sets given as (hashes, weights); rows of empty sets stay EMPTY."""
    best = np.full((len(sets), COORDINATES), EMPTY)
    sizes = np.array([len(h) for h, _ in sets])
    if not sizes.sum():
        return best
    h, weight = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    owner = np.repeat(np.arange(len(sets)), sizes)
    region = 0
    while len(h):
        _darts(h, weight, owner, region, best)
        region += 1
        more = (best == EMPTY).any(1)[owner]
        h, weight, owner = h[more], weight[more], owner[more]
    return best


def shingle_sets(texts: list[str], size: int, weight: str = "set") -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first text, (sorted shingle hashes, weights) of each text) of runs of texts."""
    for first, run in grouped(texts):
        h, at = words(run, signs=False)
        out = []
        for k in range(len(run)):
            s, n = np.unique(shingles(h[at[k] : at[k + 1]], size), return_counts=True)
            out.append((s, n.astype(np.float64) if weight == "count" else np.ones(len(s))))
        yield first, out


def sketched(docs: DataFrame, size: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", weight: str = "set") -> DataFrame:
    """row, id, doc (key of id and text), same (hash of the weighted shingle set), signature bytes, band keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        powers = np.cumprod(np.full(ROWS, 0x100000001B3, np.uint64))
        for batch in batches:
            same, sig, bands = [], [], []
            for _, sets in shingle_sets(batch.column(2).to_pylist(), size, weight):
                best = mix(signatures(sets))
                same += [np.array([mix(s * v).sum(dtype=np.uint64), mix(s + v * _G).sum(dtype=np.uint64), len(s)], np.uint64).tobytes() for s, w in sets for v in [w.astype(np.uint64)]]
                sig += [r.tobytes() for r in (best >> np.uint64(56)).astype(np.uint8)]
                keys = mix((best.reshape(len(sets), BANDS, ROWS) * powers).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _G)
                bands += list(keys.view(np.int64))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["row", "id", "doc", "same", "sig", "bands"])
            row += n

    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("doc"), text_of(text_col).alias("text"))
    return arrow_map(rows, run, f"row bigint, id {kind}, doc string, same binary, sig binary, bands array<bigint>")


#: Sorted hashes and their weights; None: all 1.
Weighted = tuple[np.ndarray, np.ndarray | None]


def _packed(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes after a byte 0; or, if any weight isn't 1, after a byte 1, then the weights."""
    short = (hashes >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return b"\0" + short if (weights == 1).all() else b"\1" + short + weights.astype("<u4").tobytes()


def _unpacked(raw: bytes) -> Weighted:
    n = (len(raw) - 1) // (9 if raw[0] else 5)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 1).reshape(-1, 5)
    return out.view("<u8").reshape(-1), (np.frombuffer(raw[1 + 5 * n :], "<u4").astype(float) if raw[0] else None)


def jaccard(a: Weighted, b: Weighted) -> float:
    """Sum of the lesser weights over that of the greater ones; of weights of 1 the Jaccard similarity of sets."""
    if a[1] is None and b[1] is None:
        both = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return both / max(1, len(a[0]) + len(b[0]) - both)
    (x, v), (y, w) = ((h, np.ones(len(h)) if n is None else n) for h, n in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(v[i], w[j]).sum()
    return both / max(1.0, v.sum() + w.sum() - both)


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join classes of one block: rows node, label, sig, shingles."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    nodes, sig = pdf["node"].to_numpy(), np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    sets = [_unpacked(x) for x in pdf["shingles"]]
    root = {x: x for x in pdf["label"]}
    label = list(pdf["label"])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    alike = np.zeros((len(nodes), len(nodes)), np.int16)
    for k in range(len(nodes)):
        alike[k, k + 1 :] = (sig[k + 1 :] == sig[k]).sum(1)
    i, j = np.nonzero(alike >= RULED_OUT * sig.shape[1])
    order = np.argsort(-alike[i, j], kind="stable")
    links = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = find(label[a]), find(label[b])
        if x != y and jaccard(sets[a], sets[b]) >= SIMILARITY:
            root[max(x, y)] = min(x, y)
            links.append((nodes[a], nodes[b]))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label of all nodes of the links: each node takes its smallest neighbour, the links are contracted
    onto these, until none is left. Every round at least halves the nodes that still have links."""
    spark = links.sparkSession
    current = links.filter("a != b")
    maps = []
    while True:
        current = scratch.save(current.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges-{len(maps)}")
        if current.isEmpty():
            break
        both = current.union(current.select("b", "a"))
        up = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), f"up-{len(maps)}")
        maps.append(up)
        ends = current.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b")
        current = ends.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not maps:
        return spark.createDataFrame([], "node bigint, label bigint")
    label = maps[-1].toDF("node", "label")
    for up in reversed(maps[:-1]):
        label = up.join(label.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    return scratch.save(label, f"labels-{scratch.next()}")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, block: int = BLOCK, scratch: Scratch | None = None, weight: str = "set") -> DataFrame:
    """One row for each of docs: id, doc (its row_key), class_id (the id that stays), class_size, kept."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    sketch = scratch.save(sketched(docs, size, id_col, text_col, weight), "sketch")
    # texts with equal shingle sets are one node, named by its smallest row
    same = scratch.save(sketch.groupBy("same").agg(F.min("row").alias("node"), F.count("*").alias("n")), "same")
    total = sketch.count()
    rows = salted_join(sketch.select("row", "id", "doc", "same"), same.select("same", "node"), ["same"], hot_keys(same, ["same"], "n", total), F.col("row")).drop("same")
    rows = scratch.save(rows, "rows")
    # buckets of the bands; of those with equal members one is enough
    copies = scratch.save(rows.filter("row != node").select("row"), "copies")
    heads = sketch.select("row", "bands").join(if_small(copies), "row", "left_anti").select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    shared = scratch.save(heads.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    fold = F.pmod("bucket", F.lit(1 << FOLD_BITS)).cast("int")
    folds = F.broadcast(shared.select(fold.alias("fold")).distinct())  # at most 2**FOLD_BITS numbers
    few = heads.withColumn("fold", fold).join(folds, "fold", "left_semi").drop("fold")
    members = scratch.save(salted_join(few, shared, ["bucket"], hot_keys(shared, ["bucket"], "n", total), F.col("node")), "shared-members")
    alike = members.groupBy("bucket", "n").agg(F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(7, node))").alias("y"))
    buckets = scratch.save(alike.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    members = salted_join(members.drop("n"), buckets, ["bucket"], hot_keys(buckets, ["bucket"], "n", total), F.col("node"))
    members = scratch.save(members, "members")
    nodes = scratch.save(members.select(F.col("node").alias("row")).distinct(), "nodes")
    wanted = scratch.save(sketch.select("row", "doc", "sig").join(if_small(nodes), "row").withColumnRenamed("row", "node"), "wanted")
    fold = F.pmod(F.xxhash64("doc"), F.lit(1 << FOLD_BITS)).cast("int")
    folded = F.broadcast(wanted.select(fold.alias("fold")).distinct())  # at most 2**FOLD_BITS numbers
    texts = docs.select(row_key(id_col, text_col).alias("doc"), text_of(text_col).alias("text")).withColumn("fold", fold).join(folded, "fold").drop("fold")
    sets = scratch.save(_sets(texts.join(wanted, "doc").select("node", "sig", "text"), size, weight), "sets")

    def solved(rows: DataFrame, by: list[str]) -> DataFrame:
        own = scratch.save(rows.select("node").distinct(), f"nodes-{scratch.next()}")
        full = rows.join(sets.join(if_small(own), "node", "left_semi"), "node").select(*by, "node", "label", "sig", "shingles")
        return scratch.save(full.groupBy(*by).applyInPandas(solve, "a bigint, b bigint"), f"links-{scratch.next()}")

    def part(seed: int, n: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.ceil(n / block)).cast("int")

    links = solved(members.withColumns({"block": part(0, F.col("n")), "label": F.col("node")}), ["bucket", "block"])
    labels = components(links, scratch)
    large = members.filter(F.col("n") > block)
    if not large.isEmpty():
        links = links.union(solved(_labelled(large, labels).withColumn("block", part(1, F.col("n"))), ["bucket", "block"]))
        labels = components(links, scratch)
        # what is outside a large bucket's largest class meets all of the bucket
        now = scratch.save(_labelled(large, labels), "large")
        per = now.groupBy("bucket", "label").agg(F.count("*").alias("c"))
        first = per.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n"))
        first = scratch.save(first.select("bucket", F.col("m.label").alias("main"), F.ceil((F.col("n") - F.col("m.c")) / block).alias("outer"), F.ceil(F.col("n") / block).alias("inner")).filter("outer > 0"), "first")
        if not first.isEmpty():
            seen = now.join(first, "bucket")
            i = F.pmod(F.xxhash64(F.lit(2), F.col("node")), F.col("outer"))
            j = F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.col("inner"))
            out = seen.filter("label != main").select("bucket", "node", "label", i.alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("inner") - 1)).alias("j"))
            all_ = seen.select("bucket", "node", "label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outer") - 1)).alias("i"), j.alias("j"))
            links = links.union(solved(out.unionByName(all_), ["bucket", "i", "j"]))
            labels = components(links, scratch)
    of = scratch.save(_labelled(rows, labels), "classes")
    classes = scratch.save(of.groupBy("label").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("class_size")).filter("class_size > 1"), "best")
    scratch.keep("classes", "best")
    out = salted_join(of, classes, ["label"], hot_keys(classes, ["label"], "class_size", total), F.col("row"), "left")
    return out.select("id", "doc", F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"), F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"))


def _sets(rows: DataFrame, size: int, weight: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_packed(*s) for _, got in shingle_sets(batch.column(2).to_pylist(), size, weight) for s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["node", "sig", "shingles"])

    return arrow_map(rows, run, "node bigint, sig binary, shingles binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "minhash")
    found = near_duplicates(docs, id_col, text_col, scratch=scratch).filter("class_size > 1")
    return keep_decided(docs, found.select("doc", "kept"), scratch, id_col, text_col)
