"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are grouped by the nearest of a number of pivots, rows with the least hashes, that grows with the square
root of the rows up to PIVOTS. Each group's summary (rows, radius, largest norm, widest angle) bounds the inner
product of a query with any member: by the pivot's product and the radius, by the norms, and by the angle to the
pivot. Per query, the k-th best product that is certain (of the pivots themselves, or by the summaries) is a floor;
a query is only sent where an upper bound reaches the floor. Groups that are neighbours share a bin of about
BLOCK_ROWS members, a larger group has several blocks; queries are cut in blocks of about QUERY_ROWS, and a bin's
members are replicated only to the query blocks that need it. So a task holds a block of each, whatever the number
of rows or copies. Blocks are solved by a matrix product and give at most k rows a query, which are merged by rank.

Products are exact integers. Defined results: vectors that are null, or hold null or non-finite components, and
rows of null id take no part; vectors of different lengths are padded with zeros; repeated rows are candidates
each; a query id counts once (its largest vector, if it has several); ties go to the smaller id; an empty table
gives an empty result; extra columns aren't read, so they may have any name. Scaled components and scores beyond 64
bits are the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: The most pivots: a bounded sample. Their number and width bound what is broadcast.
PIVOTS = 512
BLOCK_ROWS, QUERY_ROWS = 2048, 1024
EXACT, WHOLE = float(1 << 53), float(1 << 62)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, v: floor(scale * x) of each component as double, of the rows that take part."""
    x = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & x.isNotNull() & sound).withColumn("v", F.transform(x, lambda c: F.floor(c * scale).cast("bigint")))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(col), width), np.int64)
    for k, v in enumerate(col):
        out[k, : len(v)] = v.values.to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where these can't round, by 64-bit numbers where these can't overflow, else
    by whole numbers of any size, cut to 64 bits at the end."""
    most = np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < WHOLE:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _pivots(vectors: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Different vectors among the rows of least hashes, and the vectors' width; no shuffle of vectors."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    want = max(1, min(most, int(n**0.5)))
    got = vectors.select("v").orderBy(F.xxhash64("id", "v"), "v").limit(2 * want).collect()  # at most 2 * PIVOTS
    chosen = sorted({tuple(r[0]) for r in got})[:want] if n else []
    out = np.zeros((len(chosen), width or 0))
    for k, v in enumerate(chosen):
        out[k, : len(v)] = v
    return out, width


def _bins(sizes: np.ndarray, centres: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each group, blocks of each bin): groups in order of their centres' place on a line fill bins."""
    line = centres @ np.linspace(-1, 1, centres.shape[1]) if centres.shape[1] else np.zeros(len(centres))
    of, held = np.zeros(len(sizes), np.int64), [0]
    for c in np.argsort(line, kind="stable"):
        if held[-1] and held[-1] + sizes[c] > rows:
            held.append(0)
        of[c] = len(held) - 1
        held[-1] += sizes[c]
    return of, -(-np.array(held) // rows)


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each query (id divisible by `every`) against all other rows."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = whole_vectors(df, id_col, vec_col, scale)
    centres, width = _pivots(vectors, pivots)
    if not len(centres):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shared = spark.sparkContext.broadcast(centres)  # at most PIVOTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        norms = np.sqrt((p * p).sum(1))
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1), width)
            x = m.astype(float)
            cell = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(1))
            norm = np.sqrt((x * x).sum(1))
            angle = _angle((x * p[cell]).sum(1), norm * norms[cell])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(cell, pa.int32()), pa.array(far), pa.array(norm), pa.array(angle)], ["id", "v", "cell", "far", "norm", "angle"])

    data = scratch.save(arrow_map(vectors, assign, "id bigint, v binary, cell int, far double, norm double, angle double"), "cells")
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm"), F.max("angle").alias("angle")).orderBy("cell").collect()  # a row a pivot
    cells, sizes = (np.array([r[c] for r in summary], np.int64) for c in ("cell", "n"))
    radius, longest, widest = (np.array([r[c] for r in summary]) for c in ("radius", "norm", "angle"))
    bins, blocks = _bins(sizes, centres[cells], block_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[cells]
        norms = np.sqrt((p * p).sum(1))
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, raw in enumerate(batch.column(1)):
                q = np.frombuffer(raw.as_buffer(), np.int64).astype(float)
                own = np.sqrt(q @ q)
                mid = p @ q
                slack = 1 + 1e-9 * (np.abs(mid) + own * (radius + longest))
                turn = np.maximum(0, _angle(mid, own * norms) - widest - 1e-6)
                high = np.minimum(mid + own * radius, own * longest * np.where(turn < np.pi / 2, np.cos(np.minimum(turn, np.pi / 2)), 0.0)) + slack
                low = mid - own * radius - slack
                order = np.argsort(-low)
                enough = np.cumsum(sizes[order]) >= k + 1  # one of them may be the query itself
                floor = low[order[enough.argmax()]] if enough.any() else -np.inf
                if len(mid) > k:  # pivots are rows
                    floor = max(floor, np.partition(mid, len(mid) - k - 1)[len(mid) - k - 1] - slack.max())
                need = np.unique(bins[high >= min(floor, WHOLE)])
                out[0] += [row] * len(need)
                out[1] += need.tolist()
                out[2] += blocks[need].tolist()
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["id", "v", "bin", "blocks"])

    queries = data.filter(F.col("id") % every == 0).groupBy("id").agg(F.max("v").alias("v"))
    routed = arrow_map(queries, route, "id bigint, v binary, bin int, blocks int")
    routed = scratch.save(routed.withColumn("spread", F.xxhash64("id")), "routed")
    groups = F.broadcast(spark.createDataFrame([(int(c), int(b), int(blocks[b])) for c, b in zip(cells, bins, strict=True)], "cell int, bin int, blocks int"))  # a row a pivot
    # a bin's queries in as many blocks as their number asks for
    asked = scratch.save(routed.groupBy("bin").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts")), "asked")  # at most a row a pivot
    asked = F.broadcast(asked)
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = routed.join(asked, "bin").select("id", "v", "bin", F.pmod("spread", F.col("parts")).cast("int").alias("part"), every_block("blocks").alias("block"))
    members = data.join(groups, "cell").join(asked, "bin").select("id", "v", "bin", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("blocks")).cast("int").alias("block"), every_block("parts").alias("part"))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(d):
            d = d.sort_values("id", kind="stable")
            ids = d["id"].to_numpy()
            b = np.frombuffer(b"".join(d["v"]), np.int64).reshape(len(d), -1)
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                a = np.frombuffer(b"".join(part["v"]), np.int64).reshape(len(part), -1)
                for query, row in zip(part["id"], _products(a, b), strict=True):
                    others = np.flatnonzero(ids != query)
                    got = row[others]
                    if len(got) > k:
                        least = np.partition(got, len(got) - k)[len(got) - k]
                        others = others[got >= least]
                        got = row[others]
                    best = np.lexsort((ids[others], ~got))[:k]  # ~ reverses the order of all 64-bit numbers
                    out["query_id"] += [query] * len(best)
                    out["vec_id"] += ids[others[best]].tolist()
                    out["score"] += got[best].tolist()
        return pd.DataFrame(out).astype("int64")

    by = ["bin", "block", "part"]
    near = asks.groupBy(*by).cogroup(members.groupBy(*by)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    scratch.keep("cells", "routed", "asked")
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _angle(product: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angles from products and products of norms; 0 where a vector is 0, which any bound then covers."""
    return np.arccos(np.clip(np.divide(product, norms, out=np.ones_like(product), where=norms > 0), -1, 1))
