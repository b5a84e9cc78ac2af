"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Each level counts its keys folded into buckets; only rows in a bucket that holds more than one row go on. Which
buckets these are is a bitmap of 2**bits bits, that is broadcast: 8 bits or more for each row of the corpus, up to
2**MOST_BITS (16 MB), whatever the corpus. Folding only lets some unique rows go one level further; the last level
groups by the full SHA-256. The full content is hashed for rows that survive both levels. Text is never shuffled.

Defined results: null text counts as empty; of equal texts the row with the largest id stays (null ids are the
smallest; of fully repeated rows exactly one stays); texts of any length are hashed whole; an empty table gives an
empty result; extra columns are passed on by keep_one(), whatever their names, and not read by groups().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, keep_decided, row_key, salted_join, text_of

LEAST_BITS, MOST_BITS = 20, 27
PREFIX_CHARS = 256


def _bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * rows).bit_length()))


def _bucket(bits: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits)) + 1


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The bitmap of the buckets of more than one row: at most 2**MOST_BITS bits, in rows of 32768."""
    twice = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy(F.bitmap_bucket_number(key).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def _marked(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """rows with `{key}_shared`: whether their bucket is in the bitmap."""
    there = rows.withColumn("part", F.bitmap_bucket_number(key)).join(F.broadcast(bitmap), "part", "left")
    at = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) != 0
    return there.withColumn(f"{key}_shared", F.coalesce(bit, F.lit(False))).drop("part", "bits")


def fingerprints(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, doc_key: bool = False) -> DataFrame:
    """A written table with a row for each of docs: row, id, sha (null: certainly unique), if asked for digest and the row key `doc`."""
    bits = _bits(docs.count())
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    full = F.sha2("text", 256)
    more = [full.alias("digest")] if digest else []
    more += [F.when(F.col("p_shared"), row_key("id", "text")).alias("doc")] if doc_key else []
    rows = rows.withColumn("len", F.octet_length("text")).withColumn("l", _bucket(bits, F.col("len")))
    rows = _marked(rows, "l", scratch.save(_shared(rows, "l"), "lengths"))
    rows = rows.withColumn("p", F.when(F.col("l_shared"), _bucket(bits, F.col("len"), F.substring("text", 1, PREFIX_CHARS))))
    rows = _marked(rows, "p", scratch.save(_shared(rows, "p"), "prefixes"))
    light = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.when(F.col("p_shared"), full).alias("sha"), *more)
    return scratch.save(light, "fingerprints")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, doc_key: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row for each of docs: row, id, sha, (digest,) keep_id, group_size, kept."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    light = fingerprints(docs, scratch, id_col, text_col, digest, doc_key)
    best = F.max(F.struct("id", "row"))
    sizes = scratch.save(light.filter("sha is not null").groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1"), "sizes")
    scratch.keep("fingerprints", "sizes")
    total = light.count()
    hot = hot_keys(sizes, ["sha"], "group_size", total)
    alone = light.filter("sha is null").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    found = salted_join(light.filter("sha is not null"), sizes, ["sha"], hot, F.col("row"), "left")
    found = found.withColumns({"keep_id": F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint")), "kept": F.coalesce(F.col("best.row") == F.col("row"), F.lit(True))}).drop("best")
    return alone.unionByName(found)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    found = groups(docs, id_col, text_col, scratch=scratch, doc_key=True).filter("group_size > 1")
    return keep_decided(docs, found.select("doc", "kept"), scratch, id_col, text_col)
