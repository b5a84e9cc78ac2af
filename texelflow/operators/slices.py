"""Operators over slice and level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_levels(slices: DataFrame) -> DataFrame:
    """image, level, copies of levels that an image has more than once."""
    return slices.groupBy("image", "level").agg(F.count("*").alias("copies")).filter("copies > 1")


def missing_levels(slices: DataFrame) -> DataFrame:
    """image, level of the gaps below each image's highest level."""
    per = slices.groupBy("image").agg(F.max("level").alias("top"), F.collect_set("level").alias("have"))  # levels of one image are few
    wanted = per.select("image", F.explode(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("top")), F.col("have"))).alias("level"))
    return wanted


def alpha_merged(slices: DataFrame) -> DataFrame:
    """Each colour slice with the state of its alpha slice: missing, mismatch or ok."""
    alpha = slices.filter("is_alpha").select("image", "level", F.col("width").alias("alpha_width"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("alpha_width") != F.col("width"), "mismatch").otherwise("ok")
    return slices.filter("not is_alpha").join(alpha, ["image", "level"], "left").select("image", "level", "width", state.alias("alpha_state"))


def overlapping_levels(levels: DataFrame) -> DataFrame:
    """Pairs of levels of one container whose bytes overlap. The container is the join key; only its few levels meet."""
    a, b = levels.alias("a"), levels.alias("b")
    on = (F.col("a.container") == F.col("b.container")) & (F.col("a.level") < F.col("b.level")) & (F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop"))
    return a.join(b, on).select(F.col("a.container").alias("container"), F.col("a.level").alias("first"), F.col("b.level").alias("second"))


def concatenated(levels: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """key, payload: an image's levels put together in order; binary payloads byte by byte, strings as they are."""
    parts = F.array_sort(F.collect_list(F.struct(order, payload)))  # an image's levels are few
    if dict(levels.dtypes)[payload] != "binary":
        return levels.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[payload]), "").alias(payload))
    return levels.groupBy(key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p[payload])), "")).alias(payload))


def running_modulo(rows: DataFrame, key: str, order: str, delta: str, modulus: int) -> DataFrame:
    """key, order, value: running sums of the deltas, modulo."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, F.pmod(F.sum(delta).over(w), F.lit(modulus)).alias("value"))


def running_xor(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, F.bit_xor(value).over(w).alias("value"))


def runs_expanded(runs: DataFrame, key: str, length: str, value: str) -> DataFrame:
    """key, place, value: each run's value `length` times."""
    return runs.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length) - 1)).alias("place"), value)


def displayable(images: DataFrame, failed: DataFrame) -> DataFrame:
    """Images (image, ...) without those that `failed` (image) lists."""
    return images.join(failed.select("image").distinct(), "image", "left_anti")


def deepest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, relative: the path below the deepest root that holds it. A path is joined on its own few ancestors."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.select("path", F.explode(ancestors).alias("root")).join(roots.distinct(), "root", "left_semi")
    best = each.groupBy("path").agg(F.max(F.length("root")).alias("n"))
    return files.join(best, "path", "left").select("path", F.when(F.col("n").isNull(), F.col("path")).otherwise(F.expr("substring(path, n + 2)")).alias("relative"))
