"""Mip sizes, partition maps, weight grids and regridding, as expressions over small generated relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import div, long

#: Fixed values: (bits, trits, quints) of the weight ranges 0..11.
WEIGHT_RANGES = ((1, 0, 0), (0, 1, 0), (2, 0, 0), (0, 0, 1), (1, 1, 0), (3, 0, 0), (1, 0, 1), (2, 1, 0), (4, 0, 0), (2, 0, 1), (3, 1, 0), (5, 0, 0))
#: Step of the trit or quint, by range.
WEIGHT_STEPS = {4: 50, 6: 28, 7: 23, 9: 13, 10: 11}


def mip_chain(images: DataFrame, bw: int, bh: int, block_bytes: int) -> DataFrame:
    """image, level, width, height, blocks, bytes of each level below a 1 x 1 end."""
    top = F.floor(F.log2(F.greatest("width", "height"))).cast("int")
    size = lambda c: F.greatest(long(1), F.expr(f"shiftright({c}, level)"))
    rows = images.select("image", "width", "height", F.explode(F.sequence(F.lit(0), top)).alias("level")).withColumns({"w": size("width"), "h": size("height")})
    count = div(F.col("w") + (bw - 1), bw) * div(F.col("h") + (bh - 1), bh)
    return rows.select("image", "level", F.col("w").alias("width"), F.col("h").alias("height"), count.alias("blocks"), (count * block_bytes).alias("bytes"))


def _u32(x: Column) -> Column:
    return x.bitwiseAND(0xFFFFFFFF)


def hash52(seed: Column) -> Column:
    """32-bit integer hash of the format's partition function."""
    p = seed
    steps = (("x", -15), ("-", 17), ("+", 7), ("+", 4), ("x", -5), ("+", 16), ("x", -7), ("x", -3), ("x", 6), ("x", -17))
    for kind, n in steps:
        moved = F.shiftright(p, -n) if n < 0 else F.shiftleft(p, n)
        p = _u32({"x": p.bitwiseXOR(moved), "+": p + moved, "-": p - moved}[kind])
    return p


def partition_map(spark: SparkSession, seeds: int, bw: int, bh: int) -> DataFrame:
    """seed, parts, x, y, part for 2 to 4 parts: the format's pseudo-random partition of a block."""
    rows = spark.range(seeds).select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(2), F.lit(4))).alias("parts"))
    rows = rows.withColumn("s", F.col("seed") + 1024 * (F.col("parts").cast("bigint") - 1)).withColumn("h", hash52(F.col("s")))
    five_or = lambda c, a, b: F.when(c, a).otherwise(b)
    a, b = five_or(F.col("s").bitwiseAND(2) != 0, 4, 5), five_or(F.col("parts") == 3, 6, 5)
    odd = F.col("s").bitwiseAND(1) != 0
    rows = rows.withColumns({"f": F.when(odd, a).otherwise(b), "g": F.when(odd, b).otherwise(a)})
    for k in range(8):
        nibble = F.shiftright("h", 4 * k).bitwiseAND(15)
        rows = rows.withColumn(f"k{k}", F.floor(nibble * nibble / F.pow(F.lit(2.0), "f" if k % 2 == 0 else "g")).cast("bigint"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(bw * bh - 1)))).withColumns({"x": (F.col("n") % bw).cast("bigint"), "y": F.floor(F.col("n") / bw).cast("bigint")})
    zoom = 2 if bw * bh < 31 else 1
    level = lambda k, shift: (F.col(f"k{2 * k}") * F.col("x") * zoom + F.col(f"k{2 * k + 1}") * F.col("y") * zoom + F.shiftright("h", shift)).bitwiseAND(63)
    values = [level(0, 14), level(1, 10), F.when(F.col("parts") >= 3, level(2, 6)).otherwise(long(0)), F.when(F.col("parts") >= 4, level(3, 2)).otherwise(long(0))]
    best = F.greatest(*values)
    part = F.when(values[0] == best, 0).when(values[1] == best, 1).when(values[2] == best, 2).otherwise(3)
    return rows.select("seed", "parts", "x", "y", part.alias("part"))


def dequantised_weights(spark: SparkSession) -> DataFrame:
    """range, code, weight: all codes of the weight ranges, on the scale 0..64."""
    out = None
    for r, (nbits, trits, quints) in enumerate(WEIGHT_RANGES):
        levels = (3 if trits else 5 if quints else 1) << nbits
        code = F.col("id")
        low, high = code.bitwiseAND((1 << nbits) - 1), F.shiftright(code, nbits)
        if nbits == 0:
            value = F.get(F.array(*[long(v) for v in ((0, 32, 63) if trits else (0, 16, 32, 47, 63))]), code.cast("int"))
        elif r not in WEIGHT_STEPS:  # bits alone, replicated to six
            value = long(0)
            for shift in range(6 - nbits, -nbits, -nbits):
                value = value.bitwiseOR(F.shiftleft(code, shift) if shift >= 0 else F.shiftright(code, -shift))
        else:
            bit = lambda k: F.shiftright(low, k).bitwiseAND(1)
            spread = {4: long(0), 6: long(0), 7: bit(1) * 0b1000101, 9: bit(1) * 0b1000010, 10: bit(2) * 0b1000010 + bit(1) * 0b0100001}[r]
            mask = bit(0) * 0x7F
            value = mask.bitwiseAND(0x20).bitwiseOR(F.shiftright((high * WEIGHT_STEPS[r] + spread).bitwiseXOR(mask), 2))
        rows = spark.range(levels).select(F.lit(r).alias("range"), code.alias("code"), (value + (value > 32).cast("int")).alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def upsampled(grids: DataFrame, gw: int, gh: int, bw: int, bh: int, keep: tuple[str, ...]) -> DataFrame:
    """keep, x, y, weight: weight grids `w` (array) spread bilinearly over a block."""
    rows = grids.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.lit(bw * bh - 1))).alias("n")).withColumns({"x": (F.col("n") % bw).cast("bigint"), "y": F.floor(F.col("n") / bw).cast("bigint")})
    if (gw, gh) == (bw, bh):
        return rows.select(*keep, "x", "y", F.get("w", F.col("n")).alias("weight"))
    sx, sy = (1024 + bw // 2) // (bw - 1) * (gw - 1), (1024 + bh // 2) // (bh - 1) * (gh - 1)
    rows = rows.withColumns({"gx": F.shiftright(F.col("x") * sx + 32, 6), "gy": F.shiftright(F.col("y") * sy + 32, 6)})
    fx, fy = F.col("gx").bitwiseAND(15), F.col("gy").bitwiseAND(15)
    at = F.shiftright("gx", 4) + F.shiftright("gy", 4) * gw
    both = F.shiftright(fx * fy + 8, 4)
    corner = lambda d, share: F.coalesce(F.get("w", (at + d).cast("int")), long(0)) * share  # noqa: E731  past the edge the share is 0
    sums = corner(0, 16 - fx - fy + both) + corner(1, fx - both) + corner(gw, fy - both) + corner(gw + 1, both)
    return rows.select(*keep, "x", "y", F.shiftright(sums + 8, 4).alias("weight"))


def regrid(spark: SparkSession, width: int, height: int, source: int = 6, dest: int = 4) -> DataFrame:
    """dx, dy, sx, sy, texels: how many texels each dest block takes from each source block."""
    x = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    return x.groupBy(div(F.col("x"), dest).alias("dx"), div(F.col("y"), dest).alias("dy"), div(F.col("x"), source).alias("sx"), div(F.col("y"), source).alias("sy")).agg(F.count("*").alias("texels"))
