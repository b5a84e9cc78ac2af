"""Images as arrays of texels, and the block packers that need no bit stream.

An image stays one row, its blocks are unnested from it, and a block's aggregates run over its own array: no
shuffle is needed at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import clamp255, long

#: BC4 selectors by the number of thresholds reached; EAC tables tried, by number.
BC4_SELECTORS = (1, 7, 6, 5, 4, 3, 2, 0)
EAC_TABLES = {2: (-2, -5, -8, -13, 1, 4, 7, 12), 8: (-2, -6, -8, -10, 1, 5, 7, 9), 11: (-2, -5, -7, -10, 1, 4, 6, 9), 13: (-1, -2, -3, -10, 0, 1, 2, 9)}
NARROW = (2, 1, 0, 4, 5, 6)


def blocks(images: DataFrame, width: int, height: int, bw: int = 4, bh: int = 4, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """keep, block_x, block_y, px: the texels of each block, row by row; edge blocks repeat the last row and column."""
    nx, ny = -(-width // bw), -(-height // bh)
    n = F.col("n")
    bx, by = (n % nx).cast("int"), F.floor(n / nx).cast("int")

    def texel(i: Column) -> Column:
        x = F.least(F.lit(width - 1), F.col("block_x") * bw + i % bw)
        y = F.least(F.lit(height - 1), F.col("block_y") * bh + F.floor(i / bw))
        return F.get("px", (y * width + x).cast("int"))

    rows = images.select(*keep, "px", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("n")).select(*keep, "px", bx.alias("block_x"), by.alias("block_y"))
    return rows.select(*keep, "block_x", "block_y", F.transform(F.sequence(F.lit(0), F.lit(bw * bh - 1)), texel).alias("px"))


def channel(name: str) -> Column:
    return F.transform("px", lambda p: p[name])


def total(values: Column) -> Column:
    return F.aggregate(values, long(0), lambda a, b: a + b)


def bc4(rows: DataFrame, channels: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """keep, and for each prefix its hi, lo, selectors: end points and 16 selectors of 3 bits.

    End points are columns of their own, so that no texel works them out again."""
    rows = rows.select(*keep, *[values.alias(f"{n}v") for n, values in channels.items()])
    rows = rows.withColumns({f"{n}{k}": f(f"{n}v") for n in channels for k, f in (("hi", F.array_max), ("lo", F.array_min))})
    return rows.select(*keep, *[c for n in channels for c in (f"{n}hi", f"{n}lo", _bc4_selectors(n).alias(f"{n}selectors"))])


def _bc4_selectors(n: str) -> Column:
    delta = F.col(f"{n}hi") - F.col(f"{n}lo")
    selectors = F.array(*[long(s) for s in BC4_SELECTORS])

    def one(v: Column, i: Column) -> Column:
        reached = sum(((v - F.col(f"{n}lo")) * 14 + 4 >= delta * k).cast("int") for k in (13, 11, 9, 7, 5, 3, 1))
        return F.get(selectors, reached) * F.pow(F.lit(8.0), i).cast("bigint")  # a shift by an expression

    return F.when(delta == 0, long(0)).otherwise(total(F.transform(f"{n}v", one)))


def eac(rows: DataFrame, values: Column, keep: tuple[str, ...]) -> DataFrame:
    """keep, base, code, selectors, error: code is multiplier * 16 + table; selectors column by column.

    Every step is its own projection, so that no texel repeats a block's work."""

    def place(i: Column) -> Column:
        return F.pow(F.lit(2.0), 45 - 12 * (i % 4) - 3 * F.floor(i / 4)).cast("bigint")

    rows = rows.select(*keep, values.alias("v")).withColumns({"hi": F.array_max("v"), "lo": F.array_min("v")})
    span = F.col("hi") - F.col("lo")
    ends, found, scored = {}, {}, {}
    for n, t in EAC_TABLES.items():
        width, up = t[7] - t[3], -t[3]
        ends[f"base{n}"] = clamp255(F.col("lo") + F.floor((span * (2 * up) + width) / (2 * width)).cast("bigint"))
        ends[f"mul{n}"] = F.least(long(15), F.greatest(long(1), F.floor((span * 2 + width) / (2 * width)).cast("bigint")))
        found[f"best{n}"] = F.transform("v", _nearest(t, F.col(f"base{n}"), F.col(f"mul{n}")))
        squares = total(F.transform(f"best{n}", lambda b: F.shiftright(b, 3) * F.shiftright(b, 3)))
        chosen = total(F.transform(f"best{n}", lambda b, i: b.bitwiseAND(7) * place(i)))
        scored[f"try{n}"] = F.struct(squares.alias("error"), long(list(EAC_TABLES).index(n)).alias("order"), F.col(f"base{n}").alias("base"), (F.col(f"mul{n}") * 16 + n).alias("code"), chosen.alias("selectors"))
    rows = rows.withColumns(ends).withColumns(found).withColumns(scored)
    rows = rows.withColumn("best", F.least(*scored))  # the least error; of equal ones the first table
    low = clamp255(F.col("hi") - 2)
    narrow = total(F.transform("v", lambda v, i: F.get(F.array(*[long(s) for s in NARROW]), (v - low + 3).cast("int")) * place(i)))
    solid = long(sum(4 << (3 * k) for k in range(16)))
    pick = lambda a, b, c: F.when(span == 0, a).when(span <= 5, b).otherwise(c)
    return rows.select(*keep, pick(F.col("lo"), low, F.col("best.base")).alias("base"), pick(long(0x0D), long(0x1D), F.col("best.code")).alias("code"), pick(solid, narrow, F.col("best.selectors")).alias("selectors"), pick(long(0), long(0), F.col("best.error")).alias("error"))


def _nearest(table: tuple[int, ...], base: Column, multiplier: Column):
    """Of a texel: least of error * 8 + selector."""

    def best(v: Column) -> Column:
        options = []
        for s, m in enumerate(table):
            value = base + multiplier * m
            options.append(F.when((v < 7) | (v > 248), F.abs(clamp255(value) - v)).otherwise(F.abs(value - v)) * 8 + s)
        return F.least(*options)

    return best


def covariance_sums(a: str, b: str) -> Column:
    """n * sum(ab) - sum(a) * sum(b): n squared times the covariance, exact."""
    return F.size("px") * total(F.transform("px", lambda p: p[a] * p[b])) - total(channel(a)) * total(channel(b))
