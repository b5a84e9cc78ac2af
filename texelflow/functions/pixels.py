"""Texel arithmetic as Column expressions. Integers are BIGINT, so ANSI overflow can't occur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ETC1 intensity modifiers, by intensity code.
ETC1_MODIFIERS = ((-8, -2, 2, 8), (-17, -5, 5, 17), (-29, -9, 9, 29), (-42, -13, 13, 42), (-60, -18, 18, 60), (-80, -24, 24, 80), (-106, -33, 33, 106), (-183, -47, 47, 183))


def long(x) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def div(a: Column, b: int) -> Column:
    """Floor division of whole numbers that aren't negative."""
    return F.floor(a / b).cast("bigint")


def clamp255(x: Column) -> Column:
    return F.least(long(255), F.greatest(long(0), x))


def scale8(v: Column, most: int) -> Column:
    """v / 255 * most, rounded."""
    t = v * most + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(scale8(r, 31), 11) + F.shiftleft(scale8(g, 63), 5) + scale8(b, 31)


def rgba4444(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.shiftleft(scale8(r, 15), 12) + F.shiftleft(scale8(g, 15), 8) + F.shiftleft(scale8(b, 15), 4) + scale8(a, 15)


def bits(x: Column, at: int, n: int) -> Column:
    return F.shiftright(x, at).bitwiseAND((1 << n) - 1)


def widen(v: Column, n: int) -> Column:
    """n bits replicated to 8."""
    return F.shiftleft(v, 8 - n) + (F.shiftright(v, 2 * n - 8) if n < 8 else long(0))


def argb_of_565(p: Column) -> Column:
    r, g, b = widen(bits(p, 11, 5), 5), widen(bits(p, 5, 6), 6), widen(bits(p, 0, 5), 5)
    return long(255 << 24) + F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def argb_of_4444(p: Column) -> Column:
    r, g, b, a = (bits(p, at, 4) * 17 for at in (12, 8, 4, 0))
    return F.shiftleft(a, 24) + F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def half_to_double(h: Column) -> Column:
    """Value of a half float's 16 bits; infinities and NaN give null."""
    sign = F.when(bits(h, 15, 1) == 1, -1.0).otherwise(1.0)
    exponent, mantissa = bits(h, 10, 5), bits(h, 0, 10)
    value = F.when(exponent == 0, mantissa * 2.0**-24).when(exponent < 31, (mantissa + 1024) * F.pow(F.lit(2.0), exponent - 25))
    return sign * value


def half_of(v: Column, cut: bool = False) -> Column:
    """16 bits of the half float next to a float: halves go up, or all is cut. Beyond range: infinity; NaN: a NaN."""
    a = F.abs(v).cast("double")
    near = F.floor(F.log2(a))
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(two(near) > a, near - 1).when(two(near + 1) <= a, near + 1).otherwise(near)  # the logarithm is rounded
    small = e < -14
    scaled = F.when(small, a * 2.0**24).otherwise((a / two(e) - 1) * 1024)
    mantissa = F.floor(scaled if cut else scaled + 0.5).cast("bigint")  # 1024 carries into the exponent
    code = F.when(F.isnan(v), 0x7C01).when(a == 0, 0).when(e > 15, 0x7C00).otherwise(F.when(small, 0).otherwise((e + 15) * 1024) + mantissa)
    return (F.when(v < 0, 0x8000).otherwise(0) + code).cast("bigint")


def rgb9e5_channel(word: Column, at: int) -> Column:
    """Value of the 9-bit mantissa at bit `at` under the shared exponent."""
    return bits(word, at, 9) * F.pow(F.lit(2.0), bits(word, 27, 5) - 24)


def etc1_colour(c5: Column, intensity: Column, selector: Column) -> Column:
    table = F.array(*[long(m) for row in ETC1_MODIFIERS for m in row])
    return clamp255(widen(c5, 5) + F.get(table, (intensity * 4 + selector).cast("int")))


def interpolate_linear(low: Column, high: Column, weight: Column) -> Column:
    """8 bits, end points widened by replication."""
    return F.shiftright(low * 257 * (64 - weight) + high * 257 * weight + 32, 14)


def interpolate_srgb(low: Column, high: Column, weight: Column) -> Column:
    """8 bits, end points widened by 0x80."""
    return F.shiftright(F.shiftright((low * 256 + 128) * (64 - weight) + (high * 256 + 128) * weight + 32, 6), 8)
