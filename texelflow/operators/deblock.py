"""Deblocking of whole images, held as arrays of texels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.pixels import div

CHANNELS = ("r", "g", "b", "a")


def _pass(px: str, width: int, height: int, size: int, vertical: bool, strong: bool) -> Column:
    step, extent = (width, height) if vertical else (1, width)
    limit = 48 if strong else 24

    def one(p: Column, i: Column) -> Column:
        at = F.floor(i / width).cast("int") if vertical else i % width
        before = (at % size == size - 1) & (at + 1 < extent)  # p lies just before an edge
        after = (at % size == 0) & (at > 0)
        here = i.cast("int")
        other = F.get(px, F.when(before, here + step).otherwise(F.when(after, here - step).otherwise(here)))
        far = F.get(px, F.when(before, F.when(at > 0, here - step).otherwise(here)).otherwise(F.when(after & (at + 1 < extent), here + step).otherwise(here)))
        steep = F.greatest(*[F.abs(p[c] - other[c]) for c in CHANNELS]) > limit
        mixed = [div(3 * p[c] + 2 * other[c] + far[c] + 3, 6) if strong else div(5 * p[c] + 2 * other[c] + far[c] + 4, 8) for c in CHANNELS]
        return F.when((before | after) & ~steep, F.struct(*[m.alias(c) for m, c in zip(mixed, CHANNELS, strict=True)])).otherwise(p)

    return F.transform(px, one)


def deblocked(images, width: int, height: int, bw: int = 4, bh: int = 4, strong: bool = False):
    """images with px filtered across vertical edges, then, on that result, across horizontal ones."""
    return images.withColumn("px", _pass("px", width, height, bw, False, strong)).withColumn("px", _pass("px", width, height, bh, True, strong))
