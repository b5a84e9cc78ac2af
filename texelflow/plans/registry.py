"""Registered queries and the SQL that says the same."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; only with a local master that may be
    unset. It goes when the session's process ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"{(at or tempfile.gettempdir()).rstrip('/')}/texelflow-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before its process
            place = spark._jvm.org.apache.hadoop.fs.Path(own)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(drop)
    return own


def le(x: Column | int, size: int) -> Column:
    """Hex of a whole number's bytes, lowest first."""
    x = F.lit(x) if isinstance(x, int) else x
    return F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])


def laid_out(fields: list[tuple[int, int, Column | int]], size: int) -> Column:
    """Hex of `size` bytes with the fields (offset, bytes, number) in place and zeros elsewhere."""
    out, at = [], 0
    for offset, n, value in sorted(fields, key=lambda f: f[0]):
        out += [F.lit("00" * (offset - at)), le(value, n)]
        at = offset + n
    return F.concat(*out, F.lit("00" * (size - at)))
