"""Shared pieces: written intermediate tables, skew-safe joins, batched Python calls."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: whichever comes first ends it, so long documents don't add up in a worker.
ARROW_ROWS, ARROW_BYTES = 400, 4 << 20
#: A key is hot when it holds at least 1 / HOT_SHARE of the rows: so at most HOT_SHARE keys are hot.
HOT_SHARE = 4096
HOT_LEAST = 200
SALTS = 64


def tuned(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole documents within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that all executors share. Only with a local master, where driver and
    executors are one process, an unset one is replaced by a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "texelflow-checkpoints")


class Scratch:
    """Written tables under the shared folder; drop() removes one, the rest go when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/texelflow-{name}-{uuid.uuid4().hex}"
        self.numbers = itertools.count()
        self.saved: set[str] = set()
        atexit.register(self.drop)

    def next(self) -> int:
        return next(self.numbers)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, partition_by: str | None = None) -> DataFrame:
        self.saved.add(table)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def keep(self, *tables: str) -> None:
        """Remove all tables but these, that a result still reads."""
        for table in self.saved - set(tables):
            self.drop(table)
        self.saved &= set(tables)

    def drop(self, table: str = "") -> None:
        with contextlib.suppress(Exception):  # the session may have ended before its process
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}" if table else self.root)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class Renamed:
    """A table with its columns renamed c0, c1, ...: an operator's own columns, that have other names, can't clash
    with any. back() gives the names back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {', '.join(self.names)}")
        return f"c{found[0]}"

    def back(self, df: DataFrame, **more: Column) -> DataFrame:
        """The table's columns under their names, those in `more` replaced or added at the end."""
        new = {n.lower() for n in more}
        old = {f"c{i}": n for i, n in enumerate(self.names) if n.lower() not in new}
        # names last: an alias in the same list would hide a column of that name
        return df.select(*old, *[v.alias(f"m{i}") for i, v in enumerate(more.values())]).toDF(*old.values(), *more)


def hot_keys(counts: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """Keys that hold at least total / HOT_SHARE rows; as their counts add up to total, there are at most HOT_SHARE."""
    return counts.filter(F.col(n) >= max(HOT_LEAST, total // HOT_SHARE)).select(*key)


def salted_join(rows: DataFrame, table: DataFrame, key: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """rows join table, that has one row a key. Rows of the hot keys (a bounded list) are spread over SALTS
    partitions and only those keys' table rows are repeated, so no task gets a whole hot group."""
    mark = F.broadcast(hot.select(*[F.col(k).alias(f"__{k}") for k in key], F.lit(True).alias("__hot")))

    def marked(df: DataFrame) -> DataFrame:
        on = [F.col(k) == F.col(f"__{k}") for k in key]
        return df.join(mark, on, "left").drop(*[f"__{k}" for k in key])

    left = marked(rows).withColumn("__salt", F.when(F.col("__hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked(table).withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [*key, "__salt"], how).drop("__salt")


def release() -> None:
    """Give freed memory back to the system: workers live on after a task and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    tuned(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Lists of rows are broadcast up to this count, else joined by a shuffle.
BROADCAST_ROWS = 200_000


def if_small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most BROADCAST_ROWS rows; else it's shuffled."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and whole text, however often the table is read; equal only for repeated rows. A null
    id gives no first part, another one a part that ends in a mark, so a null isn't the string null."""
    return F.concat(F.coalesce(F.concat(F.col(id_col).cast("string"), F.lit(":")), F.lit("")), F.sha2(text_of(text_col), 224))


def keep_decided(docs: DataFrame, decided: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that `decided` (doc: a row_key, kept) drops; rows it doesn't name stay. A repeated
    row of which one stays is left once. Columns of docs may have any name."""
    per_key = decided.groupBy("doc").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    gone = scratch.save(per_key.filter("not kept or n > 1"), "gone")
    own = Renamed(docs)
    rows = own.df.withColumn("doc", row_key(own.at(id_col), own.at(text_col)))
    again = gone.filter("kept and n > 1")
    scratch.keep("gone")
    out = own.back(rows.join(if_small(gone), "doc", "left_anti"))
    if again.isEmpty():
        return out
    once = rows.join(again, "doc", "left_semi").dropDuplicates(["doc"])  # a partial first() before the shuffle
    return out.unionByName(own.back(once))
