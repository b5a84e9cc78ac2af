"""Line deduplication over levelled sorted runs of line hashes, in DataFrame functions only.

A run is a written table, sorted by key within hash partitions: a row a line key with the number of documents of
the run that hold it, the largest id among them, and whether the key was new when it came. Documents come in batches.
Each batch's lines are counted by key and merge-anti-joined with the keys of the live runs: those that no run knows
are new, the others only add to what is known. Both make the batch's own run at level 0. As soon as a level has
FANOUT runs they are merged into one of the next level, so the live runs stay few. Every key is new in one run
alone, so only such rows are joined. Corpus-wide rules read the runs' merged counts.

Keys: lines with blanks and controls `[\\x20\\x09-\\x0D]` stripped at both ends, A-Z lower-cased; 128 hash bits.
A document's lines are sorted by key, not searched, so long documents take little more than proportional time.

Defined results: null and empty texts are one empty line; documents are rows, so repeated rows count each;
a null id is smaller than any other; of equal largest ids all rows keep the line; an empty table gives none.
dedup() passes extra columns on, whatever their names, but replaces columns named n_lines, n_dropped or kept_text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Renamed, Scratch, hot_keys, salted_join, text_of

FANOUT = 2
BATCHES = 4
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_keys(lines: Column) -> Column:
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(STRIPPED)))
    ascii_only = lambda x: F.octet_length(x) == F.char_length(x)
    return F.transform(bare, lambda x: F.when(ascii_only(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def long_lines(text: Column, least: int) -> Column:
    """array<struct<k1,k2,at,first>> of the text's lines of at least `least` code points, sorted by key: its hashes
    from two seeds, the line's place from 0, and whether it is the key's first one in the text."""
    hashed = F.transform(line_keys(F.split(text, "\n", -1)), lambda k, i: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), k).alias("k2"), i.alias("at"), (F.char_length(k) >= least).alias("long")))
    return _let(F.array_sort(F.filter(hashed, lambda x: x["long"])), lambda xs: F.transform(xs, lambda x, i: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["at"].alias("at"), _is_first(xs, x, i).alias("first"))))


def _is_first(xs: Column, x: Column, i: Column) -> Column:
    before = F.get(xs, i - 1)
    return (i == 0) | (before["k1"] != x["k1"]) | (before["k2"] != x["k2"])


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted places: the stretches between them, each taken once."""

    def stretch(lines: Column, j: Column) -> Column:
        begin = F.when(j == 0, 0).otherwise(F.get(gone, j - 1) + 1)
        end = F.when(j == F.size(gone), F.size(lines)).otherwise(F.get(gone, j))
        return F.when(end > begin, F.array_join(F.slice(lines, begin + 1, end - begin), "\n"))

    # array_join passes over nulls: stretches without a line
    return _let(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: stretch(lines, j)), "\n"))


class LineRuns:
    """Levelled runs in a folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = FANOUT):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def _write(self, counts: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run-{self.made}"
        return name, self.scratch.save(counts.sortWithinPartitions(*KEY), name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"), F.max("new").alias("new"))

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def known(self) -> DataFrame | None:
        """The keys of all runs, each once."""
        keys = [run.filter("new").select(*KEY) for run in self.runs()]
        out = keys[0] if keys else None
        for k in keys[1:]:
            out = out.unionByName(k)
        return out

    def new(self, lines: DataFrame) -> DataFrame:
        """The batch's lines whose key is in no run."""
        known = self.known()
        return lines if known is None else lines.join(known.hint("merge"), KEY, "left_anti")

    def add(self, lines: DataFrame) -> None:
        """lines: a row (k1, k2, id, first) for each line of the batch's documents; first: once a document and key."""
        counts = lines.groupBy(*KEY).agg(F.count(F.when(F.col("first"), 1)).alias("n_docs"), F.max("id").alias("max_id"))
        known = self.known()
        if known is None:
            marked = counts.withColumn("new", F.lit(True))
        else:  # the anti-join with both sides kept: rows that meet no key are new, the others add to a known one
            marked = counts.join(known.withColumn("old", F.lit(True)).hint("merge"), KEY, "left").withColumn("new", F.col("old").isNull()).drop("old")
        level, run = 0, self._write(marked)
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            run = self._write(self._merged([df for _, df in old]))
            for name, _ in old:
                self.scratch.drop(name)
            level += 1

    def counts(self) -> DataFrame:
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self._merged(runs)


def dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines whose key is in least_docs documents or more stay only
    in those of the largest id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    own = Renamed(docs)
    text, id_ = text_of(own.at(text_col)), F.col(own.at(id_col))
    # names of the rows: equal only for repeated rows, which lose the same lines
    named = own.df.withColumns({"d1": F.xxhash64(id_, text), "d2": F.xxhash64(F.lit(0x5BD1E995), id_, text)})
    doc = ["d1", "d2"]
    keys = named.select(F.pmod("d1", F.lit(batches)).cast("int").alias("batch"), *doc, id_.alias("id"), F.explode(long_lines(text, least_chars)).alias("k")).select("batch", *doc, "id", "k.*")
    lines = scratch.save(keys, "lines", partition_by="batch")
    runs = LineRuns(spark, scratch)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    common = scratch.save(runs.counts().filter(F.col("n_docs") >= least_docs), "common")
    hot = hot_keys(common, KEY, "n_docs", lines.count())
    # what meets a common key, except in the largest id, goes
    found = salted_join(lines.select(*doc, "id", *KEY, "at"), common.select(*KEY, "max_id"), KEY, hot, F.xxhash64(*doc))
    gone = found.filter(F.col("max_id").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("max_id"))))
    per_doc = scratch.save(gone.groupBy(*doc).agg(F.sort_array(F.collect_set("at")).alias("gone")), "gone")  # at most a document's own lines
    scratch.keep("gone")
    joined = named.join(per_doc, doc, "left")
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1).cast("bigint")
    n_dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")
    kept = F.when(F.col("gone").isNull(), text).otherwise(without(text, F.col("gone")))
    return own.back(joined, n_lines=n_lines, n_dropped=n_dropped, kept_text=kept)
