"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every text is addressed by its SHA-256. The ledger, a written table, holds the findings of each (blob, rule
version) pair that was ever scanned, also of those without any. A scan takes only unseen pairs, one text a blob,
appends them, and joins findings back to all paths. Texts are scanned where they are read, but for those that
repeat or may be seen.

The registered query scans its corpus in BATCHES batches, so that later ones meet the pairs of earlier ones.

A kind's matches are found leftmost and non-overlapping: the pieces between matches and the matches alternate,
so running sums of their code points give the places. Matches that fail the kind's least length are dropped
afterwards, never skipped while matching.

Defined results: null text is empty, and stays null when masked; null and repeated paths are kept, a row each; an
empty table gives none; scan() doesn't read extra columns, without_secrets() passes them on, whatever their names;
texts of any length are scanned whole; findings that begin at the same place are in the order of the kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Renamed, Scratch, hot_keys, salted_join, text_of

#: kind, pattern, group that the least length is for, least length
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones may be passed over while matching
)
RULE_VERSION = "1"
BATCHES = 2
FOLD_BITS = 20
#: Entries of a list that is built one by one.
CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(xs: Column) -> Column:
    """The array cut in arrays of CHUNK: lists that grow one by one are copied each time, so they stay short."""
    last = F.floor((F.size(xs) - 1) / CHUNK).cast("int")
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())


_SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,end>> of the matches, in code points, end exclusive."""
    # a match alone has the same groups: the patterns look at nothing around it
    size = lambda m: F.char_length(F.regexp_extract(m, pattern, group) if group else m)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.char_length(m).alias("n"), (size(m) >= least).alias("counts")))
    rows = F.arrays_zip(found.alias("m"), F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p)).alias("p"))

    def one(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["p"]
        end = begin + x["m"]["n"]
        row = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["m"]["counts"], F.concat(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("out")), one)
        return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    # the last piece has no match after it
    whole = _let(F.filter(rows, lambda r: r["m"].isNotNull()), lambda rs: F.flatten(F.aggregate(_chunks(rs), start, chunk, lambda acc: acc["out"])))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(_SPANS))


def _of_kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def _count(k: int) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint")


def _fold(blob: Column) -> Column:
    return F.pmod(F.xxhash64(blob), F.lit(1 << FOLD_BITS)).cast("int")


def _folded(rows: DataFrame, blob: str, table: DataFrame) -> DataFrame:
    """rows with `there`: whether a blob of the table, or one of the same fold, is theirs. At most 2**FOLD_BITS folds
    are broadcast, whatever the table."""
    folds = F.broadcast(table.select(_fold(F.col("blob")).alias("fold")).distinct().withColumn("there", F.lit(True)))
    return rows.withColumn("fold", _fold(F.col(blob))).join(folds, "fold", "left").drop("fold")


class BlobLedger:
    """Findings of all blobs ever scanned, in a folder that outlives a scan; several ledgers may live in one."""

    SCHEMA = "blob string, rule_version string, found array<struct<start:bigint,kind:int,end:bigint>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, texts: DataFrame, blobs: DataFrame, scratch: Scratch, rules=RULES, version: str = RULE_VERSION) -> int:
        """Scan the texts (blob, text) whose pair with this version of the rules is unseen; the number of those seen.
        blobs: the same rows' blobs alone, from a written table.

        Blobs are counted and held against the ledger without their texts. Texts that occur once and are unseen
        are scanned where they are read; only the others (and those that share a fold with one) move, one a task."""
        seen = self.table().filter(F.col("rule_version") == version).select("blob", F.lit(True).alias("old"))
        counted = blobs.groupBy("blob").agg(F.count("*").alias("n")).join(seen, "blob", "left").filter("n > 1 or old")
        again = scratch.save(counted, f"again-{scratch.next()}")
        marked = _folded(texts, "blob", again)
        moved = marked.filter("there").groupBy("blob").agg(F.first("text").alias("text"))
        fresh = marked.filter("there is null").select("blob", "text").unionByName(moved.join(again.filter("old"), "blob", "left_anti"))
        kinds = [_of_kind(spans(F.col("text"), p, g, least), k) for k, (_, p, g, least) in enumerate(rules)]
        out = fresh.select("blob", F.lit(version).alias("rule_version"), F.array_sort(F.concat(*kinds)).alias("found"))
        out.write.mode("append").option("compression", "zstd").parquet(self.path)
        return again.filter("old").count()

    def findings(self, version: str = RULE_VERSION) -> DataFrame:
        """The blobs with findings, each once."""
        # executors that ran a lost task again can't leave a pair twice, but two scans at once could
        return self.table().filter((F.col("rule_version") == version) & (F.size("found") > 0)).groupBy("blob").agg(F.first("found").alias("found"))


def _scanned(rows: DataFrame, id_: str, text: Column, ledger: BlobLedger, scratch: Scratch, rules, version: str, batches: int) -> tuple[DataFrame, DataFrame]:
    """Add the rows' texts to the ledger in batches, each meeting what the ones before it left. Gives the rows with
    blob, and a written table of row, id and blob."""
    rows = rows.withColumn("blob", F.sha2(text, 256))
    paths = scratch.save(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"), "blob"), "paths")
    for b in range(batches):
        own = lambda df, c: df if batches == 1 else df.filter(F.pmod(F.xxhash64(c), F.lit(batches)) == b)  # noqa: B023, E731
        ledger.add(own(rows, id_).select("blob", text.alias("text")), own(paths, "id").select("blob"), scratch, rules, version)
    return rows, paths


def scan(docs: DataFrame, ledger: BlobLedger | None = None, rules=RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row for each of docs: id, blob, found (array of start, kind's index, end)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    own = Renamed(docs)
    id_ = own.at(id_col)
    ledger = ledger or BlobLedger(spark, scratch.path("ledger"))
    _, paths = _scanned(own.df, id_, text_of(own.at(text_col)), ledger, scratch, rules, version, batches)
    hot = hot_keys(paths.groupBy("blob").agg(F.count("*").alias("n")), ["blob"], "n", paths.count())
    scratch.keep("paths")
    out = salted_join(paths, ledger.findings(version), ["blob"], hot, F.col("row"), "left")
    return out.select(F.col("id").alias(id_col), "blob", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def digest(found: DataFrame, rules=RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, and the spans as kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    said = F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))
    counts = [_count(k).alias(f"n_{r[0]}") for k, r in enumerate(rules)]
    return found.select(id_col, *counts, F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))


def without_secrets(docs: DataFrame, ledger: BlobLedger | None = None, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each finding's code points replaced by mask, by way of the ledger; rows and other columns stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    ledger = ledger or BlobLedger(spark, scratch.path("ledger"))
    own = Renamed(docs)
    text = own.at(text_col)
    rows, _ = _scanned(own.df, own.at(id_col), text_of(text), ledger, scratch, RULES, RULE_VERSION, 1)
    cuts = scratch.save(ledger.findings().select("blob", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("found")), "cuts")
    marked = _folded(rows, "blob", cuts)
    some = marked.filter("there").drop("there")  # rows without a finding don't move
    sizes = scratch.save(some.groupBy("blob").agg(F.count("*").alias("n")), "sizes")
    hot = hot_keys(sizes, ["blob"], "n", sizes.agg(F.sum("n")).first()[0] or 0)
    scratch.keep("cuts", "sizes")
    found = salted_join(some, cuts, ["blob"], hot, F.xxhash64(own.at(id_col), F.rand(1)), "left")
    masked = F.when(F.size("found") > 0, _masked(F.col(text), F.col("found"), mask)).otherwise(F.col(text))
    return own.back(found.withColumn(text, masked)).unionByName(own.back(marked.filter("there is null")))


def _masked(text: Column, found: Column, mask: str) -> Column:
    """The text with the code points of the spans, sorted by start, replaced; spans that overlap by one mask."""

    def one(acc: Column, x: Column, near: Column, base: Column) -> Column:
        piece = F.substring(near, (acc["at"] - base + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(piece, F.lit(mask)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    def chunk(acc: Column, xs: Column) -> Column:
        # the text from the end of the last chunk to this chunk's last span, taken once
        reach = F.greatest(F.array_max(F.transform(xs, lambda x: x["start"])) - acc["at"], F.lit(0)).cast("int")
        near = F.substring(text, (acc["at"] + 1).cast("int"), reach)
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        own = _let(near, lambda t: F.aggregate(xs, start, lambda a, x: one(a, x, t, acc["at"])))
        return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(F.concat_ws("", o["out"]))).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.aggregate(_chunks(found), start, chunk, rest)
