"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns:
what each operator and each stage of the pipeline makes of them."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from texelflow.llm import bpe, exact_dedup, line_dedup, minhash, packing, quality, secret_scan, suffix_dedup

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves, or might.
CLASH = ["id", "row", "doc", "d1", "d2", "gone", "blob", "found", "there", "fold", "n", "gram", "at", "sig", "label", "c0", "c1", "__row", "__doc", "__hot", "__salt", "part", "bits", "rest", "spans", "kept", "batch"]


@pytest.fixture(scope="module")
def clashing(odd):
    """odd with columns of all these names, each with its row's text length in it."""
    return odd.drop("id").select("*", *[F.length("text").cast("string").alias(c) for c in CLASH])


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


OPERATORS = {
    "packing": lambda d: packing.pack(d).select("doc_id", "length", "doc_tokens", "ids_crc32").groupBy("doc_id").agg(F.sum("length")),
    "exact": lambda d: exact_dedup.groups(d, digest=True).select("keep_id", "group_size", "kept", "digest"),
    "quality": lambda d: quality.scored(d, MODEL[0]),
    "lines": lambda d: line_dedup.dedup(d, least_chars=3, least_docs=2).select("doc_id", "n_lines", "n_dropped", "kept_text"),
    "near": lambda d: minhash.near_duplicates(d).select("class_id", "class_size", "kept"),
    "secrets": lambda d: secret_scan.digest(secret_scan.scan(d)),
    "suffixes": lambda d: suffix_dedup.dedup(d),
    "bpe": lambda d: bpe.encode_decode(d),
}
MODEL = []


@pytest.fixture(scope="module", autouse=True)
def model(spark):
    MODEL[:] = [quality.fit(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_extra_columns_change_nothing(name, odd, clashing, empty):
    apply = OPERATORS[name]
    assert plain(apply(clashing).collect()) == plain(apply(odd.select("doc_id", "text")).collect())
    assert apply(clashing.limit(0)).count() == apply(empty).count() == 0


KEEPERS = {
    "exact": exact_dedup.keep_one,
    "near": minhash.keep_one,
    "secrets": secret_scan.without_secrets,
    "lines": lambda d: line_dedup.dedup(d).drop("n_lines", "n_dropped", "kept_text"),
    "quality": lambda d: quality.accepted(d, MODEL[0], least=0.0),
}


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_extra_columns_are_passed_on(name, clashing):
    out = KEEPERS[name](clashing)
    assert out.columns == clashing.columns
    allowed = collections.Counter(plain(clashing.collect()))
    got = collections.Counter(plain(out.collect()))
    assert got and not got - allowed
    if name in ("secrets", "lines", "quality"):
        assert got == allowed


def test_a_null_id_is_not_the_string_null(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), ("null", "a b c d e f"), ("null", "x"), (None, "x")], "doc_id string, text string")
    for keep in (exact_dedup.keep_one, minhash.keep_one):
        assert plain(keep(docs).collect()) == [("null", "a b c d e f"), ("null", "x")]


def test_one_very_long_text(spark):
    """A text far longer than any group or batch that the operators form."""
    line = "the quick brown fox jumps over the lazy dog and says token=abcdef123 "
    long = "\n".join(f"{line}{k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long[: len(long) // 2]), (3, None)], "doc_id bigint, text string")
    n = {1: len(long), 2: len(long) // 2, 3: 0}
    assert {r["doc_id"]: r["n_bytes"] for r in suffix_dedup.dedup(docs, with_text=False).collect()} == n
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.digest(secret_scan.scan(docs)).collect()} == {1: 30_000, 2: long[: n[2]].count("token=abcdef123"), 3: 0}
    assert {r["doc_id"]: r["n_lines"] for r in line_dedup.dedup(docs).collect()} == {1: 30_000, 2: long[: n[2]].count("\n") + 1, 3: 1}
    assert bpe.decode(bpe.encode_decode(docs)).filter("doc_id = 1").first()["bytes"].decode() == long
    assert [r["class_size"] for r in minhash.near_duplicates(docs).collect()] == [1, 1, 1]


def stage_input(odd):
    return odd.drop("id").withColumns({"lang": F.when(F.col("doc_id") > 3, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), "row": F.lit(1), "doc": F.lit("x")})


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, k):
    docs = stage_input(odd)
    name, stage = corpus_pipeline.STAGES[k]
    out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == out.columns
    rows = out.collect()
    if k == 4:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
        return
    assert out.columns == corpus_pipeline.COLUMNS
    allowed = collections.Counter(plain(docs.select(corpus_pipeline.COLUMNS).collect()))
    assert not collections.Counter(plain(rows)) - allowed  # no row is invented or changed: none holds a secret
    texts = {r["text"] or "" for r in docs.collect()}
    if name == "exact dedup":
        assert sorted(r["text"] or "" for r in rows) == sorted(texts)
    if name == "near dedup":
        assert len(rows) == 5  # null, empty and blank texts are one class, the two long ones another
    if name == "secret scans":
        assert len(rows) == docs.count()
