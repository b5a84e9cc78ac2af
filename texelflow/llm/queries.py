"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, minhash, packing, quality, secret_scan, suffix_dedup, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=1024, with_ids=False)


def op2_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"), digest=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=40, least_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op8_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), window=200, with_text=False)


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_packing, op2_progressive_exact_dedup, op3_ftrl_quality, op4_url_language_models, op5_voronoi_top_k, op6_line_runs, op7_dart_minhash, op8_blob_ledger_secrets, op9_suffix_dedup, op10_tree_bpe)}

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql() -> str:
    """The same counts, interpolation, rounding and calibration as url_filter."""
    k = url_filter.ORDER + 1
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    when = lambda out: " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{out(act, h, p)}'" for act, h, p in rules)
    orders, last = "", "(SELECT '' AS e, 1.0::DOUBLE / (SELECT count(DISTINCT right(gram, 1)) FROM c) AS pa, 1.0::DOUBLE / (SELECT count(DISTINCT right(gram, 1)) FROM c) AS pb)"
    for order in range(k):
        step = lambda s: f"CASE WHEN t{s} > 0 THEN (s.{s} + k{s} * l.p{s}) / (t{s} + k{s}) ELSE l.p{s} END AS p{s}"
        orders += f"""
, s{order} AS (SELECT right(gram, {order + 1}) AS e, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM c GROUP BY 1)
, x{order} AS (SELECT left(e, {order}) AS x, sum(a)::BIGINT AS ta, sum(b)::BIGINT AS tb, count(*) FILTER (a > 0) AS ka, count(*) FILTER (b > 0) AS kb FROM s{order} GROUP BY 1)
, p{order} AS (SELECT s.e, {step("a")}, {step("b")} FROM s{order} s JOIN x{order} ON left(s.e, {order}) = x JOIN {last} l ON right(s.e, {order}) = l.e)"""
        last = f"p{order}"
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
, hp AS (SELECT page_id, row_number() OVER () AS rn, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, translate(coalesce(url, ''), {_UPPER}) AS shown FROM u)
, ruled AS (SELECT *, CASE {when(lambda act, h, p: h + p)} END AS rule, CASE {when(lambda act, h, p: act)} END AS action, substr(md5(shown), 1, 1) IN ({", ".join(f"'{x}'" for x in url_filter.KEPT_OUT)}) AS kept_out FROM hp)
, g AS MATERIALIZED (SELECT rn, action, kept_out, substr(repeat(chr({ord(url_filter.START)}), {k - 1}) || shown, i, {k}) AS gram FROM (SELECT *, unnest(generate_series(1, length(shown))) AS i FROM ruled))
, c AS MATERIALIZED (SELECT gram, count(*) FILTER (NOT kept_out AND action = 'allow') AS a, count(*) FILTER (NOT kept_out AND action = 'block') AS b FROM g GROUP BY 1){orders}
, m AS (SELECT e AS gram, round((ln(pa) - ln(pb)) * {url_filter.SCALE})::BIGINT AS r FROM {last})
, t AS (SELECT rn, any_value(action) AS action, any_value(kept_out) AS kept_out, sum(r)::BIGINT AS t, count(*) AS n FROM g JOIN m USING (gram) GROUP BY 1)
, th AS (SELECT coalesce((sum(t) FILTER (action = 'allow') / sum(n) FILTER (action = 'allow') + sum(t) FILTER (action = 'block') / sum(n) FILTER (action = 'block')) / 2, 0) AS threshold FROM t WHERE kept_out)
SELECT page_id, host, path, rule, coalesce(ruled.action, CASE WHEN coalesce(t.t / t.n, 0) >= (SELECT threshold FROM th) THEN 'allow' ELSE 'block' END) AS verdict FROM ruled LEFT JOIN t USING (rn)
"""


def _secrets_sql() -> str:
    """The base rules by DuckDB's own expressions: matches and the pieces between them alternate."""
    quotes = "[\"''\"]?"  # a single quote is doubled in SQL
    rules = (("assign", f"(?i:password|passwd|secret|token|api_?key){quotes}\\x20*[:=]\\x20*{quotes}([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    found = " UNION ALL ".join(
        f"SELECT rn, '{kind}' AS kind, {k} AS ord, {least} AS least, unnest(generate_series(1, len(regexp_extract_all(t, '{p}')))) AS i, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {g})) AS g, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS piece FROM d"
        for k, (kind, p, g, least) in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found})
, e AS (SELECT *, sum(length(piece) + length(m)) OVER (PARTITION BY rn, ord ORDER BY i) AS stop FROM f)
, s AS (SELECT rn, kind, ord, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM e WHERE length(g) >= least)
, a AS (SELECT rn, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rn)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rn)"""


#: All strings of 200 bytes, one by one: those found twice, what they cover, and the bytes between.
_REPEATS_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n FROM d)
, w AS MATERIALIZED (SELECT rn, s, array_slice(b, s + 1, s + 200) AS x FROM (SELECT rn, b, unnest(range(0, n - 199)) AS s FROM n WHERE n >= 200))
, r AS (SELECT rn, s FROM w SEMI JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) USING (x))
, m AS (SELECT rn, s, coalesce(s - lag(s) OVER p > 200, true)::INT AS begins FROM r WINDOW p AS (PARTITION BY rn ORDER BY s))
, g AS (SELECT rn, s, sum(begins) OVER (PARTITION BY rn ORDER BY s) AS run FROM m)
, c AS (SELECT rn, run, min(s) AS a, max(s) + 200 AS z FROM g GROUP BY rn, run)
, l AS (SELECT rn, sum(z - a)::BIGINT AS removed, count(*) AS spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM c GROUP BY rn)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(CASE WHEN spans IS NULL THEN b ELSE list_reduce([array_slice(b, CASE WHEN i = 0 THEN 1 ELSE z[i] + 1 END, CASE WHEN i = len(a) THEN n ELSE a[i + 1] END) for i in range(len(a) + 1)], lambda p, q: p || q) END) AS kept_sha256 FROM n LEFT JOIN l USING (rn)"""


#: Sets of five words, their shared members, links, and all that links lead to.
_NEAR_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER}), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents)
, s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS g FROM d WHERE len(w) > 0)
, n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
, l AS MATERIALIZED (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE c >= 0.8 * (i.n + j.n - c) UNION ALL SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) FROM d WHERE len(w) = 0)
, e AS MATERIALIZED (SELECT x, y FROM l WHERE y IS NOT NULL UNION ALL SELECT y, x FROM l WHERE y IS NOT NULL)
, r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT doc_id, max(other) AS class_id, count(*) AS class_size, doc_id = max(other) AS kept FROM r GROUP BY doc_id"""


ORACLES: dict[str, str] = {
    "op7_dart_minhash": _NEAR_SQL,
    "op9_suffix_dedup": _REPEATS_SQL,
    "op8_blob_ledger_secrets": _secrets_sql(),
    "op2_progressive_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_url_language_models": _url_sql(),
    "op5_voronoi_top_k": """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT::DOUBLE for x in embedding] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 10""",
    "op6_line_runs": f"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, {_STRIP}), {_UPPER}) AS key FROM (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))
, k AS (SELECT key, max(doc_id) AS keep_id FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
, m AS (SELECT l.*, k.key IS NOT NULL AND doc_id < keep_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
