"""URL filter: the ratio of two character language models, in DataFrame functions only.

Host rules judge the urls they fit. The accepted and the rejected ones among these train two smoothed Markov
models of variable order over whole urls (scheme, query and fragment included, A-Z lower-cased; every character is
a symbol of its own): a character's probability after its last ORDER characters is interpolated with that after
fewer, down to the uniform one over the characters seen, each step weighted by the number of different characters
seen after that context (Witten-Bell). Contexts are those observed, so the models grow with the corpus: they are
written tables keyed by strings, added up before each shuffle; each order joins the one below. Log-ratios are
rounded to whole millionths, so that sums don't depend on their order. A url's score is the sum over its characters
divided by their number.

Calibration: judged urls whose MD5 begins with one of KEPT_OUT train nothing; the threshold is the midpoint of the
two classes' mean scores a character over these. Where a class has none it is 0, the even ratio.

Equal urls are one row of the model's work with their number, so a frequent url is no hot group; frequent grams are
salted.

Defined results: null urls are empty; empty ones score 0; urls without `://` have empty host and path, but are
scored as any other; without any judged url all others are allowed. Repeated rows count and are judged each; ties
with the threshold are allowed; long urls are cut into characters once, so they take proportional time; an empty
table gives an empty result. Extra columns are passed on, whatever their names, but columns named host, path, rule,
score or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Renamed, Scratch, hot_keys, salted_join

#: action, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
START = "\x01"
ORDER = 5
KEPT_OUT = ("0", "1", "2")
SCALE = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIDES = ("allow", "block")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, url: str, rules=RULES) -> DataFrame:
    """pages with host, path, rule and action of the longest rule that fits (host and all subdomains, path prefix),
    and shown, what the models read."""
    host, path = host_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    named, acted = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is the outermost
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        named, acted = F.when(fits, F.lit(h + p)).otherwise(named), F.when(fits, F.lit(action)).otherwise(acted)
    return rows.withColumns({"rule": named, "action": acted, "shown": F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)})


def grams(shown: Column) -> Column:
    """For each character, it and the ORDER ones before it, as one string of ORDER + 1 characters."""
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.split(shown, ""))
    cut = F.transform(F.array(padded), lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - ORDER), lambda i: F.array_join(F.slice(cs, i, ORDER + 1), "")))
    return F.get(cut, F.lit(0))


def log_ratios(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """gram, ratio: the log-ratio of accepted to rejected, in millionths, of every gram.

    counted: gram, allow, block (how often training urls have it; 0 for grams of others)."""
    kept = ORDER + 1
    alphabet = counted.select(F.substring("gram", kept, 1)).distinct().count()
    before = None
    for order in range(ORDER + 1):  # from no context to ORDER characters of it
        event = F.substring("gram", kept - order, order + 1)
        seen = counted if order == ORDER else counted.groupBy(event.alias("gram")).agg(*[F.sum(s).alias(s) for s in SIDES])
        sums = [*[F.sum(s).alias(f"{s}_total") for s in SIDES], *[F.count(F.when(F.col(s) > 0, 1)).alias(f"{s}_kinds") for s in SIDES]]
        if before is None:  # one row: no context
            whole = seen.agg(*sums).first().asDict()
            table = seen.withColumns({n: F.lit(v or 0) for n, v in whole.items()} | {f"{s}_p": F.lit(1.0) / F.lit(float(max(1, alphabet))) for s in SIDES})
        else:
            context = F.substring("gram", 1, order)
            totals = seen.groupBy(context.alias("context")).agg(*sums)
            table = seen.withColumn("context", context).join(totals, "context")  # a context is met by as many rows as there are characters
            table = table.withColumn("event", F.substring("gram", 2, order)).join(before, "event")
        p = {s: F.when(F.col(f"{s}_total") > 0, (F.col(s) + F.col(f"{s}_kinds") * F.col(f"{s}_p")) / (F.col(f"{s}_total") + F.col(f"{s}_kinds"))).otherwise(F.col(f"{s}_p")) for s in SIDES}
        if order == ORDER:
            ratio = F.round((F.log(p["allow"]) - F.log(p["block"])) * SCALE).cast("bigint")
            return scratch.save(table.select("gram", ratio.alias("ratio")), "model")
        before = scratch.save(table.select(F.col("gram").alias("event"), *[p[s].alias(f"{s}_p") for s in SIDES]), f"order-{order}")


def verdicts(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, score (per character, in millionths) and verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    own = Renamed(pages)
    rows = judged(own.df, own.at(url_col), rules)
    counts = rows.groupBy("shown", "action").agg(F.count("*").alias("n"))
    urls = scratch.save(counts.select(F.monotonically_increasing_id().alias("u"), "shown", "action", "n", F.substring(F.md5("shown"), 1, 1).isin(*KEPT_OUT).alias("kept_out")), "urls")
    places = scratch.save(urls.filter("shown != ''").select("u", "n", F.when(~F.col("kept_out"), F.col("action")).alias("side"), F.explode(grams(F.col("shown"))).alias("gram")), "places")
    counted = places.groupBy("gram").agg(F.count("*").alias("uses"), *[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in SIDES])
    counted = scratch.save(counted, "counted")
    model = log_ratios(counted, scratch)
    uses = counted.agg(F.sum("uses")).first()[0] or 0
    rated = salted_join(places.select("u", "gram"), model, ["gram"], hot_keys(counted, ["gram"], "uses", uses), F.col("u"))
    sums = scratch.save(rated.groupBy("u").agg(F.sum("ratio").alias("t"), F.count("*").alias("chars")), "sums")
    scored = urls.join(sums, "u", "left").withColumns({"t": F.coalesce("t", F.lit(0)), "chars": F.coalesce("chars", F.lit(0))})
    mean = lambda s: F.sum(F.when(F.col("action") == s, F.col("t") * F.col("n"))) / F.sum(F.when((F.col("action") == s) & (F.col("chars") > 0), F.col("chars") * F.col("n")))
    threshold = scored.filter("kept_out").agg(((mean("allow") + mean("block")) / 2).alias("threshold")).first()[0] or 0.0
    score = F.when(F.col("chars") > 0, F.col("t") / F.col("chars")).otherwise(F.lit(0.0))
    # one score a text, named by two hashes; the pages of a frequent one are spread
    key = {"h1": F.xxhash64("shown"), "h2": F.xxhash64(F.lit(0x5BD1E995), F.col("shown"))}
    scores = scratch.save(scored.withColumns(key).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max(score).alias("score")), "scores")
    scratch.keep("scores")
    hot = hot_keys(scores, ["h1", "h2"], "n", scores.agg(F.sum("n")).first()[0] or 0)
    spread = F.xxhash64(*[own.at(c) for c in own.names])
    out = salted_join(rows.withColumns(key), scores.drop("n"), ["h1", "h2"], hot, spread)
    verdict = F.coalesce("action", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return own.back(out, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), score=F.col("score"), verdict=verdict)
