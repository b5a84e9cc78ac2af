"""Queries of the texture operators over integer texel relations that are derived from the driver's tables.

Each docstring names what it shows. An embedding of 64 numbers is an image of 8 x 8 texels; the other relations
are whole-number arithmetic on keys. The SQL says the same by joining and grouping single texels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import blocks as B
from ..operators import deblock, geometry, slices
from . import catalog
from .registry import ORACLES, QUERIES, query, table
from .registry import le as _le


def images(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, px: 64 texels (r, g, b, a), row by row."""
    rows = table(spark, sf, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")
    v = F.transform("embedding", lambda e: P.clamp255(F.floor(e.cast("double") * 255).cast("bigint") + 128))
    texel = lambda v, i: F.struct(v.alias("r"), ((v * 3 + i) % 256).alias("g"), ((v * 5 + i * 7) % 256).alias("b"), (255 - v % 128).alias("a"))
    return rows.select("vec_id", F.transform(v, texel).alias("px"))


def texels(spark: SparkSession, sf: str) -> DataFrame:
    rows = images(spark, sf).select("vec_id", F.posexplode_outer("px").alias("i", "p"))
    return rows.select("vec_id", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"), "p.*")


PX = """px AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, v AS r, (v * 3 + i) % 256 AS g, (v * 5 + i * 7) % 256 AS b, 255 - v % 128 AS a FROM (
SELECT vec_id, unnest(generate_series(0, 63)) AS i, unnest([least(255, greatest(0, floor(e::DOUBLE * 255)::BIGINT + 128)) for e in embedding]) AS v FROM embeddings WHERE len(embedding) = 64))"""
S8 = lambda c, m: f"((({c} * {m} + 128) + (({c} * {m} + 128) >> 8)) >> 8)"
BLK = "vec_id, (x // 4)::INTEGER AS block_x, (y // 4)::INTEGER AS block_y"


@query(f"WITH {PX} SELECT vec_id, x, y, {S8('r', 31)} * 2048 + {S8('g', 63)} * 32 + {S8('b', 31)} AS packed FROM px")
def pack_rgb565(spark, sf):
    """Projection P1."""
    return texels(spark, sf).select("vec_id", "x", "y", P.rgb565(F.col("r"), F.col("g"), F.col("b")).alias("packed"))


@query(f"WITH {PX} SELECT vec_id, x, y, {S8('b', 31)} * 2048 + {S8('g', 63)} * 32 + {S8('r', 31)} AS packed FROM px")
def pack_bgr565(spark, sf):
    """Projection P1."""
    return texels(spark, sf).select("vec_id", "x", "y", P.rgb565(F.col("b"), F.col("g"), F.col("r")).alias("packed"))


@query(f"WITH {PX} SELECT vec_id, x, y, {S8('r', 15)} * 4096 + {S8('g', 15)} * 256 + {S8('b', 15)} * 16 + {S8('a', 15)} AS packed FROM px")
def pack_rgba4444(spark, sf):
    """Projection P1."""
    return texels(spark, sf).select("vec_id", "x", "y", P.rgba4444(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("packed"))


@query("""WITH t AS (SELECT event_id, (event_id * 40503 + 12345) % 65536 AS p FROM events), c AS (SELECT event_id, p, p >> 11 AS r, (p >> 5) & 63 AS g, p & 31 AS b FROM t)
SELECT event_id, 255::BIGINT * 16777216 + ((r << 3) + (r >> 2)) * 65536 + ((g << 2) + (g >> 4)) * 256 + ((b << 3) + (b >> 2)) AS argb565,
(p & 15) * 17 * 16777216 + (p >> 12) * 17 * 65536 + ((p >> 8) & 15) * 17 * 256 + ((p >> 4) & 15) * 17 AS argb4444 FROM c""")
def unpack_argb(spark, sf):
    """Projection P2: 16-bit texels shown as ARGB."""
    p = (F.col("event_id") * 40503 + 12345) % 65536
    return table(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", P.argb_of_565(F.col("p")).alias("argb565"), P.argb_of_4444(F.col("p")).alias("argb4444"))


@query("""WITH t AS (SELECT event_id, (event_id * 7919) % 65536 AS h, (event_id * 2654435761) % 4294967296 AS w FROM events), f AS (SELECT *, (h >> 10) & 31 AS e, h & 1023 AS m FROM t)
SELECT event_id, (CASE WHEN h >= 32768 THEN -1.0 ELSE 1.0 END)::DOUBLE * CASE WHEN e = 0 THEN m * pow(2.0, -24) WHEN e < 31 THEN (m + 1024) * pow(2.0, e - 25) END AS half,
(w & 511) * pow(2.0, (w >> 27) - 24) AS red FROM f""")
def unpack_float(spark, sf):
    """Projection P3: half floats and shared-exponent texels."""
    rows = table(spark, sf, "events").select("event_id", ((F.col("event_id") * 7919) % 65536).alias("h"), ((F.col("event_id") * 2654435761) % 4294967296).alias("w"))
    return rows.select("event_id", P.half_to_double(F.col("h")).alias("half"), P.rgb9e5_channel(F.col("w"), 0).alias("red"))


def _bc4_sql(c: str) -> str:
    reached = " + ".join(f"(({c} - lo) * 14 + 4 >= (hi - lo) * {k})::INT" for k in (13, 11, 9, 7, 5, 3, 1))
    return f"SELECT vec_id, block_x, block_y, any_value(hi) AS hi, any_value(lo) AS lo, sum(CASE WHEN hi = lo THEN 0 ELSE [1, 7, 6, 5, 4, 3, 2, 0][1 + {reached}] * (8 ** (y % 4 * 4 + x % 4))::BIGINT END)::BIGINT AS selectors FROM (SELECT *, max({c}) OVER w AS hi, min({c}) OVER w AS lo FROM (SELECT *, (x // 4)::INTEGER AS block_x, (y // 4)::INTEGER AS block_y FROM px) WINDOW w AS (PARTITION BY vec_id, block_x, block_y)) GROUP BY 1, 2, 3"


@query(f"WITH {PX} {_bc4_sql('r')}")
def bc4_block(spark, sf):
    """Aggregates A1 and A13: a block's end points and packed selectors."""
    return B.bc4(B.blocks(images(spark, sf), 8, 8), {"": B.channel("r")}, ("vec_id", "block_x", "block_y"))


@query(f"WITH {PX}, q AS ({_bc4_sql('r')}), z AS ({_bc4_sql('a')}) SELECT vec_id, block_x, block_y, q.hi AS r_hi, q.lo AS r_lo, q.selectors AS r_selectors, z.hi AS a_hi, z.lo AS a_lo, z.selectors AS a_selectors FROM q JOIN z USING (vec_id, block_x, block_y)")
def bc5_block(spark, sf):
    """Join J6: red and alpha blocks side by side."""
    return B.bc4(B.blocks(images(spark, sf), 8, 8), {"r_": B.channel("r"), "a_": B.channel("a")}, ("vec_id", "block_x", "block_y"))


def _eac_sql() -> str:
    tables = ", ".join(f"({n}, {k}, {list(t)})" for k, (n, t) in enumerate(B.EAC_TABLES.items()))
    return f"""WITH {PX}, b AS (SELECT {BLK}, x % 4 AS tx, y % 4 AS ty, r AS v FROM px), m AS (SELECT *, max(v) OVER w AS hi, min(v) OVER w AS lo FROM b WINDOW w AS (PARTITION BY vec_id, block_x, block_y))
, t(num, ord, tab) AS (VALUES {tables})
, e AS (SELECT m.*, num, ord, tab, tab[8] - tab[4] AS wide, hi - lo AS span FROM m, t)
, f AS (SELECT *, least(255, greatest(0, lo + (span * 2 * -tab[4] + wide) // (2 * wide))) AS base, least(15, greatest(1, (span * 2 + wide) // (2 * wide))) AS mul FROM e)
, s AS (SELECT f.* EXCLUDE (tab), k, base + mul * tab[k + 1] AS raw FROM f, (SELECT unnest(generate_series(0, 7)) AS k))
, c AS (SELECT vec_id, block_x, block_y, tx, ty, any_value(v) AS v, any_value(hi) AS hi, any_value(lo) AS lo, num, ord, any_value(base) AS base, any_value(mul) AS mul, min(abs(CASE WHEN v < 7 OR v > 248 THEN least(255, greatest(0, raw)) ELSE raw END - v) * 8 + k) AS best FROM s GROUP BY vec_id, block_x, block_y, tx, ty, num, ord)
, g AS (SELECT vec_id, block_x, block_y, any_value(hi) AS hi, any_value(lo) AS lo, num, ord, any_value(base) AS base, any_value(mul) * 16 + num AS code, sum((best >> 3) * (best >> 3)) AS error, sum((best & 7) * (2 ** (45 - 12 * tx - 3 * ty))::BIGINT) AS selectors,
 sum(CASE WHEN hi - lo BETWEEN 1 AND 5 THEN [2, 1, 0, 4, 5, 6][v - greatest(0, hi - 2) + 4] ELSE 4 END * (2 ** (45 - 12 * tx - 3 * ty))::BIGINT) AS other FROM c GROUP BY vec_id, block_x, block_y, num, ord)
, h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY vec_id, block_x, block_y ORDER BY error, ord) = 1)
SELECT vec_id, block_x, block_y, (CASE WHEN hi = lo THEN lo WHEN hi - lo <= 5 THEN greatest(0, hi - 2) ELSE base END)::BIGINT AS base, (CASE WHEN hi = lo THEN 13 WHEN hi - lo <= 5 THEN 29 ELSE code END)::BIGINT AS code, (CASE WHEN hi - lo <= 5 THEN other ELSE selectors END)::BIGINT AS selectors, (CASE WHEN hi - lo <= 5 THEN 0 ELSE error END)::BIGINT AS error FROM h"""


@query(_eac_sql())
def eac_r11_block(spark, sf):
    """Aggregates A6 to A8: least packed error per texel, best table, summed error."""
    return B.eac(B.blocks(images(spark, sf), 8, 8), B.channel("r"), ("vec_id", "block_x", "block_y"))


@query(f"WITH {PX} SELECT {BLK}, (16 * sum(r * g) - sum(r) * sum(g))::BIGINT AS rg, (16 * sum(g * b) - sum(g) * sum(b))::BIGINT AS gb, (16 * sum(r * r) - sum(r) * sum(r))::BIGINT AS rr, sum(r)::BIGINT AS r_sum FROM px GROUP BY ALL")
def block_covariance(spark, sf):
    """Aggregates A2 and A3: sums and exact covariances of a block."""
    return B.blocks(images(spark, sf), 8, 8).select("vec_id", "block_x", "block_y", B.covariance_sums("r", "g").alias("rg"), B.covariance_sums("g", "b").alias("gb"), B.covariance_sums("r", "r").alias("rr"), B.total(B.channel("r")).alias("r_sum"))


@query(f"WITH {PX} SELECT {BLK}, min((r + 64) // 128) = max((r + 64) // 128) AS solid, min(CASE WHEN r < 50 THEN 250 ELSE 255 END) = 255 AS opaque FROM px GROUP BY ALL")
def solid_block_test(spark, sf):
    """Predicate F8."""
    coarse = F.transform("px", lambda p: P.div(p["r"] + 64, 128))
    alpha = F.transform("px", lambda p: F.when(p["r"] < 50, 250).otherwise(255))
    return B.blocks(images(spark, sf), 8, 8).select("vec_id", "block_x", "block_y", (F.array_min(coarse) == F.array_max(coarse)).alias("solid"), (F.array_min(alpha) == 255).alias("opaque"))


def _deblock_sql(strong: bool) -> str:
    limit, mix = (48, "(3 * p.{c} + 2 * q.{c} + f.{c} + 3) // 6") if strong else (24, "(5 * p.{c} + 2 * q.{c} + f.{c} + 4) // 8")

    def one(src: str, dst: str, k: str, other: str) -> str:
        steep = " OR ".join(f"abs(p.{c} - q.{c}) > {limit}" for c in "rgba")
        cols = ", ".join(f"CASE WHEN p.{k} NOT IN (3, 4) OR {steep} THEN p.{c} ELSE {mix.format(c=c)} END AS {c}" for c in "rgba")
        return f"{dst} AS (SELECT p.vec_id, p.x, p.y, {cols} FROM {src} p LEFT JOIN {src} q ON q.vec_id = p.vec_id AND q.{other} = p.{other} AND q.{k} = 7 - p.{k} LEFT JOIN {src} f ON f.vec_id = p.vec_id AND f.{other} = p.{other} AND f.{k} = CASE WHEN p.{k} = 3 THEN 2 ELSE 5 END)"

    return f"WITH {PX}, {one('px', 'h', 'x', 'y')}, {one('h', 'v', 'y', 'x')} SELECT vec_id, x, y, r, g, b, a FROM v"


def _deblock(spark, sf, strong):
    rows = deblock.deblocked(images(spark, sf), 8, 8, strong=strong).select("vec_id", F.posexplode_outer("px").alias("i", "p"))
    return rows.select("vec_id", (F.col("i") % 8).cast("bigint").alias("x"), F.floor(F.col("i") / 8).alias("y"), "p.*")


@query(_deblock_sql(False))
def deblock_weak(spark, sf):
    """Windows W1 to W3 and predicate F7."""
    return _deblock(spark, sf, False)


@query(_deblock_sql(True))
def deblock_strong(spark, sf):
    """Windows W1 to W3 and predicate F7."""
    return _deblock(spark, sf, True)


@query("""WITH p AS (SELECT p_partkey AS idx, p_partkey % 32 AS r5, (p_partkey * 5 + p_size) % 32 AS g5, p_size % 32 AS b5, p_partkey % 8 AS inten FROM part)
, m(inten, mods) AS (VALUES (0, [-8, -2, 2, 8]), (1, [-17, -5, 5, 17]), (2, [-29, -9, 9, 29]), (3, [-42, -13, 13, 42]), (4, [-60, -18, 18, 60]), (5, [-80, -24, 24, 80]), (6, [-106, -33, 33, 106]), (7, [-183, -47, 47, 183]))
, o AS (SELECT o_orderkey, o_orderkey % 211 AS idx, (o_custkey // 4) % 4 AS sel FROM orders)
SELECT o_orderkey, idx AS endpoint, sel AS selector, CASE WHEN r5 IS NOT NULL THEN least(255, greatest(0, (r5 << 3) + (r5 >> 2) + mods[sel + 1])) END AS r, CASE WHEN g5 IS NOT NULL THEN least(255, greatest(0, (g5 << 3) + (g5 >> 2) + mods[sel + 1])) END AS g, CASE WHEN b5 IS NOT NULL THEN least(255, greatest(0, (b5 << 3) + (b5 >> 2) + mods[sel + 1])) END AS b FROM o LEFT JOIN (p JOIN m USING (inten)) USING (idx)""")
def etc1s_palette_decode(spark, sf):
    """Join J3 and projection P7: blocks look up their end points; null colours are invalid indexes."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    palette = table(spark, sf, "part").select(k.alias("endpoint"), (k % 32).alias("r5"), ((k * 5 + s) % 32).alias("g5"), (s % 32).alias("b5"), (k % 8).alias("inten"))
    blocks = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 211).alias("endpoint"), (F.floor(F.col("o_custkey") / 4) % 4).alias("selector"))
    joined = blocks.join(palette, "endpoint", "left")
    return joined.select("o_orderkey", "endpoint", "selector", *[F.when(F.col("inten").isNotNull(), P.etc1_colour(F.col(f"{c}5"), F.col("inten"), F.col("selector"))).alias(c) for c in "rgb"])


@query("""WITH c AS (SELECT o_orderkey AS image, o_orderkey % 3 AS level, 64 + 4 * (o_orderkey % 13 = 0)::BIGINT AS width FROM orders), a AS (SELECT c_custkey * 7 AS image, c_custkey * 7 % 3 AS level, 64 + 4 * (c_custkey % 5 = 0)::BIGINT AS width FROM customer)
SELECT c.image, c.level, c.width, CASE WHEN a.image IS NULL THEN 'missing' WHEN a.width <> c.width THEN 'mismatch' ELSE 'ok' END AS alpha_state FROM c LEFT JOIN a ON a.image = c.image AND a.level = c.level""")
def alpha_slice_merge(spark, sf):
    """Join J1, filters F5 and F6: a colour slice an order, an alpha slice a customer."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    wide = lambda yes: (64 + 4 * yes.cast("bigint")).alias("width")
    colour = table(spark, sf, "orders").select(k.alias("image"), (k % 3).alias("level"), F.lit(False).alias("is_alpha"), wide(k % 13 == 0))
    alpha = table(spark, sf, "customer").select((c * 7).alias("image"), (c * 7 % 3).alias("level"), F.lit(True).alias("is_alpha"), wide(c % 5 == 0))
    return slices.alpha_merged(colour.unionByName(alpha))


def _event_slices(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("image"), (F.col("event_id") * 7 % 61).alias("level"))


@query("SELECT user_id AS image, event_id * 7 % 61 AS level, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1")
def slice_duplicates(spark, sf):
    """Aggregate A10."""
    return slices.duplicate_levels(_event_slices(spark, sf))


@query("""WITH s AS (SELECT DISTINCT user_id AS image, event_id * 7 % 61 AS level FROM events), w AS (SELECT image, unnest(generate_series(0, max(level))) AS level FROM s GROUP BY image)
SELECT image, level FROM w ANTI JOIN s USING (image, level)""")
def slice_missing_levels(spark, sf):
    """Aggregates A9 and A10."""
    return slices.missing_levels(_event_slices(spark, sf))


@query("""WITH l AS (SELECT o_custkey AS container, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS level, o_orderkey % 1000 AS start, o_orderkey % 1000 + 40 + o_orderkey % 60 AS stop FROM orders)
SELECT a.container, a.level AS first, b.level AS second FROM l a JOIN l b ON a.container = b.container AND a.level < b.level AND a.start < b.stop AND b.start < a.stop""")
def level_overlap(spark, sf):
    """Filters F2 and F3, join J8."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    return slices.overlapping_levels(table(spark, sf, "orders").select(F.col("o_custkey").alias("container"), n.alias("level"), (k % 1000).alias("start"), (k % 1000 + 40 + k % 60).alias("stop")))


@query("""WITH i AS (SELECT p_partkey AS image, 1 + p_partkey * 37 % 4096 AS width, 1 + p_partkey * 91 % 3000 AS height FROM part), l AS (SELECT *, unnest(generate_series(0, floor(log2(greatest(width, height)))::BIGINT))::INTEGER AS level FROM i)
, s AS (SELECT image, level, greatest(1, width >> level) AS width, greatest(1, height >> level) AS height FROM l) SELECT *, ((width + 5) // 6) * ((height + 4) // 5) AS blocks, ((width + 5) // 6) * ((height + 4) // 5) * 16 AS bytes FROM s""")
def mip_geometry(spark, sf):
    """Projection P14 and generator G1."""
    k = F.col("p_partkey")
    return geometry.mip_chain(table(spark, sf, "part").select(k.alias("image"), (1 + k * 37 % 4096).alias("width"), (1 + k * 91 % 3000).alias("height")), 6, 5, 16)


@query("""WITH c AS (SELECT l_partkey % 256 AS lo, l_suppkey % 256 AS hi, (l_linenumber * 9 + l_orderkey) % 65 AS w, l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, (((lo * 257) * (64 - w) + (hi * 257) * w + 32) >> 14) AS linear, ((((lo * 256 + 128) * (64 - w) + (hi * 256 + 128) * w + 32) >> 6) >> 8) AS srgb FROM c""")
def interpolate_colours(spark, sf):
    """Projections P8 and P9."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("lo"), (F.col("l_suppkey") % 256).alias("hi"), ((F.col("l_linenumber") * 9 + F.col("l_orderkey")) % 65).alias("w"))
    args = (F.col("lo"), F.col("hi"), F.col("w"))
    return rows.select("l_orderkey", "l_linenumber", P.interpolate_linear(*args).alias("linear"), P.interpolate_srgb(*args).alias("srgb"))


def _dequant_sql() -> str:
    parts = []
    for r, (n, trits, quints) in enumerate(geometry.WEIGHT_RANGES):
        levels = (3 if trits else 5 if quints else 1) << n
        if n == 0:
            v = f"{[0, 32, 63] if trits else [0, 16, 32, 47, 63]}[c + 1]"
        elif r not in geometry.WEIGHT_STEPS:
            v = " | ".join(f"(c << {s})" if s >= 0 else f"(c >> {-s})" for s in range(6 - n, -n, -n))
        else:
            bit = lambda k: f"((c >> {k}) & 1)"
            spread = {4: "0", 6: "0", 7: f"({bit(1)} * 69)", 9: f"({bit(1)} * 66)", 10: f"({bit(2)} * 66 + {bit(1)} * 33)"}[r]
            mask = f"(CASE WHEN c & 1 = 1 THEN 127 ELSE 0 END)"
            v = f"(({mask} & 32) | (xor((c >> {n}) * {geometry.WEIGHT_STEPS[r]} + {spread}, {mask}) >> 2))"
        parts.append(f"SELECT {r} AS range, c AS code, ({v})::BIGINT AS v FROM (SELECT unnest(generate_series(0, {levels - 1})) AS c)")
    return "SELECT range, code, v + (v > 32)::INT AS weight FROM (" + " UNION ALL ".join(parts) + ")"


@query(_dequant_sql())
def weight_dequant(spark, sf):
    """Projection P10."""
    return geometry.dequantised_weights(spark)


@query(f"""WITH {PX}, g AS (SELECT {BLK}, x % 4 AS x, y % 4 AS y, r % 65 AS w FROM px), d AS (SELECT unnest(generate_series(0, 47)) AS n), t AS (SELECT n % 8 AS x, n // 8 AS y, ((n % 8) * {(1024 + 4) // 7 * 3} + 32) >> 6 AS gx, ((n // 8) * {(1024 + 3) // 5 * 3} + 32) >> 6 AS gy FROM d)
, f AS (SELECT *, gx & 15 AS fx, gy & 15 AS fy, ((gx & 15) * (gy & 15) + 8) >> 4 AS share FROM t)
SELECT vec_id, block_x, block_y, f.x, f.y, (sum(g.w * CASE WHEN g.x = gx >> 4 AND g.y = gy >> 4 THEN 16 - fx - fy + share WHEN g.y = gy >> 4 THEN fx - share WHEN g.x = gx >> 4 THEN fy - share ELSE share END) + 8)::BIGINT >> 4 AS weight
FROM f JOIN g ON g.x BETWEEN gx >> 4 AND (gx >> 4) + 1 AND g.y BETWEEN gy >> 4 AND (gy >> 4) + 1 GROUP BY vec_id, block_x, block_y, f.x, f.y""")
def weight_upsample(spark, sf):
    """Window W6: each 4 x 4 grid spread over an 8 x 6 block."""
    key = ("vec_id", "block_x", "block_y")
    grids = B.blocks(images(spark, sf), 8, 8).select(*key, F.transform("px", lambda p: p["r"] % 65).alias("w"))
    return geometry.upsampled(grids, 4, 4, 8, 6, key)


def _partition_sql() -> str:
    u = lambda e: f"(({e}) & 4294967295)"
    steps = [u("xor(p, p >> 15)"), u("p - (p << 17)"), u("p + (p << 7)"), u("p + (p << 4)"), u("xor(p, p >> 5)"), u("p + (p << 16)"), u("xor(p, p >> 7)"), u("xor(p, p >> 3)"), u("xor(p, p << 6)"), u("xor(p, p >> 17)")]
    out, last = "", "s0"
    for k, e in enumerate(steps):
        out += f", h{k} AS (SELECT * EXCLUDE (p), {e} AS p FROM {last})"
        last = f"h{k}"
    sq = lambda k: f"((((p >> {4 * k}) & 15) * ((p >> {4 * k}) & 15)) >> {'f' if k % 2 == 0 else 'g'})"
    v = lambda k, sh: f"(({sq(2 * k)} * x * 2 + {sq(2 * k + 1)} * y * 2 + (p >> {sh})) & 63)"
    return f"""WITH s0 AS (SELECT seed, parts, seed + 1024 * (parts - 1) AS s, seed + 1024 * (parts - 1) AS p FROM (SELECT unnest(generate_series(0, 255)) AS seed), (SELECT unnest(generate_series(2, 4)) AS parts)){out}
, sh AS (SELECT *, CASE WHEN s & 2 <> 0 THEN 4 ELSE 5 END AS sa, CASE WHEN parts = 3 THEN 6 ELSE 5 END AS sb FROM {last}), fg AS (SELECT *, CASE WHEN s & 1 <> 0 THEN sa ELSE sb END AS f, CASE WHEN s & 1 <> 0 THEN sb ELSE sa END AS g FROM sh)
, t AS (SELECT *, n % 5 AS x, n // 5 AS y FROM fg, (SELECT unnest(generate_series(0, 19)) AS n)), w AS (SELECT seed, parts, x, y, {v(0, 14)} AS a, {v(1, 10)} AS b, CASE WHEN parts >= 3 THEN {v(2, 6)} ELSE 0 END AS c, CASE WHEN parts >= 4 THEN {v(3, 2)} ELSE 0 END AS d FROM t)
SELECT seed, parts::INTEGER AS parts, x, y, CASE WHEN a >= b AND a >= c AND a >= d THEN 0 WHEN b >= c AND b >= d THEN 1 WHEN c >= d THEN 2 ELSE 3 END AS part FROM w"""


@query(_partition_sql())
def partition_map(spark, sf):
    """Join J4: texel to subset, for 5 x 4 blocks."""
    return geometry.partition_map(spark, 256, 5, 4)


@query("SELECT x // 4 AS dx, y // 4 AS dy, x // 6 AS sx, y // 6 AS sy, count(*) AS texels FROM (SELECT unnest(generate_series(0, 47)) AS x), (SELECT unnest(generate_series(0, 35)) AS y) GROUP BY ALL")
def block_regrid(spark, sf):
    """Join J9: 6 x 6 source blocks that a 4 x 4 block takes texels from."""
    return geometry.regrid(spark, 48, 36)


@query("SELECT event_id, unnest(generate_series(0, event_id % 7)) AS place, user_id AS value FROM events")
def rle_expand(spark, sf):
    """Generator G2."""
    return slices.runs_expanded(table(spark, sf, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("n"), F.col("user_id").alias("value")), "event_id", "n", "value")


@query("SELECT user_id, event_id, sum(event_id * 7 % 13 - 6) OVER w - 32 * floor(sum(event_id * 7 % 13 - 6) OVER w / 32.0)::BIGINT AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)".replace("sum(event_id * 7 % 13 - 6) OVER w", "(sum(event_id * 7 % 13 - 6) OVER w)::BIGINT"))
def delta_prefix_mod(spark, sf):
    """Window W5: running deltas modulo 32."""
    return slices.running_modulo(table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 13 - 6).alias("d")), "user_id", "event_id", "d", 32)


@query("SELECT user_id, event_id, bit_xor(event_id * 31 % 256) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def selector_xor_chain(spark, sf):
    """Window W5: each row coded as its difference from the one before."""
    return slices.running_xor(table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 31 % 256).alias("v")), "user_id", "event_id", "v")


@query("SELECT o_custkey AS image, string_agg(lpad(to_hex(o_orderkey % 65536), 4, '0'), '' ORDER BY o_orderkey) AS payload FROM orders GROUP BY 1")
def level_concat_order(spark, sf):
    """Sorts O1 and O2: levels put together in order."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("level"), F.lpad(F.hex(F.col("o_orderkey") % 65536), 4, "0").alias("payload"))
    return slices.concatenated(rows, "image", "level", "payload")


@query("WITH f(flag, bit) AS (VALUES " + ", ".join(str(x) for x in catalog.DECODE_FLAGS) + ") SELECT event_id, string_agg(flag, ',' ORDER BY bit) AS flags FROM events JOIN f ON (event_id * 37 % 2048) & bit <> 0 GROUP BY event_id")
def decode_flag_sets(spark, sf):
    """Projection P13: masks to sets of names."""
    mask = F.col("event_id") * 37 % 2048
    names = F.concat_ws(",", *[F.when(mask.bitwiseAND(bit) != 0, F.lit(flag)) for flag, bit in catalog.DECODE_FLAGS])
    return table(spark, sf, "events").select("event_id", names.alias("flags")).filter("flags <> ''")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 3 = 0)")
def drop_encoded_originals(spark, sf):
    """Join J7, source S21: files without an encoded sibling."""
    encoded = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(encoded, "c_custkey", "left_anti")


@query("""WITH f AS (SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS path FROM pages), r AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS root FROM f WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(path, '^([^/]+)/', 1) FROM f WHERE page_id % 2 = 0)
, b AS (SELECT f.path, max(length(root)) AS n FROM (SELECT DISTINCT path FROM f) f JOIN r ON root <> '' AND starts_with(path, root || '/') GROUP BY 1) SELECT f.path, CASE WHEN n IS NULL THEN f.path ELSE substr(f.path, n::INT + 2) END AS relative FROM f LEFT JOIN b USING (path)""")
def relative_paths(spark, sf):
    """Source S3, sort O3: paths below the deepest root that holds them."""
    files = table(spark, sf, "pages").select("page_id", F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")).alias("path"))
    root = lambda pattern, n: files.filter(F.col("page_id") % n == 0).select(F.regexp_extract("path", pattern, 1).alias("root"))
    roots = root("^([^/]+/[^/]+)/", 3).union(root("^([^/]+)/", 2)).filter("root <> ''")
    return slices.deepest_root(files.select("path"), roots)


@query("SELECT x, y, row_number() OVER (ORDER BY x + y, CASE WHEN (x + y) % 2 = 0 THEN x ELSE y END) - 1 AS place FROM (SELECT unnest(generate_series(0, 7)) AS x), (SELECT unnest(generate_series(0, 7)) AS y)")
def zigzag_order(spark, sf):
    """Sort O7."""
    from pyspark.sql import Window

    rows = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    s = F.col("x") + F.col("y")
    return rows.select("x", "y", (F.row_number().over(Window.orderBy(s, F.when(s % 2 == 0, F.col("x")).otherwise(F.col("y")))).cast("bigint") - 1).alias("place"))


@query("SELECT range, code, weight, row_number() OVER (PARTITION BY range ORDER BY weight, code) - 1 AS rank FROM (" + _dequant_sql() + ")")
def weight_rank_permutation(spark, sf):
    """Sort O5."""
    from pyspark.sql import Window

    return geometry.dequantised_weights(spark).withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("weight", "code")).cast("bigint") - 1)


@query("SELECT image, max(level) AS top, count(*) AS slices, sum(bytes)::BIGINT AS bytes FROM (SELECT user_id AS image, event_id % 9 AS level, 16 * (1 + event_id % 5) AS bytes FROM events) GROUP BY image")
def slice_totals(spark, sf):
    """Aggregate A9."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("image"), (F.col("event_id") % 9).alias("level"), (16 * (1 + F.col("event_id") % 5)).alias("bytes"))
    return rows.groupBy("image").agg(F.max("level").alias("top"), F.count("*").alias("slices"), F.sum("bytes").alias("bytes"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey * 131 % 17000 AS width, 1 + p_partkey * 7 % 900 AS height, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS depth, p_partkey % 7 AS faces, p_partkey % 19 AS levels, p_partkey * 5 % 7 AS scheme FROM part)
SELECT k AS p_partkey, width, height, levels, CASE scheme WHEN 0 THEN 'NONE' WHEN 1 THEN 'BASISLZ' WHEN 2 THEN 'ZSTANDARD' WHEN 3 THEN 'DEFLATE' WHEN 4 THEN 'UASTC_HDR_6X6I' WHEN 5 THEN 'XUASTC_LDR' END AS scheme, faces AS images,
CASE WHEN width = 0 THEN 'invalid size' WHEN width > 16384 THEN 'size above the limit' WHEN depth <> 0 THEN 'only two dimensions are supported' WHEN faces < 1 THEN 'invalid face count' WHEN levels = 0 THEN 'no mip levels' WHEN levels > 16 THEN 'too many mip levels' WHEN scheme > 5 THEN 'unknown supercompression' END AS error FROM p""")
def ktx2_headers(spark, sf):
    """Sources S4, S6 and filter F1: headers written as bytes, parsed and judged."""
    from ..sources import ktx2

    k = F.col("p_partkey")
    zero = F.lit(0)
    levels = k % 19
    words = (F.lit(37), F.lit(1), k * 131 % 17000, 1 + k * 7 % 900, F.when(k % 17 == 0, 1).otherwise(0), zero, k % 7, levels, k * 5 % 7, zero, zero, zero, zero, zero, zero, zero, zero)
    content = F.unhex(F.concat(F.lit(ktx2.IDENTIFIER), *[_le(w, 4) for w in words], F.repeat(F.lit("00"), (levels * 24).cast("int"))))
    files = table(spark, sf, "part").select(k.cast("string").alias("path"), content.alias("content"))
    return ktx2.headers(files).select(F.col("path").cast("bigint").alias("p_partkey"), "width", "height", "levels", "scheme", "images", "error")


@query("SELECT event_id, event_id % 256 AS r, event_id * 3 % 256 AS g, user_id % 256 AS b, (event_id + user_id) % 256 AS a, 16 AS texels FROM events")
def uastc_solid_blocks(spark, sf):
    """Codec B10: solid blocks written as 37 bits and decoded, all of a batch at once."""
    import numpy as np
    import pyarrow as pa

    from ..codecs import uastc

    e, u = F.col("event_id"), F.col("user_id")
    word = F.lit(23) + F.shiftleft(e % 256, 5) + F.shiftleft(e * 3 % 256, 13) + F.shiftleft(u % 256, 21) + F.shiftleft((e + u) % 256, 29)
    rows = table(spark, sf, "events").select("event_id", F.unhex(F.concat(_le(word, 5), F.lit("00" * 11))).alias("block"))

    def run(batches):
        for batch in batches:
            t = uastc.texels(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 16)) if batch.num_rows else np.zeros((0, 16, 4), np.uint8)
            same = (t == t[:, :1]).all(2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(t[:, 0, c].astype(np.int64)) for c in range(4)), pa.array(same.astype(np.int32))], ["event_id", "r", "g", "b", "a", "texels"])

    return rows.mapInArrow(run, "event_id bigint, r bigint, g bigint, b bigint, a bigint, texels int")


from . import container_queries  # noqa: E402, F401  registers its queries
