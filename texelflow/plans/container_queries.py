"""Queries that write containers and streams from the driver's tables and read them back. The SQL knows nothing of
bytes: it says what was written."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..codecs import bits, uastc
from ..operators import encode, slices, transcode
from ..sources import basis, formats, ktx2
from ..streaming import video
from . import catalog, written
from .registry import folder, laid_out, le, query, table

#: Hex of n bytes (k * 3 + i) % 256 from i on, in SQL and as a Column.
BYTES_SQL = lambda k, first, n: f"array_to_string([upper(lpad(to_hex(({k} * 3 + i) % 256), 2, '0')) for i in range({first}, {first} + {n})], '')"


def _bytes(k: Column, first: int, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.lpad(F.hex((k * 3 + i) % 256), 2, "0")), "")


def _mapped(df: DataFrame, f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of f for each batch's columns, as lists."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(f(*(batch[c].tolist() for c in batch.columns)), columns=names)

    return df.mapInPandas(run, schema)


def _spread(df: DataFrame, f: Callable[..., dict], schema: str) -> DataFrame:
    """Rows of f for each row's values: a dict of arrays, or of a value for all. One row's are held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                yield pd.DataFrame(f(*row))

    return df.mapInPandas(run, schema)


def _headers(spark: SparkSession, sf: str, words: dict[int, Column | int], size: int, more: list[tuple[int, int, Column | int]] = []) -> DataFrame:  # noqa: B006
    """A KTX2 file for each part: words by offset in the header, and more fields (offset, bytes, number)."""
    start = {16: 1, 20: 8, 24: 8, 36: 1, 40: 1}
    fields = [(at, 4, v) for at, v in (start | words).items()] + more
    content = F.unhex(F.concat(F.lit(ktx2.IDENTIFIER), F.expr("substring(body, 25)")))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), laid_out(fields, size).alias("body")).select("path", content.alias("content"))


@query("""SELECT p_partkey, level::INTEGER AS level, 200 + 40 * level + p_partkey % 50 AS byte_offset, (p_partkey * 7 + level * 11) % 60 AS byte_length, (p_partkey * 7 + level * 11) % 60 * 2 + level AS uncompressed_length,
CASE WHEN 200 + 40 * level + p_partkey % 50 + (p_partkey * 7 + level * 11) % 60 > 330 THEN 'level past the end' END AS error FROM (SELECT p_partkey, unnest(generate_series(0, p_partkey % 4)) AS level FROM part)""")
def ktx2_level_index(spark, sf):
    """Source S7, filter F2: level rows of 64-bit numbers, held against the file's length."""
    part = F.col("p_partkey")
    n = 1 + part % 4
    length = lambda i: (part * 7 + i * 11) % 60
    index = [(80 + 24 * i + 8 * j, 8, F.when(n > i, v).otherwise(0)) for i in range(4) for j, v in enumerate((200 + 40 * i + part % 50, length(i), length(i) * 2 + i))]
    rows = ktx2.levels(ktx2.headers(_headers(spark, sf, {40: n}, 330, index)))
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), "level", "byte_offset", "byte_length", "uncompressed_length", "error")


@query("""WITH p AS (SELECT p_partkey, [163, 166, 167, 168, 169, 162, 99, 162][1 + p_partkey % 8]::BIGINT AS model, CASE p_partkey % 8 WHEN 5 THEN 1000066004 WHEN 7 THEN 150 + p_partkey % 40 ELSE 0 END AS vk, 4 + p_partkey % 3 AS bw, 4 + p_partkey % 5 AS bh, p_partkey % 3 AS transfer FROM part)
, f AS (SELECT *, CASE WHEN model = 163 THEN 'ETC1S' WHEN model = 166 THEN 'UASTC_LDR_4x4' WHEN model = 167 THEN 'UASTC_HDR_4x4' WHEN model = 168 THEN 'UASTC_HDR_6x6I' WHEN model = 169 THEN 'XUASTC_LDR_' || bw || 'x' || bh WHEN model = 162 AND vk = 1000066004 AND bw = 6 AND bh = 6 THEN 'ASTC_HDR_6x6' WHEN model = 162 AND vk BETWEEN 157 AND 184 THEN 'ASTC_LDR_' || bw || 'x' || bh END AS texture_format FROM p)
SELECT p_partkey, model, transfer, bw AS block_width, bh AS block_height, texture_format, CASE WHEN texture_format IS NULL THEN 'unknown colour model' END AS error FROM f""")
def ktx2_descriptors(spark, sf):
    """Sources S8 and S11: descriptor words and the texture format they name."""
    part = F.col("p_partkey")
    model = F.element_at(F.array(*[F.lit(m) for m in (163, 166, 167, 168, 169, 162, 99, 162)]), (1 + part % 8).cast("int"))
    vk = F.when(part % 8 == 5, F.lit(1000066004)).when(part % 8 == 7, 150 + part % 40).otherwise(0)
    files = _headers(spark, sf, {12: vk, 48: 104, 52: 44}, 148, [(104, 4, 44), (116, 4, model + F.shiftleft(part % 3, 16) + 256), (120, 4, (3 + part % 3) + F.shiftleft(3 + part % 5, 8))])
    rows = ktx2.descriptors(ktx2.headers(files))
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), *[F.col(c).cast("bigint").alias(c) for c in ("model", "transfer", "block_width", "block_height")], "texture_format", "error")


@query("SELECT p_partkey, place::INTEGER AS place, 'key' || place AS key, upper(repeat(to_hex(10 + (p_partkey + place) % 6), 2 * (place + 1))) AS value FROM (SELECT p_partkey, unnest(generate_series(0, p_partkey % 4 - 1)) AS place FROM part)")
def ktx2_key_values(spark, sf):
    """Source S9: entries in order, each padded to four bytes."""
    part = F.col("p_partkey")
    digit = lambda j: F.lower(F.hex(10 + (part + j) % 6))

    def entry(j: Column) -> Column:
        body = F.concat(F.hex(F.concat(F.lit("key"), j.cast("string")).cast("binary")), F.lit("00"), F.array_join(F.array_repeat(F.concat(digit(j), digit(j)), (j + 1).cast("int")), ""))
        size = F.length(body) / 2
        return F.concat(F.lpad(F.hex(size.cast("bigint")), 2, "0"), F.lit("000000"), body, F.expr("'00000000'").substr(F.lit(1), (2 * F.pmod(-size, F.lit(4))).cast("int")))

    kvd = F.when(part % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), part % 4 - 1), entry), "")).otherwise("")
    rows = table(spark, sf, "part").withColumn("kvd", kvd)
    head = laid_out([(16, 4, 1), (20, 4, 8), (24, 4, 8), (36, 4, 1), (40, 4, 1), (56, 4, 104), (60, 4, F.length("kvd") / 2)], 104)
    files = rows.select(part.cast("string").alias("path"), F.unhex(F.concat(F.lit(ktx2.IDENTIFIER), head.substr(F.lit(25), F.lit(184)), "kvd")).alias("content"))
    out = ktx2.key_value_rows(ktx2.headers(files)).filter("error is null")
    return out.select(F.col("path").cast("bigint").alias("p_partkey"), "place", "key", F.hex("value").alias("value"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'sRGB' ELSE 'Linear' END AS colour_space, {BYTES_SQL('p_partkey', 8, 8)} || {BYTES_SQL('p_partkey', 20, 4)} AS payload, NULL::VARCHAR AS error FROM part WHERE p_partkey % 5 <> 4
UNION ALL SELECT p_partkey, NULL, NULL, 'levels overlap' FROM part WHERE p_partkey % 5 = 4""")
def ktx2_plain_levels(spark, sf):
    """Source S14, filters F3 and F4, sorts O1 and O2: one image's binary slices of two levels, put together."""
    part = F.col("p_partkey")
    at, lengths = 128, (16, 8)
    second = F.when(part % 5 == 4, at + 4).otherwise(at + 16)
    index = [(80, 8, at), (88, 8, lengths[0]), (96, 8, lengths[0]), (104, 8, second), (112, 8, lengths[1]), (120, 8, lengths[1])]
    head = laid_out([(12, 4, F.when(part % 3 == 0, 43).otherwise(37)), (16, 4, 1), (20, 4, 8), (24, 4, 8), (32, 4, 2), (36, 4, 1), (40, 4, 2), *index], at)
    content = F.unhex(F.concat(F.lit(ktx2.IDENTIFIER), head.substr(F.lit(25), F.lit(2 * at - 24)), _bytes(part, 0, 24)))
    files = table(spark, sf, "part").select(part.cast("string").alias("path"), content.alias("content"))
    rows = ktx2.pass_through(ktx2.descriptors(ktx2.headers(files)), 1)
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), "colour_space", F.hex("payload").alias("payload"), "error")


@query("WITH l AS (SELECT p_partkey, unnest(generate_series(0, p_partkey % 4)) AS level FROM part) SELECT p_partkey, string_agg(" + BYTES_SQL("(p_partkey + level)", 0, 6) + ", '' ORDER BY level) AS payload FROM l GROUP BY p_partkey")
def binary_levels_concatenated(spark, sf):
    """Sort O2 on bytes that are no text."""
    part = F.col("p_partkey")
    level = F.explode(F.sequence(F.lit(0).cast("bigint"), part % 4)).alias("level")
    rows = table(spark, sf, "part").select("p_partkey", level).withColumn("payload", F.unhex(_bytes(part + F.col("level"), 0, 6)))
    return slices.concatenated(rows, "p_partkey", "level", "payload").select("p_partkey", F.hex("payload").alias("payload"))


@query(f"SELECT p_partkey, ['NONE', 'ZSTANDARD', 'DEFLATE', 'DEFLATE'][1 + p_partkey % 4] AS scheme, {BYTES_SQL('p_partkey', 0, 64)} || {BYTES_SQL('p_partkey', 64, 16)} AS payload FROM part")
def ktx2_supercompressed(spark, sf):
    """Sources S14 to S16: levels as stored, in Zstandard frames, in Deflate with a zlib wrapper and without."""
    part = F.col("p_partkey")

    def write(path, raw):
        import zstandard

        out = []
        for p, r in zip(path, raw, strict=True):
            whole = zlib.compress(r[:64]), zlib.compress(r[64:])
            kind = int(p) % 4
            packed = [(r[:64], r[64:]), tuple(zstandard.compress(r[:30]) + zstandard.compress(r[30:64]) if k == 0 else zstandard.compress(r[64:]) for k in (0, 1)), whole, tuple(w[2:-4] for w in whole)][kind]
            out.append((p, written.ktx2_file(packed, 4, 4, scheme=(0, 2, 3, 3)[kind], vk=37, full=(64, 16))))
        return out

    raw = table(spark, sf, "part").select(part.cast("string").alias("path"), F.unhex(_bytes(part, 0, 80)).alias("raw"))
    heads = ktx2.descriptors(ktx2.headers(_mapped(raw, write, "path string, content binary")))
    payload = ktx2.pass_through(heads).select("path", "payload")
    return heads.select("path", "scheme").join(payload, "path").select(F.col("path").cast("bigint").alias("p_partkey"), "scheme", F.hex("payload").alias("payload"))


def _basis_fields() -> dict[str, Column | int]:
    part = F.col("p_partkey")
    return {"version": 0x13, "slices": 1 + part % 3, "images": 1 + part % 2, "format_code": part % 4, "flags": part % 32, "type_code": part % 5, "us_per_frame": part * 41 % 100000, "endpoints": part % 60000, "selectors": part * 3 % 60000, "slice_offset": F.when(part % 11 == 10, 400).otherwise(77)}


def _basis_files(spark, sf):
    part = F.col("p_partkey")
    places = {n: (at, size) for n, at, size in basis.HEADER_FIELDS}
    fields = [(*places[n], v) for n, v in _basis_fields().items()]
    for i in range(3):
        of = {"image": (part + i) % 3, "level": part % 7 + i, "flags": (part + i) % 4, "width": part % 3000 + i, "height": part % 2000, "blocks_x": 3, "blocks_y": 2, "byte_offset": 140 + 10 * i, "byte_length": part * 3 % 20, "crc": part % 65536}
        fields += [(77 + basis.SLICE * i + at, size, F.when(1 + part % 3 > i, of[n]).otherwise(0)) for n, at, size in basis.SLICE_FIELDS]
    body = laid_out(fields, 160)
    return table(spark, sf, "part").select(part.cast("string").alias("path"), F.unhex(F.concat(F.lit("7342"), body.substr(F.lit(5), F.lit(316)))).alias("content"))


@query("""SELECT p_partkey, 1 + p_partkey % 3 AS slices, 1 + p_partkey % 2 AS images, p_partkey % 4 AS format_code, ['2D', '2D_ARRAY', 'CUBEMAP', 'VIDEO', 'VOLUME'][1 + p_partkey % 5] AS texture_type, p_partkey * 41 % 100000 AS us_per_frame, p_partkey % 60000 AS endpoints, p_partkey * 3 % 60000 AS selectors,
array_to_string(list_filter([CASE WHEN p_partkey & 1 <> 0 THEN 'etc1s' END, CASE WHEN p_partkey & 2 <> 0 THEN 'y_flipped' END, CASE WHEN p_partkey & 4 <> 0 THEN 'has_alpha_slices' END, CASE WHEN p_partkey & 8 <> 0 THEN 'uses_global_codebook' END, CASE WHEN p_partkey & 16 <> 0 THEN 'srgb' END], lambda x: x IS NOT NULL), ',') AS flags,
CASE WHEN p_partkey % 11 = 10 THEN 'slice table past the end' END AS error FROM part""")
def basis_headers(spark, sf):
    """Source S12, projection P13: header fields, texture type and flags by name."""
    rows = basis.headers(_basis_files(spark, sf))
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("slices", "images", "format_code", "us_per_frame", "endpoints", "selectors")]
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), *numbers, "texture_type", formats.flag_names(F.col("flags"), formats.HEADER_FLAGS).alias("flags"), "error")


@query("""WITH s AS (SELECT p_partkey AS k, unnest(generate_series(0, p_partkey % 3)) AS i FROM part WHERE p_partkey % 11 <> 10)
SELECT k AS p_partkey, i::INTEGER AS slice, (k + i) % 3 AS image, k % 7 + i AS level, (k + i) % 4 % 2 = 1 AS is_alpha, (k + i) % 4 >= 2 AS is_iframe, k % 3000 + i AS width, k % 2000 AS height, 140 + 10 * i AS byte_offset, k * 3 % 20 AS byte_length,
CASE WHEN (k + i) % 3 >= 1 + k % 2 THEN 'image index out of range' WHEN 140 + 10 * i + k * 3 % 20 > 160 THEN 'slice past the end' END AS error FROM s""")
def basis_slices(spark, sf):
    """Source S13, filters F2 and F4: slice descriptors held against the header and the file."""
    rows = basis.slices(basis.headers(_basis_files(spark, sf)))
    return rows.select(F.col("path").cast("bigint").alias("p_partkey"), "slice", *[F.col(c).cast("bigint").alias(c) for c in ("image", "level", "width", "height", "byte_offset", "byte_length")], "is_alpha", "is_iframe", "error")


@query("""SELECT p_partkey, i::INTEGER AS place, p_partkey % 100 + i * 9 AS byte_offset, 1 + (p_partkey + i) % 7 AS byte_length, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 5 + i END AS profile FROM (SELECT p_partkey, unnest(generate_series(0, p_partkey % 4)) AS i FROM part WHERE p_partkey % 3 <> 2)
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 2""")
def ktx2_slice_ranges(spark, sf):
    """Source S10, second variant: rows of 8 or 12 bytes; of another size they are a fault."""
    part = F.col("p_partkey")

    def write(path):
        out = []
        for p in map(int, path):
            n, size = 1 + p % 4, (8, 12, 9)[p % 3]
            rows = [np.array([p % 100 + i * 9, 1 + (p + i) % 7, p % 5 + i], "<u4").tobytes()[:size] for i in range(n)]
            out.append((str(p), written.ktx2_file([b"x"], 4, 4, written.MODEL["XUASTC_LDR"], scheme=5, layers=n, sgd=b"".join(rows))))
        return out

    def read(path, content, offset, length, images, levels):
        out = []
        for p, c, o, n, i, lv in zip(path, content, offset, length, images, levels, strict=True):
            try:
                out += [(int(p), k, *r) for k, r in enumerate(ktx2.slice_ranges(bytes(c), {"sgd_offset": o, "sgd_length": n, "images": i, "levels": lv}))]
            except ValueError:
                out.append((int(p), None, None, None, None))
        return out

    files = _mapped(table(spark, sf, "part").select(part.cast("string").alias("path")), write, "path string, content binary")
    heads = ktx2.headers(files).select("path", "content", "sgd_offset", "sgd_length", "images", "levels")
    return _mapped(heads, read, "p_partkey bigint, place int, byte_offset bigint, byte_length bigint, profile bigint")


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 5) AS container FROM part")
def container_sniff(spark, sf):
    """Source S5: containers by their name's ending or by their first bytes."""
    part = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("a/b.BASIS", "a/b.dat", "a.ktx2/b.png", "b.x.Ktx2", "a/basis", "c.ktx")]), (1 + part % 6).cast("int"))
    start = F.when(part % 6 == 1, F.when(part % 12 == 1, ktx2.IDENTIFIER).otherwise("7342" + "00" * 10)).otherwise("7342")
    return table(spark, sf, "part").select("p_partkey", ktx2.looks_like(name, F.unhex(start)).alias("container"))


@query("SELECT n_nationkey::BIGINT AS nation, n_name || chr(10) AS content FROM nation")
def file_scan(spark, sf):
    """Sources S1 and S2: whole files of a folder and the folders below it, by their names' ending."""
    at = folder(spark, "files")
    table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("nation")).write.partitionBy("nation").text(at)
    rows = ktx2.read(spark, at, "*.txt")
    return rows.select(F.regexp_extract("path", r"nation=(\d+)/", 1).cast("bigint").alias("nation"), F.col("content").cast("string").alias("content"))


# ---- streams


@query("SELECT event_id, event_id % 1000 AS rice, event_id % (2 + user_id % 50) AS truncated, event_id * 37 AS chunked, event_id % 8 AS plain FROM events")
def bit_codes(spark, sf):
    """Codecs B1 and B2: plain, Rice, truncated binary and chunked numbers, one after another."""

    def run(event, user):
        out = []
        for e, u in zip(event, user, strict=True):
            w = written.BitWriter()
            w.put(e % 8, 3)
            w.rice(e % 1000, 4)
            w.truncated(e % (2 + u % 50), 2 + u % 50)
            w.chunked(e * 37, 4)
            b = bits.Bits(w.done())
            plain, rice, short = b.take(3), b.rice(4), b.truncated(2 + u % 50)
            out.append((e, rice, short, b.chunked(4), plain))
        return out

    return _mapped(table(spark, sf, "events").select("event_id", "user_id"), run, "event_id bigint, rice bigint, truncated bigint, chunked bigint, plain bigint")


@query("""WITH s AS (SELECT user_id, event_id AS symbol, 9 + event_id * 7 % 6 AS length FROM events), c AS (SELECT user_id, length, count(*) AS n FROM s GROUP BY ALL)
, f AS (SELECT c.user_id, c.length, coalesce(sum(d.n * 2 ** (c.length - d.length)), 0)::BIGINT AS first FROM c LEFT JOIN c d ON d.user_id = c.user_id AND d.length < c.length GROUP BY ALL)
SELECT s.user_id, s.symbol, s.length, first + row_number() OVER (PARTITION BY s.user_id, s.length ORDER BY symbol) - 1 AS code FROM s JOIN f USING (user_id, length)""")
def canonical_codes(spark, sf):
    """Codec B3, aggregate A11: codes by length, then symbol; read back from the decoder's table."""
    event = F.col("event_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        h = bits.Huffman(pdf["length"].tolist())
        first = {}
        for at, found in enumerate(h.table):
            if found is not None:
                first.setdefault(found[0], at)
        code = [int(f"{first[k]:0{n}b}"[::-1], 2) for k, n in enumerate(pdf["length"])]
        return pdf.assign(code=code)[["user_id", "symbol", "length", "code"]]

    rows = table(spark, sf, "events").select("user_id", event.alias("symbol"), (9 + event * 7 % 6).alias("length"))
    return rows.groupBy("user_id").applyInPandas(run, "user_id bigint, symbol bigint, length bigint, code bigint")


_CRC = "list_reduce(list_prepend(65535::BIGINT, b), lambda c, x: xor(xor(xor((c << 8) & 65535, {k}), {k} << 5) & 65535, ({k} << 12) & 65535))".replace("{k}", "xor(xor(x, c >> 8) >> 4, xor(x, c >> 8))")
_M = "4294967295"
_HSIEH_STEP = f"list_reduce(list_prepend(n, w), lambda h, x: (({{b}}) + (({{b}}) >> 11)) & {_M})".replace("{b}", f"xor((((h + (x & 65535)) & {_M}) << 16) & {_M}, xor(((x >> 16) << 11) & {_M}, (h + (x & 65535)) & {_M}))")


def _final_sql() -> str:
    out, last = "", "t0"
    for k, e in enumerate(("xor(h, (h << 3) & M)", "(h + (h >> 5)) & M", "xor(h, (h << 4) & M)", "(h + (h >> 17)) & M", "xor(h, (h << 25) & M)", "(h + (h >> 6)) & M")):
        out += f", t{k + 1} AS (SELECT * EXCLUDE (h), {e.replace('M', _M)} AS h FROM {last})"
        last = f"t{k + 1}"
    return out


@query(f"""WITH s AS (SELECT c_custkey, left(c_name, 18 - (c_custkey % 7)::INT) AS t FROM customer), y AS (SELECT c_custkey, [ord(x)::BIGINT for x in string_split(t, '')] AS b, length(t) AS n FROM s)
, w AS (SELECT *, [b[4 * i + 1] + b[4 * i + 2] * 256 + (b[4 * i + 3] + b[4 * i + 4] * 256) * 65536 for i in range(n // 4)] AS w FROM y)
, h0 AS (SELECT *, {_HSIEH_STEP} AS h FROM w)
, h1 AS (SELECT *, CASE n % 4 WHEN 0 THEN h WHEN 1 THEN (h + b[n]) & {_M} WHEN 2 THEN (h + b[n - 1] + b[n] * 256) & {_M} ELSE (h + b[n - 2] + b[n - 1] * 256) & {_M} END AS g FROM h0)
, h2 AS (SELECT * EXCLUDE (g), CASE n % 4 WHEN 0 THEN g WHEN 1 THEN xor(g, (g << 10) & {_M}) WHEN 2 THEN xor(g, (g << 11) & {_M}) ELSE xor(xor(g, (g << 16) & {_M}), (b[n] << 18) & {_M}) END AS g FROM h1)
, t0 AS (SELECT c_custkey, b, CASE n % 4 WHEN 0 THEN g WHEN 1 THEN (g + (g >> 1)) & {_M} WHEN 2 THEN (g + (g >> 17)) & {_M} ELSE (g + (g >> 11)) & {_M} END AS h FROM h2){_final_sql()}
SELECT c_custkey, xor(65535::BIGINT, {_CRC}) AS crc16, h AS hsieh FROM t6""")
def byte_checksums(spark, sf):
    """Projection P15: CRC-16 and the Hsieh hash of names of 12 to 18 bytes."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr("left(c_name, int(18 - c_custkey % 7))").cast("binary").alias("b"))
    return _mapped(rows, lambda k, b: [(i, bits.crc16(x), bits.hsieh(x)) for i, x in zip(k, b, strict=True)], "c_custkey bigint, crc16 bigint, hsieh bigint")


_LEVELS = {1: 1, 2: 3, 3: 7, 4: 15, 5: 31}


def _uastc_sql() -> str:
    rows = ", ".join(f"({n}, {uastc.MODES[k].components}, {uastc.MODES[k].planes}, {uastc.MODES[k].weight_bits}, {uastc.MODES[k].selector_bits})" for n, k in enumerate(k for k in range(19) if k != uastc.SOLID))
    six = "CASE wb WHEN 1 THEN q * 63 WHEN 2 THEN q * 21 WHEN 3 THEN q * 9 WHEN 4 THEN (q << 2) | (q >> 2) ELSE (q << 1) | (q >> 4) END"
    return f"""WITH m(mode, comps, planes, wb, sb) AS (VALUES {rows}), e AS (SELECT event_id, (event_id % 18)::INT AS mode, (CASE WHEN sb > 0 THEN user_id % 4 ELSE 3 END)::INT AS second, m.* EXCLUDE (mode) FROM events JOIN m ON m.mode = event_id % 18)
, t AS (SELECT *, unnest(generate_series(0, 15)) AS texel FROM e), c AS (SELECT *, unnest([0, 1, 2, 3]) AS comp FROM t)
, w AS (SELECT *, (event_id * 31 + texel * 7 + CASE WHEN planes = 2 AND comp = second THEN 5 ELSE 0 END) % (1 << (wb - 1)::INT) AS q FROM c), s AS (SELECT *, {six} AS six FROM w)
, v AS (SELECT event_id, mode, texel, comp, CASE WHEN comp = 3 AND comps = 3 THEN 255 ELSE (65535 * (six + (six > 32)::INT) + 32) >> 14 END AS v FROM s)
SELECT event_id, mode, texel::INTEGER AS texel, max(v) FILTER (comp = 0) AS r, max(v) FILTER (comp = 1) AS g, max(v) FILTER (comp = 2) AS b, max(v) FILTER (comp = 3) AS a FROM v GROUP BY ALL"""


@query(_uastc_sql())
def uastc_all_modes(spark, sf):
    """Codec B10: blocks of the 18 modes with end points from 0 to 255 and given weights, to texels."""

    def run(event, user):
        modes = [k for k in range(19) if k != uastc.SOLID]
        blocks, where = [], []
        for e, u in zip(event, user, strict=True):
            m = uastc.MODES[modes[e % 18]]
            values = uastc.endpoint_table(m.endpoint_range)
            codes = [int(values.argmin()), int(values.argmax())] * (m.components * m.subsets)
            weights = [[(e * 31 + t * 7 + p * 5) % (1 << (m.weight_bits - 1)) for p in range(m.planes)] for t in range(16)]
            patterns = {0: 1, 4: 11}.get(m.pattern_bits, 19)
            blocks.append(written.uastc_block(modes[e % 18], e // 18 % patterns, codes, weights, u % 4))
            where.append(e)
        texels = uastc.texels(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)).astype(int).tolist() if blocks else []
        return [(e, e % 18, t, *rgba) for e, block in zip(where, texels, strict=True) for t, rgba in enumerate(block)]

    return _mapped(table(spark, sf, "events").select("event_id", "user_id"), run, "event_id bigint, mode int, texel int, r bigint, g bigint, b bigint, a bigint")


_INTENSITY = "[[-8, -2, 2, 8], [-17, -5, 5, 17], [-29, -9, 9, 29], [-42, -13, 13, 42], [-60, -18, 18, 60], [-80, -24, 24, 80], [-106, -33, 33, 106], [-183, -47, 47, 183]]"
_ETC1S_SQL = f"""WITH n AS (SELECT count(*) AS ns FROM supplier), c AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer)
, size AS (SELECT nation, (count(*) + 7) // 8 * 8 AS cells FROM c GROUP BY 1), cell AS (SELECT nation, unnest(generate_series(0, cells - 1)) AS rn FROM size)
, b AS (SELECT cell.nation, cell.rn, coalesce(c_custkey % ns, 0) AS e, coalesce(c_custkey * 7 % ns, 0) AS s, coalesce(c_custkey * 3 % ns, 0) AS ae FROM cell LEFT JOIN c USING (nation, rn), n)
, t AS (SELECT *, unnest(generate_series(0, 15)) AS t FROM b), m AS (SELECT *, {_INTENSITY} AS mods, 1 + (s * 5 + t * 3) % 4 AS sel FROM t)
, colour AS (SELECT nation, rn % 8 * 4 + t % 4 AS x, rn // 8 * 4 + t // 4 AS y, [least(255, greatest(0, ((v << 3) | (v >> 2)) + mods[1 + (e % 8)::INT][sel::INT])) for v in [e % 32, (e * 5 + 1) % 32, (e * 11 + 2) % 32]] AS rgb, least(255, greatest(0, (((ae % 32) << 3) | ((ae % 32) >> 2)) + mods[1 + (ae % 8)::INT][sel::INT])) AS a FROM m)
"""


#: Block rows of a file: images are limited to 16384 texels a side, and stored tables to 16383 symbols, so a nation of more
#: customers has several files, one below the other, each with palettes of the suppliers its own blocks name.
_BAND = 512


def _etc1s_files(spark, sf):
    """Files nation/band of each nation: a block a customer, eight in a row; palettes of the suppliers; alpha in a slice of
    its own."""
    palette = table(spark, sf, "supplier").agg(F.count("*").alias("ns"))  # one row
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", (rank - 1).alias("rn")).join(F.broadcast(palette))
    rows = rows.withColumn("band", F.floor(F.col("rn") / (8 * _BAND)).cast("bigint")).repartition("nation", "band")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        ns = int(pdf["ns"].iloc[0])
        pdf = pdf.sort_values("rn")
        cells = -(-len(pdf) // 8) * 8
        k = pdf["c_custkey"].to_numpy()
        grid = lambda v: np.pad(v % ns, (0, cells - len(v))).reshape(-1, 8)
        ends, (e, a) = _named(grid(k), grid(k * 3))
        sels, (s,) = _named(grid(k * 7))
        book = written.Etc1sWriter(list(zip(*((f % 32).tolist() for f in (ends, ends * 5 + 1, ends * 11 + 2)), (ends % 8).tolist(), strict=True)), (sels[:, None] * 5 + np.arange(16) * 3) % 4)
        path = f"{pdf['nation'].iloc[0]}/{pdf['band'].iloc[0]}"
        return pd.DataFrame({"path": [path], "content": [written.etc1s_ktx2(book, book.stream(e, s), book.stream(a, s), 32, cells // 2)]})

    return rows.groupBy("nation", "band").applyInPandas(write, "path string, content binary")


def _named(*grids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers that grids hold, least first, and the grids of their places."""
    numbers = np.unique(np.concatenate([g.reshape(-1) for g in grids]))
    return numbers, [np.searchsorted(numbers, g) for g in grids]


def _place(path: str) -> tuple[int, int]:
    """Nation and first block row of a file."""
    nation, band = map(int, path.split("/"))
    return nation, band * _BAND


@query(_ETC1S_SQL + "SELECT nation::BIGINT AS nation, x, y, rgb[1] AS r, rgb[2] AS g, rgb[3] AS b, a FROM colour")
def etc1s_container_texels(spark, sf):
    """Source S10, codecs B3 to B7, joins J1 to J3, window W4, generator G1: palettes, streams and alpha slices of KTX2
    files, to texels."""
    rows = transcode.transcode(_etc1s_files(spark, sf), "RGBA8")

    def texels(path, width, height, payload):
        nation, first = _place(path)
        at = np.arange(width * height)
        rgba = np.frombuffer(payload, np.uint8).reshape(-1, 4).astype(np.int64)
        return {"nation": nation, "x": at % width, "y": at // width + first * 4} | {c: rgba[:, k] for k, c in enumerate("rgba")}

    return _spread(rows.select("path", "width", "height", "payload"), texels, "nation bigint, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint")


@query("""WITH n AS (SELECT count(*) AS ns FROM supplier), c AS (SELECT c_nationkey::BIGINT AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer)
, size AS (SELECT nation, (count(*) + 7) // 8 * 8 AS cells FROM c GROUP BY 1), cell AS (SELECT nation, unnest(generate_series(0, cells - 1)) AS rn FROM size)
, b AS (SELECT cell.nation, cell.rn, coalesce(c_custkey % ns, 0) AS e FROM cell LEFT JOIN c USING (nation, rn), n)
SELECT nation, rn AS block, e % 32 * 8 AS r, (e * 5 + 1) % 32 * 8 AS g, (e * 11 + 2) % 32 * 8 AS b, e % 8 * 36 + 2 AS code FROM b""")
def etc1s_as_etc1(spark, sf):
    """Codec B8: palette entries become ETC1 blocks as they are: differential mode without difference, both halves alike."""
    rows = transcode.transcode(_etc1s_files(spark, sf), "ETC1")

    def read(path, payload):
        nation, first = _place(path)
        raw = np.frombuffer(payload, np.uint8).reshape(-1, 8).astype(np.int64)
        return {"nation": nation, "block": np.arange(len(raw)) + first * 8} | {c: raw[:, k] for k, c in enumerate("rgb")} | {"code": raw[:, 3] & ~1}

    return _spread(rows.select("path", "payload"), read, "nation bigint, block bigint, r bigint, g bigint, b bigint, code bigint")


@query("""WITH d AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS frame, event_id * 5 % 16 AS place, event_id % 97 AS value FROM events), p AS (SELECT unnest(generate_series(0, 15)) AS place)
, g AS (SELECT d.user_id, d.frame, p.place, CASE WHEN d.place = p.place THEN value END AS v FROM d, p)
SELECT user_id, frame, place::INTEGER AS place, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, place ORDER BY frame), 0) AS value FROM g""")
def video_frames(spark, sf):
    """Section 2.13, join J10: each frame is the one before with its changed blocks."""
    event = F.col("event_id")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int")
    deltas = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("level"), F.lit(False).alias("is_alpha"), frame.alias("frame"), F.lit(16).alias("n_blocks"), F.array((event * 5 % 16).cast("int")).alias("places"), F.array((event % 97).cast("int")).alias("values_"))
    rows = video.frames(deltas).select("path", "frame", F.posexplode("blocks").alias("place", "value"))
    return rows.select(F.col("path").cast("bigint").alias("user_id"), F.col("frame").cast("bigint").alias("frame"), "place", F.col("value").cast("bigint").alias("value"))


@query("""SELECT n AS video, f AS frame, x, y, CASE WHEN x // 4 = f % 3 AND y // 4 = 0 AND f > 0 THEN 255 ELSE 0 END AS red FROM (SELECT n_nationkey::BIGINT AS n FROM nation), (SELECT unnest(generate_series(0, 4)) AS f), (SELECT unnest(generate_series(0, 11)) AS x), (SELECT unnest(generate_series(0, 3)) AS y) WHERE f = 0
UNION ALL SELECT n, f, x, y, CASE WHEN y // 4 = 0 AND x // 4 <= 2 AND list_contains([g % 3 for g in range(1, f + 1)], x // 4) THEN 255 ELSE 0 END FROM (SELECT n_nationkey::BIGINT AS n FROM nation), (SELECT unnest(generate_series(1, 4)) AS f), (SELECT unnest(generate_series(0, 11)) AS x), (SELECT unnest(generate_series(0, 3)) AS y)""")
def basis_video_texels(spark, sf):
    """Section 2.13: a .basis video of five frames, each with one block turned red and all others copied."""

    def write(nation):
        book = written.Etc1sWriter([(0, 0, 0, 0), (31, 0, 0, 0)], np.array([[2] * 16, [3] * 16]))
        out = []
        for n in nation:
            now = np.zeros((1, 3), int)
            frames = [book.stream(now, now)]
            for f in range(1, 5):
                book.before = now.copy()
                frames.append(book.copied(3, 1, {(0, f % 3): (1, 1)}))
                now[0, f % 3] = 1
            out.append((str(n), written.basis_file([(k, 0, 2 if k == 0 else 0, 12, 4, d) for k, d in enumerate(frames)], 0, 3, book)))
        return out

    def texels(path, image, payload):
        return [(int(p), f, x, y, 255 if raw[4 * (12 * y + x)] > 200 else 0) for p, f, raw in zip(path, image, payload, strict=True) for y in range(4) for x in range(12)]

    files = _mapped(table(spark, sf, "nation").select("n_nationkey"), write, "path string, content binary")
    return _mapped(transcode.transcode(files, "RGBA8").select("path", "image", "payload"), texels, "video bigint, frame bigint, x bigint, y bigint, red int")


def _samples() -> list[tuple[str, str, bytes]]:
    """(source, kind of container, file) of one small image each."""
    solid = written.BitWriter()
    for v, n in ((0x17, 5), (9, 8), (8, 8), (7, 8), (6, 8)):
        solid.put(v, n)
    solid = solid.done().ljust(16, b"\0")
    void = bytes.fromhex("FCFFFFFFFFFFFFFF003C003C003C003C")  # one HDR colour, which any block size has
    hdr = written.hdr6x6i_stream(6, 6, [(1, 2, 3)], [0])
    one = np.zeros((1, 1), int)
    book = written.Etc1sWriter([(1, 2, 3, 4), (5, 6, 7, 0)], np.zeros((2, 16), int))
    stream = book.stream(one, one)
    m = written.MODEL
    head = written.BitWriter()
    for v, n in ((1, 5), (0, 4), (0, 1), (4, 16), (4, 16), (0, 1), (0, 1)):
        head.put(v, n)
    raw = head.done()
    xuastc = b"\2" + np.array([len(raw)] + [0] * 20, "<u4").tobytes() + raw
    return [
        ("PLAIN", "ktx2", written.ktx2_file([bytes(64)], 4, 4, vk=37)),
        ("ETC1S", "ktx2", written.etc1s_ktx2(book, stream, b"", 4, 4)),
        ("ETC1S", "basis", written.basis_file([(0, 0, 0, 4, 4, stream)], 0, book=book)),
        ("UASTC_LDR_4x4", "ktx2", written.ktx2_file([solid], 4, 4, m["UASTC_LDR_4x4"])),
        ("UASTC_LDR_4x4", "basis", written.basis_file([(0, 0, 0, 4, 4, solid)], 1)),
        ("UASTC_HDR_4x4", "ktx2", written.ktx2_file([void], 4, 4, m["UASTC_HDR_4x4"])),
        ("UASTC_HDR_4x4", "basis", written.basis_file([(0, 0, 0, 4, 4, void)], 2)),
        ("ASTC_HDR_6x6", "ktx2", written.ktx2_file([void], 6, 6, m["ASTC"], (6, 6), vk=1000066004)),
        ("ASTC_HDR_6x6", "basis", written.basis_file([(0, 0, 0, 6, 6, void)], 3)),
        ("UASTC_HDR_6x6I", "ktx2", written.ktx2_file([hdr], 6, 6, m["UASTC_HDR_6x6I"], (6, 6), scheme=4, sgd=np.array([0, len(hdr), 0], "<u4").tobytes())),
        ("UASTC_HDR_6x6I", "basis", written.basis_file([(0, 0, 0, 6, 6, hdr)], 4)),
        ("XUASTC_LDR_4x4", "ktx2", written.ktx2_file([xuastc], 4, 4, m["XUASTC_LDR"], scheme=5)),
        ("XUASTC_LDR_4x4", "basis", written.basis_file([(0, 0, 0, 4, 4, xuastc)], 5)),
        ("ASTC_LDR_4x4", "ktx2", written.ktx2_file([void], 4, 4, m["ASTC"], vk=157)),
    ]


@query("""WITH t AS (SELECT unnest(['RGBA8', 'RGB565', 'BGR565', 'RGBA4444', 'ETC1', 'ETC2', 'ETC2_NO_ALPHA', 'ETC2_EAC_R11', 'ETC2_EAC_RG11', 'BC1', 'BC3', 'BC4', 'BC5', 'BC7', 'BC6H', 'RGB_HALF', 'RGBA_HALF', 'RGB_9E5', 'ASTC_HDR_4X4', 'ASTC_HDR_6X6', 'ASTC_LDR_4X4', 'ASTC_LDR_5X4', 'ASTC_LDR_5X5', 'ASTC_LDR_6X5', 'ASTC_LDR_6X6', 'ASTC_LDR_8X5', 'ASTC_LDR_8X6', 'ASTC_LDR_10X5', 'ASTC_LDR_10X6', 'ASTC_LDR_8X8', 'ASTC_LDR_10X8', 'ASTC_LDR_10X10', 'ASTC_LDR_12X10', 'ASTC_LDR_12X12']) AS target)
, k AS (SELECT *, target IN ('BC6H', 'RGB_HALF', 'RGBA_HALF', 'RGB_9E5') AS hdr, starts_with(target, 'ASTC') AS astc FROM t)
, s(source, containers) AS (VALUES ('PLAIN', ['ktx2']), ('ETC1S', ['ktx2', 'basis']), ('UASTC_LDR_4x4', ['ktx2', 'basis']), ('UASTC_HDR_4x4', ['ktx2', 'basis']), ('ASTC_HDR_6x6', ['ktx2', 'basis']), ('UASTC_HDR_6x6I', ['ktx2', 'basis']), ('XUASTC_LDR_4x4', ['ktx2', 'basis']), ('ASTC_LDR_4x4', ['ktx2']))
SELECT source, unnest(containers) AS container, target, CASE source WHEN 'PLAIN' THEN target = 'RGBA8' WHEN 'ETC1S' THEN NOT hdr AND NOT astc WHEN 'UASTC_LDR_4x4' THEN NOT hdr AND NOT astc OR target = 'ASTC_LDR_4X4' WHEN 'UASTC_HDR_4x4' THEN hdr OR target = 'ASTC_HDR_4X4' WHEN 'ASTC_HDR_6x6' THEN hdr OR target = 'ASTC_HDR_6X6' WHEN 'UASTC_HDR_6x6I' THEN hdr OR target = 'ASTC_HDR_6X6' ELSE false END AS supported FROM s, k""")
def dispatch_matrix(spark, sf):
    """Section 2.2 and generator G3: a file of every source in every target. What comes out has a payload, or a fault."""
    files = spark.createDataFrame([(f"{s}/{c}", bytearray(f)) for s, c, f in _samples()], "path string, content binary").repartition(4)
    out = transcode.transcode_each(files, F.array(*[F.lit(t) for t in catalog.TARGETS]))
    parts = F.split("path", "/")
    return out.groupBy(parts[0].alias("source"), parts[1].alias("container"), "target").agg(F.bool_and(F.col("error").isNull() & (F.length("payload") > 0)).alias("supported"))


@query("SELECT p_partkey, 2 AS images, 16 * (1 + p_partkey % 3) AS bytes, NULL::VARCHAR AS error, 'missing has no decoder; register one' AS without FROM part WHERE p_partkey % 4 <> 3 UNION ALL SELECT p_partkey, 0, NULL, 'not a KTX2 file', 'missing has no decoder; register one' FROM part WHERE p_partkey % 4 = 3")
def sql_table_function(spark, sf):
    """Section 2.14: the decoder as a table function in SQL, and one that is missing."""
    from ..sources import backends

    def write(key):
        out = []
        for p in key:
            side = 2 * (1 + p % 3)
            one = bytes(side * 2 * 4)
            out.append((str(p), written.ktx2_file([one + one], side, 2, vk=37, layers=2) if p % 4 != 3 else b"x" * 90))
        return out

    backends.register(spark)
    backends.register(spark, "no_texture_images", backends.MISSING)
    _mapped(table(spark, sf, "part").select("p_partkey"), write, "path string, content binary").createOrReplaceTempView("texture_files")
    return spark.sql("""SELECT cast(f.path AS bigint) AS p_partkey, cast(2 * count(t.payload) AS int) AS images, cast(max(length(t.payload)) AS bigint) AS bytes, max(t.error) AS error, max(n.error) AS without
FROM texture_files f, LATERAL texture_images(f.content, 'RGBA8', 1) t, LATERAL no_texture_images(f.content, 'RGBA8', NULL) n GROUP BY f.path""")


@query("""SELECT p_partkey, image, CASE WHEN image < 1 + p_partkey % 3 THEN (image * 50 + p_partkey) % 256 END AS red, CASE WHEN image >= 1 + p_partkey % 3 THEN 'image index out of range' END AS error FROM part, (SELECT unnest([0, 1, 2]) AS image)""")
def image_index(spark, sf):
    """Filter F4: one image of array textures, by its index."""

    def write(key):
        out = []
        for p in key:
            blocks = []
            for i in range(1 + p % 3):
                w = written.BitWriter()
                for v, n in ((0x17, 5), ((i * 50 + p) % 256, 8), (0, 8), (0, 8), (0, 8)):
                    w.put(v, n)
                blocks.append(w.done().ljust(16, b"\0"))
            out.append((str(p), written.ktx2_file([b"".join(blocks)], 4, 4, written.MODEL["UASTC_LDR_4x4"], layers=len(blocks))))
        return out

    files = _mapped(table(spark, sf, "part").select("p_partkey"), write, "path string, content binary")
    rows = None
    for i in range(3):
        one = transcode.transcode(files, "RGBA8", i).select(F.col("path").cast("bigint").alias("p_partkey"), F.lit(i).alias("image"), F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("bigint").alias("red"), "error")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("SELECT p_partkey, ['FULL_ARITH', 'HYBRID_ARITH_ZSTD', 'FULL_ZSTD'][1 + p_partkey % 3] AS syntax, [4, 5, 5, 6, 6, 8, 8, 10, 10, 8, 10, 10, 12, 12][1 + p_partkey % 14] || 'x' || [4, 4, 5, 5, 6, 5, 6, 5, 6, 8, 8, 10, 10, 12][1 + p_partkey % 14] AS block, 1 + p_partkey * 3 % 4000 AS width, 1 + p_partkey % 900 AS height, p_partkey % 2 = 1 AS srgb, p_partkey % 5 = 0 AS alpha, CASE WHEN p_partkey % 4 = 0 THEN (1 + p_partkey % 200) / 2.0 END::DOUBLE AS quality, CASE WHEN p_partkey % 3 = 1 THEN 'HYBRID_ARITH_ZSTD blocks are not supported' ELSE 'XUASTC blocks are not decoded here' END AS error FROM part")
def xuastc_headers(spark, sf):
    """Codecs B12 to B15 and B17: payload syntaxes and image headers, arithmetically coded or in bits."""
    from ..codecs import xuastc

    def run(key):
        out = []
        for p in key:
            fields = [(1, 5), (p % 14, 4), (p % 2, 1), (1 + p * 3 % 4000, 16), (1 + p % 900, 16), (int(p % 5 == 0), 1), (int(p % 4 == 0), 1)] + [(1 + p % 200, 8)] * (p % 4 == 0)
            w, e = written.BitWriter(), xuastc.Encoder()
            for v, n in fields:
                w.put(v, n)
                e.bits(v, n)
            plain, coded = w.done(), e.done()
            lengths = lambda first, n: np.array([first] + [0] * (n - 1), "<u4").tobytes()
            data = [b"\0" + coded, b"\1" + lengths(len(coded), 11) + coded, b"\2" + lengths(len(plain), 21) + plain][p % 3]
            h = xuastc.header(data)
            try:
                xuastc.blocks(data)
            except ValueError as fault:
                out.append((p, h.syntax, f"{h.block[0]}x{h.block[1]}", h.width, h.height, h.srgb, h.alpha, h.quality, str(fault)))
        return out

    return _mapped(table(spark, sf, "part").select("p_partkey"), run, "p_partkey bigint, syntax string, block string, width bigint, height bigint, srgb boolean, alpha boolean, quality double, error string")


def _transform_sql() -> str:
    """Grids of 6 x 5 weights of a block of 8 x 6: three coefficients on the diagonals, their steps, and the sums of cosines."""
    from ..codecs.weight_transform import STEPS

    table = "[" + ", ".join(str(list(r)) for r in STEPS) + "]"
    at = lambda v, n: f"least({v} * 8.0 / {n}, 7.0)"
    mix = lambda r: f"((1 - (ax - floor(ax))) * {table}[1 + {r}::INT][1 + floor(ax)::INT] + (ax - floor(ax)) * {table}[1 + {r}::INT][1 + least(floor(ax)::INT + 1, 7)])"
    cos = lambda u, x, n: f"(CASE WHEN {u} = 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) END * cos(pi() * (2 * {x} + 1) * {u} / (2.0 * {n})))"
    return f"""WITH e AS (SELECT event_id, event_id % 9 AS dc, 10 + event_id % 90 AS quality, (event_id * 7 % 400)::DOUBLE AS span, [1 + event_id % 3, 2 + event_id % 5, 9 + user_id % 4] AS place, [1 + user_id % 2, -1 - event_id % 2, 1] AS q FROM events)
, d AS (SELECT x, y, row_number() OVER (ORDER BY x + y, CASE WHEN (x + y) % 2 = 0 THEN x ELSE -x END) - 1 AS n FROM (SELECT unnest(generate_series(0, 5)) AS x), (SELECT unnest(generate_series(0, 4)) AS y))
, c AS (SELECT event_id, dc, quality, span, unnest([place[1], greatest(place[1] + 1, place[2]), place[3]]) AS n, unnest(q) AS q FROM e)
, s AS (SELECT *, {at('x', 8)} AS ax, {at('y', 6)} AS ay, (CASE WHEN quality < 50 THEN 5000.0 / quality ELSE 200 - 2.0 * quality END) / 100 * 64 / greatest(span, 14.0) * pow(63.0 / 7, 0.1) AS scale FROM c JOIN d USING (n))
, f AS (SELECT *, greatest(1, floor(((1 - (ay - floor(ay))) * {mix('floor(ay)')} + (ay - floor(ay)) * {mix('least(floor(ay) + 1, 7)')}) * scale + 0.5)) AS step FROM s)
, k AS (SELECT event_id, x AS u, y AS v, CASE WHEN x + y = 1 THEN q * step ELSE sign(q) * (abs(q) + 0.5) * step END AS value FROM f)
, g AS (SELECT event_id, dc, x, y FROM e, (SELECT unnest(generate_series(0, 5)) AS x), (SELECT unnest(generate_series(0, 4)) AS y))
, w AS (SELECT g.event_id, g.x, g.y, any_value(dc) * 8 + sum(value * {cos('u', 'g.x', 6)} * {cos('v', 'g.y', 5)}) AS w FROM g JOIN k ON k.event_id = g.event_id GROUP BY ALL)
SELECT event_id, x::INTEGER AS x, y::INTEGER AS y, least(64, greatest(0, trunc(w + CASE WHEN w >= 0 THEN 0.5 ELSE -0.5 END)))::BIGINT AS weight FROM w"""


@query(_transform_sql())
def transformed_weights(spark, sf):
    """Codec B19, sort O7, section 2.10: arithmetically coded planes of coefficients, read and transformed back."""
    from ..codecs import weight_transform as wt
    from ..codecs import xuastc

    def run(event, user):
        out = []
        for e, u in zip(event, user, strict=True):
            places = [1 + e % 3, max(2 + e % 3, 2 + e % 5), 9 + u % 4]
            values = [1 + u % 2, -1 - e % 2, 1]
            models = lambda: (xuastc.SymbolModel(9), xuastc.SymbolModel(65), xuastc.SymbolModel(255))
            w, (means, runs, sizes) = xuastc.Encoder(), models()
            w.symbol(e % 9, means)
            at = 1
            for n, q in zip(places, values, strict=True):
                w.symbol(n - at, runs)
                w.bits(int(q < 0), 1)
                w.symbol(abs(q) - 1, sizes)
                at = n + 1
            w.symbol(wt.LAST, runs)
            plane = wt.read(xuastc.Decoder(w.done()), 30, *models())
            grid = wt.weights(plane, (6, 5), (8, 6), 5, 10 + e % 90, float(e * 7 % 400))
            out += [(e, x, y, int(grid[y, x])) for y in range(5) for x in range(6)]
        return out

    return _mapped(table(spark, sf, "events").select("event_id", "user_id"), run, "event_id bigint, x int, y int, weight bigint")


@query("SELECT user_id, count(*) AS symbols, sum(event_id * event_id % 40)::BIGINT AS total, sum(event_id % 3 = 0)::BIGINT AS bits, sum(1 + event_id % 900)::BIGINT AS gammas, max(event_id % 17) AS most FROM events GROUP BY user_id")
def arithmetic_streams(spark, sf):
    """Codec B15, aggregate A14: a stream a user of symbols, bits and gamma codes under adaptive models, read back."""
    from ..codecs import xuastc

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(pdf["event_id"].tolist())
        models = lambda: (xuastc.SymbolModel(40), xuastc.BitModel(), xuastc.GammaModel())
        e, (s, b, g) = xuastc.Encoder(), models()
        for k in keys:
            e.symbol(k * k % 40, s)
            e.bit(k % 3 == 0, b)
            e.gamma(1 + k % 900, g)
            e.truncated(k % 17, 17)
        d, (s, b, g) = xuastc.Decoder(e.done()), models()
        got = [(d.symbol(s), d.bit(b), d.gamma(g), d.truncated(17)) for _ in keys]
        sums = [sum(x) for x in zip(*got, strict=True)]
        return pd.DataFrame([(pdf["user_id"].iloc[0], len(keys), *sums[:3], max(x[3] for x in got))], columns=["user_id", "symbols", "total", "bits", "gammas", "most"])

    return table(spark, sf, "events").select("user_id", "event_id").groupBy("user_id").applyInPandas(run, "user_id bigint, symbols bigint, total bigint, bits bigint, gammas bigint, most bigint")


def _bc7_sql() -> str:
    """Blocks of modes 0 to 3 and 7 whose groups run from black to white, or are white, or black; where both end points
    share a lowest bit of 0, white is 253."""
    from ..codecs import bc7

    patterns = ", ".join(f"({n}, {p}, '{g}')" for n, rows in ((2, bc7.GROUPS_2), (3, bc7.GROUPS_3)) for p, g in enumerate(rows))
    return f"""WITH m(mode, groups, n, ib) AS (VALUES (0, 3, 16, 3), (1, 2, 64, 3), (2, 3, 64, 2), (3, 2, 64, 2), (7, 2, 64, 2)), g(groups, pattern, text) AS (VALUES {patterns})
, e AS (SELECT event_id, m.*, event_id // 5 % m.n AS pattern FROM events JOIN m ON m.mode = [0, 1, 2, 3, 7][1 + event_id % 5])
, t AS (SELECT e.*, text, unnest(generate_series(0, 15)) AS texel FROM e JOIN g ON g.groups = e.groups AND g.pattern = e.pattern)
, v AS (SELECT *, substr(text, texel + 1, 1)::INT AS own, (event_id + texel * 3) % (1 << (ib - 1)::INT) AS i FROM t)
, w AS (SELECT *, CASE ib WHEN 2 THEN [0, 21][1 + i] ELSE [0, 9, 18, 27][1 + i] END AS w FROM v)
SELECT event_id, mode, texel::INTEGER AS texel, ((CASE WHEN own = 1 THEN 255 ELSE 0 END * (64 - w) + CASE WHEN own = 2 THEN 0 WHEN own = 0 AND mode = 1 THEN 253 ELSE 255 END * w + 32) >> 6)::BIGINT AS grey FROM w"""


@query(_bc7_sql())
def bc7_partitioned_modes(spark, sf):
    """Codec B29, join J4: BC7 blocks with two and three groups of texels, all patterns, to texels."""
    from ..codecs import bc7

    def run(key):
        blocks = []
        for k in key:
            mode = (0, 1, 2, 3, 7)[k % 5]
            m = bc7.MODES[mode]
            pattern = k // 5 % (1 << m.pattern)
            _, anchors = bc7.layout(m.groups, pattern)
            w = written.BitWriter()
            w.put(1 << mode, mode + 1)
            w.put(pattern, m.pattern)
            ends = ((0, 1), (1, 1), (0, 0))  # of each group: black to white, white, black
            for n in [m.colour] * 3 + [m.alpha] * (m.alpha > 0):
                for g in range(m.groups):
                    for v in ends[g]:
                        w.put(v * ((1 << n) - 1), n)
            for g in range(m.groups):
                for v in ends[g][: m.lowest]:
                    w.put(v if m.lowest == 2 else ends[g][1] & ends[g][0], 1)
            for t in range(16):
                w.put((k + t * 3) % (1 << (m.index - 1)), m.index - (t in anchors))
            blocks.append(w.done().ljust(16, b"\0"))
        texels = bc7.texels(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)) if blocks else np.zeros((0, 16, 4))
        return [(k, (0, 1, 2, 3, 7)[k % 5], t, int(texels[j, t, 0])) for j, k in enumerate(key) for t in range(16)]

    return _mapped(table(spark, sf, "events").select("event_id"), run, "event_id bigint, mode int, texel int, grey bigint")


@query("""WITH b AS (SELECT p_partkey, unnest(generate_series(0, 1 + p_partkey % 5)) AS block FROM part), c AS (SELECT *, CASE WHEN block = 0 THEN 0 ELSE 1 END AS own FROM b)
SELECT p_partkey, block::INTEGER AS block, (p_partkey * 31 + own * 1000) % 31744 AS r, (p_partkey * 17 + own) % 31744 AS g, (p_partkey + own * 77) % 31744 AS b, 36 AS texels FROM c""")
def hdr_intermediate_streams(spark, sf):
    """Codec B24, section 2.2: 6x6 HDR intermediate streams in KTX2 files, to half floats of each block."""

    def write(key):
        out = []
        for p in key:
            n = 2 + p % 5
            colours = [((p * 31 + j * 1000) % 31744, (p * 17 + j) % 31744, (p + j * 77) % 31744) for j in (0, 1)]
            stream = written.hdr6x6i_stream(6 * n, 6, colours, [0, n - 2])
            out.append((str(p), written.ktx2_file([b"xyz" + stream], 6 * n, 6, written.MODEL["UASTC_HDR_6x6I"], (6, 6), scheme=4, sgd=np.array([3, len(stream)], "<u4").tobytes())))
        return out

    def read(path, width, payload):
        out = []
        for p, w, raw in zip(path, width, payload, strict=True):
            t = np.frombuffer(raw, "<u2").reshape(6, w, 3).astype(int)
            for k in range(w // 6):
                own = t[:, 6 * k : 6 * k + 6].reshape(-1, 3)
                out.append((int(p), k, *own[0].tolist(), int((own == own[0]).all(1).sum())))
        return out

    files = _mapped(table(spark, sf, "part").select("p_partkey"), write, "path string, content binary")
    rows = transcode.transcode(files, "RGB_HALF").select("path", "width", "payload")
    return _mapped(rows, read, "p_partkey bigint, block int, r bigint, g bigint, b bigint, texels int")


@query("SELECT event_id, true AS red, true AS green, true AS blue FROM events")
def bc6h_blocks(spark, sf):
    """Codecs B26 and B27: HDR blocks of one colour become BC6H within a step of ten bits."""
    from ..codecs import astc, bc6h

    def run(key):
        k = np.array(key, np.int64)
        out = []
        for odd, size, name, copies in ((0, 4, "UASTC_HDR_4x4", 1), (1, 6, "ASTC_HDR_6x6", 2)):
            own = k[k % 2 == odd]
            if not len(own):
                continue
            want = np.stack([own * 7 % 0x7BFF, own * 131 % 0x7BFF, own * 17 % 0x7BFF], 1)
            void = np.concatenate([np.tile(np.frombuffer(bytes.fromhex("FCFFFFFFFFFFFFFF"), "<u2"), (len(own), 1)), want, np.full((len(own), 1), 0x3C00)], 1).astype("<u2")
            side = size * copies  # 12 texels are whole blocks of both sizes
            image = np.tile(void.repeat(copies, 0), (copies, 1)).tobytes()
            got = bc6h.texels(np.frombuffer(astc.hdr_image(image, side * len(own), side, name, "BC6H"), np.uint8).reshape(-1, 16))
            got = got.reshape(side // 4, len(own), side // 4, 16, 3)
            near = (np.abs(got - want[None, :, None, None]) <= 32).all((0, 2, 3))
            out += [(int(a), *map(bool, n)) for a, n in zip(own, near, strict=True)]
        return out

    return _mapped(table(spark, sf, "events").select("event_id"), run, "event_id bigint, red boolean, green boolean, blue boolean")


@query("SELECT n_nationkey::BIGINT AS nation, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE reverse(n_name) END AS payload, CASE n_nationkey % 5 WHEN 4 THEN 'encoder made an empty file' END AS error FROM nation")
def encoded_images(spark, sf):
    """Source S20, section 2.15: an external program run over files, with its output as bytes, or a fault."""
    import sys

    script = "import sys; a = sys.argv; data = open(a[-1], 'rb').read(); open(a[a.index('-output_file') + 1], 'wb').write(b'' if data == b'empty' else data[::-1])"
    content = F.when(F.col("n_nationkey") % 5 == 4, F.lit("empty")).otherwise(F.col("n_name")).cast("binary")
    files = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"), content.alias("content"))
    rows = encode.encode(files, [sys.executable, "-c", script])
    return rows.select(F.col("path").cast("bigint").alias("nation"), F.col("payload").cast("string").alias("payload"), "error")


_KINDS = (0, 1, 4, 6, 8, 9, 10, 12)


def _ends_sql() -> str:
    """End points of 8 bits by kind: luminance, with a shared base or with alpha; a scaled colour; two colours, where the
    darker comes first or both are contracted towards blue; a colour and an offset."""
    con = lambda a, b: f"CASE WHEN s1 >= s0 THEN [{a}] ELSE [(({b[0]}) + ({b[2]})) >> 1, (({b[1]}) + ({b[2]})) >> 1, {b[2]}] END"
    lo8, hi8 = con("v[1], v[3], v[5]", ("v[2]", "v[4]", "v[6]")), con("v[2], v[4], v[6]", ("v[1]", "v[3]", "v[5]"))
    base = [f"((v[{2 * c + 1}] >> 1) | (v[{2 * c + 2}] & 128))" for c in range(3)]
    off = [f"(((v[{2 * c + 2}] >> 1) & 63) - CASE WHEN v[{2 * c + 2}] & 64 <> 0 THEN 64 ELSE 0 END)" for c in range(3)]
    far = [f"(({b}) + ({o}))" for b, o in zip(base, off, strict=True)]
    clip = lambda xs: "[" + ", ".join(f"least(255, greatest(0, {x}))" for x in xs) + "]"
    contract = lambda xs: [f"((({xs[0]}) + ({xs[2]})) >> 1)", f"((({xs[1]}) + ({xs[2]})) >> 1)", xs[2]]
    down = f"({off[0]} + {off[1]} + {off[2]}) < 0"
    first = "(v[1] >> 2) | (v[2] & 192)"
    return f"""WITH e AS (SELECT event_id, {list(_KINDS)}[1 + event_id % {len(_KINDS)}] AS kind, [(event_id * (37 + 11 * k) + user_id * k) % 256 for k in range(8)] AS v FROM events), s AS (SELECT *, v[1] + v[3] + v[5] AS s0, v[2] + v[4] + v[6] AS s1 FROM e)
, p AS (SELECT event_id, kind, CASE WHEN kind IN (0, 4) THEN [v[1], v[1], v[1]] WHEN kind = 1 THEN [{first}, {first}, {first}] WHEN kind IN (6, 10) THEN [v[1] * v[4] >> 8, v[2] * v[4] >> 8, v[3] * v[4] >> 8] WHEN kind IN (8, 12) THEN {lo8} ELSE CASE WHEN {down} THEN {clip(contract(far))} ELSE {clip(base)} END END AS lo,
CASE WHEN kind IN (0, 4) THEN [v[2], v[2], v[2]] WHEN kind = 1 THEN list_transform([1, 1, 1], lambda i: least(255, ({first}) + (v[2] & 63))) WHEN kind IN (6, 10) THEN [v[1], v[2], v[3]] WHEN kind IN (8, 12) THEN {hi8} ELSE CASE WHEN {down} THEN {clip(contract(base))} ELSE {clip(far)} END END AS hi,
CASE kind WHEN 4 THEN v[3] WHEN 10 THEN v[5] WHEN 12 THEN CASE WHEN s1 >= s0 THEN v[7] ELSE v[8] END ELSE 255 END AS a0, CASE kind WHEN 4 THEN v[4] WHEN 10 THEN v[6] WHEN 12 THEN CASE WHEN s1 >= s0 THEN v[8] ELSE v[7] END ELSE 255 END AS a1 FROM s)
SELECT event_id, kind, array_to_string(lo, ' ') || ' ' || a0 AS lo, array_to_string(hi, ' ') || ' ' || a1 AS hi FROM p"""


@query(_ends_sql())
def endpoints_by_kind(spark, sf):
    """Projection P11: end point values of eight LDR kinds to two colours."""
    from ..codecs import astc_hdr

    def run(event, user):
        out = []
        for e, u in zip(event, user, strict=True):
            kind = _KINDS[e % len(_KINDS)]
            v = np.array([[(e * (37 + 11 * k) + u * k) % 256 for k in range(2 * ((kind >> 2) + 1))]])
            ends = astc_hdr.ends_of(v, kind)[0][0] // 257
            out.append((e, kind, *(" ".join(map(str, ends[:, k].tolist())) for k in (0, 1))))
        return out

    return _mapped(table(spark, sf, "events").select("event_id", "user_id"), run, "event_id bigint, kind int, lo string, hi string")


@query("""WITH e AS (SELECT event_id, event_id * 7 % 256 AS v0, event_id * 13 % 256 AS v1 FROM events), t AS (SELECT *, unnest(generate_series(0, 15)) AS texel FROM e), y AS (SELECT *, CASE WHEN v1 >= v0 THEN v0 * 16 ELSE v1 * 16 + 8 END * 16 AS y0, CASE WHEN v1 >= v0 THEN v1 * 16 ELSE v0 * 16 - 8 END * 16 AS y1, [0, 21, 43, 64][1 + (event_id + texel) % 4] AS w FROM t)
, c AS (SELECT *, (y0 * (64 - w) + y1 * w + 32) >> 6 AS c FROM y), m AS (SELECT *, c & 2047 AS m FROM c)
SELECT event_id, texel::INTEGER AS texel, least(31743, (c >> 11) * 1024 + (CASE WHEN m < 512 THEN 3 * m WHEN m < 1536 THEN 4 * m - 512 ELSE 5 * m - 2048 END >> 3)) AS half FROM m""")
def hdr_luminance_blocks(spark, sf):
    """Codec B25, projection P12: HDR blocks of one pair of luminances and two-bit weights, to half floats."""
    from ..codecs import astc, astc_hdr

    def run(key):
        level, high = astc.WEIGHT_RANGE[2]
        blocks = []
        for k in key:
            w = written.BitWriter()
            w.put(level >> 1 | (level & 1) << 4 | 2 << 5 | high << 9, 11)  # a grid of 4 x 4
            w.put(0, 2)
            w.put(2, 4)
            w.put(k * 7 % 256, 8)
            w.put(k * 13 % 256, 8)
            value = w.value
            for t in range(16):  # weights run down from the top
                for b in (0, 1):
                    value |= ((k + t) % 4 >> b & 1) << (127 - 2 * t - b)
            blocks.append(value.to_bytes(16, "little"))
        got = astc_hdr.halves(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16), (4, 4)) if blocks else np.zeros((0, 16, 4))
        return [(k, t, int(got[j, t, 0])) for j, k in enumerate(key) for t in range(16)]

    return _mapped(table(spark, sf, "events").select("event_id"), run, "event_id bigint, texel int, half bigint")


def _bc5_sql(c: str) -> str:
    reached = " + ".join(f"(({c} - lo) * 14 + 4 >= (hi - lo) * {k})::INT" for k in (13, 11, 9, 7, 5, 3, 1))
    return f"SELECT nation, x // 4 AS bx, y // 4 AS by_, any_value(hi) AS hi, any_value(lo) AS lo, sum(CASE WHEN hi = lo THEN 0 ELSE [1, 7, 6, 5, 4, 3, 2, 0][1 + {reached}] * (8 ** (y % 4 * 4 + x % 4))::BIGINT END)::BIGINT AS s FROM (SELECT *, max({c}) OVER w AS hi, min({c}) OVER w AS lo FROM px WINDOW w AS (PARTITION BY nation, x // 4, y // 4)) GROUP BY ALL"


@query(_ETC1S_SQL + f", px AS (SELECT nation::BIGINT AS nation, x, y, rgb[1] AS r, a FROM colour), r AS ({_bc5_sql('r')}), z AS ({_bc5_sql('a')}) SELECT nation, by_ * 8 + bx AS block, r.hi AS r_hi, r.lo AS r_lo, r.s AS r_selectors, z.hi AS a_hi, z.lo AS a_lo, z.s AS a_selectors FROM r JOIN z USING (nation, bx, by_)")
def etc1s_as_bc5(spark, sf):
    """Codec B9, join J6: red and alpha of ETC1S files in one block each."""
    rows = transcode.transcode(_etc1s_files(spark, sf), "BC5")

    def read(path, payload):
        nation, first = _place(path)
        raw = np.frombuffer(payload, np.uint8).reshape(-1, 2, 8).astype(np.int64)
        half = lambda c, b: {f"{c}_hi": b[:, 0], f"{c}_lo": b[:, 1], f"{c}_selectors": (b[:, 2:] << 8 * np.arange(6)).sum(1)}
        return {"nation": nation, "block": np.arange(len(raw)) + first * 8} | half("r", raw[:, 0]) | half("a", raw[:, 1])

    return _spread(rows.select("path", "payload"), read, "nation bigint, block bigint, r_hi bigint, r_lo bigint, r_selectors bigint, a_hi bigint, a_lo bigint, a_selectors bigint")


_S8 = lambda c, m: f"((({c} * {m} + 128) + (({c} * {m} + 128) >> 8)) >> 8)"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 3 % 256 AS g, p_size * 5 % 256 AS b, (p_partkey + p_size) % 256 AS a FROM part)
SELECT p_partkey, (r + g * 256 + b * 65536 + a * 16777216)::BIGINT AS rgba, {_S8('r', 31)} * 2048 + {_S8('g', 63)} * 32 + {_S8('b', 31)} AS rgb565, {_S8('b', 31)} * 2048 + {_S8('g', 63)} * 32 + {_S8('r', 31)} AS bgr565, {_S8('r', 15)} * 4096 + {_S8('g', 15)} * 256 + {_S8('b', 15)} * 16 + {_S8('a', 15)} AS rgba4444, 20 AS texels FROM p""")
def uastc_pixel_targets(spark, sf):
    """Section 2.2: UASTC files of one colour, 5 x 4 texels, in the targets of pixels, each file parsed once."""

    def write(key, size):
        out = []
        for p, n in zip(key, size, strict=True):
            w = written.BitWriter()
            for v, bits_ in ((0x17, 5), (p % 256, 8), (p * 3 % 256, 8), (n * 5 % 256, 8), ((p + n) % 256, 8)):
                w.put(v, bits_)
            out.append((str(p), written.ktx2_file([w.done().ljust(16, b"\0") * 2], 5, 4, written.MODEL["UASTC_LDR_4x4"])))
        return out

    def read(path, target, payload):
        alike: dict[tuple[str, int], list[int]] = {}
        for k, (t, raw) in enumerate(zip(target, payload, strict=True)):
            alike.setdefault((t, len(raw)), []).append(k)
        out = []
        for (t, size), own in alike.items():
            v = np.frombuffer(b"".join(payload[k] for k in own), "<u4" if t == "RGBA8" else "<u2").reshape(len(own), -1)
            value = np.where((v == v[:, :1]).all(1), v[:, 0].astype(np.int64), -1).tolist()
            out += [(int(path[k]), t, x, v.shape[1]) for k, x in zip(own, value, strict=True)]
        return out

    # a small table of rows that each take long: its few splits would leave most cores without work
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    files = _mapped(parts, write, "path string, content binary")
    rows = transcode.transcode_each(files, F.array(*[F.lit(t) for t in ("RGBA8", "RGB565", "BGR565", "RGBA4444")]))
    each = _mapped(rows.select("path", "target", "payload"), read, "p_partkey bigint, target string, value bigint, n int")
    of = lambda t, name: F.max(F.when(F.col("target") == t, F.col("value"))).alias(name)
    return each.groupBy("p_partkey").agg(of("RGBA8", "rgba"), of("RGB565", "rgb565"), of("BGR565", "bgr565"), of("RGBA4444", "rgba4444"), F.max("n").alias("texels"))


@query("""WITH e AS (SELECT event_id, user_id, event_id % 2 AS d, event_id % 8 AS t, user_id % 4 AS s, CASE WHEN event_id % 2 = 1 THEN 32 ELSE 16 END AS n FROM events), c AS (SELECT *, event_id * 3 % n AS r, user_id % n AS g, (event_id + user_id) % n AS b FROM e)
SELECT event_id, CASE d WHEN 1 THEN r * 8 ELSE r * 17 END AS r, CASE d WHEN 1 THEN g * 8 ELSE g * 17 END AS g, CASE d WHEN 1 THEN b * 8 ELSE b * 17 END AS b, d * 2 + t * 36 AS code, [4294967295, 4294901760, 0, 65535][1 + s] AS selectors FROM c""")
def uastc_solid_as_etc1(spark, sf):
    """Codec B11: solid blocks carry their ETC1 colour, table and selector."""
    from ..codecs import uastc_hints

    def run(event, user):
        blocks = []
        for e, u in zip(event, user, strict=True):
            w, n = written.BitWriter(), 32 if e % 2 else 16
            for v, size in ((0x17, 5), (e, 8), (u, 8), (e, 8), (255, 8), (e % 2, 1), (e % 8, 3), (u % 4, 2), (e * 3 % n, 5), (u % n, 5), ((e + u) % n, 5)):
                w.put(v, size)
            blocks.append(w.done().ljust(16, b"\0"))
        out = uastc_hints.pack(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16), "ETC1") if blocks else []
        return [(e, *map(int, b[:4]), int.from_bytes(b[4:].tobytes(), "big")) for e, b in zip(event, out, strict=True)]

    return _mapped(table(spark, sf, "events").select("event_id", "user_id"), run, "event_id bigint, r bigint, g bigint, b bigint, code bigint, selectors bigint")


# ---- other operators


@query("SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN CASE WHEN c_custkey % 15 <= 10 THEN 0 ELSE 2 END WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 2 END AS status FROM customer")
def cli_options(spark, sf):
    """Filter F9: command lines that are accepted (0) or not (2)."""
    from ..__main__ import options

    def run(key):
        out = []
        for k in key:
            good = ["--input", "a", "--output", "b", "--format", "bc7"]
            args = [good, good[:-1], [*good, "--nope", "1"], [*good, "--quality", str(k % 15)], [*good, "--threads", "65"], [*good, "--strict", "maybe"], [*good, "--linear-color-space", "FALSE", "--image-index", str(k)], ["--input", "--output", "b"]][k % 8]
            try:
                options(args)
                out.append((k, 0))
            except ValueError:
                out.append((k, 2))
        return out

    return _mapped(table(spark, sf, "customer").select("c_custkey"), run, "c_custkey bigint, status int")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 OR ((1 + p_partkey % 50) % 4 = 0 AND (1 + p_partkey * 3 % 70) % 4 = 0) THEN '' ELSE (1 + p_partkey % 50 + 3) // 4 * 4 || ' ' || (1 + p_partkey * 3 % 70 + 3) // 4 * 4 END AS resample FROM part""")
def aligned_sizes(spark, sf):
    """Section 2.15: sizes of PNG and QOI headers, up to the next multiple of four; of other files none."""
    part = F.col("p_partkey")
    be = lambda v: F.lpad(F.hex(v), 8, "0")
    w, h = 1 + part % 50, 1 + part * 3 % 70
    content = F.unhex(F.when(part % 4 == 3, F.lit("FFD8FF")).when(part % 4 == 2, F.concat(F.lit("716F6966"), be(w), be(h))).otherwise(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w), be(h))))
    rows = table(spark, sf, "part").select("p_partkey", content.alias("content"))
    return _mapped(rows, lambda k, c: [(i, " ".join(encode.aligned([], x, 4)[1:])) for i, x in zip(k, c, strict=True)], "p_partkey bigint, resample string")


@query("""WITH f AS (SELECT page_id, 'images/' || page_id || ['.png', '.JPG', '.txt', '', '.exr'][1 + page_id % 5] AS path FROM pages) SELECT page_id FROM f WHERE page_id % 5 IN (0, 1, 4) AND page_id % 7 <> 0""")
def wanted_images(spark, sf):
    """Sources S1 and S2: files with the extension of an image, without an excluded list."""
    end = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".txt", "", ".exr")]), (1 + F.col("page_id") % 5).cast("int"))
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("images/"), F.col("page_id").cast("string"), end).alias("path"))
    return encode.wanted(files, files.filter("page_id % 7 = 0").select("path")).select("page_id")


@query("SELECT p_partkey, 'again' AS what FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT -1 - p_partkey, 'gone' FROM part WHERE p_partkey % 10 = 0")
def stale_outputs(spark, sf):
    """Section 2.15: sources whose content or settings changed since their output, and outputs without a source."""
    part = F.col("p_partkey")
    files = table(spark, sf, "part").select(part.cast("string").alias("path"), F.col("p_name").cast("binary").alias("content"))
    none = files.select("path").withColumn("state", F.lit("none"))
    now = encode.stale(files, none, "v1").select("path", "state", (F.col("path").cast("bigint") % 3).alias("m"))
    before = encode.stale(files, none, "v0").select("path", "state", (F.col("path").cast("bigint") % 3).alias("m"))
    lost = files.filter("cast(path as bigint) % 10 = 0").select((-1 - F.col("path").cast("bigint")).cast("string").alias("path"), F.lit("x").alias("state"))
    made = now.filter("m = 0").drop("m").unionByName(before.filter("m = 1").drop("m")).unionByName(lost)
    again = encode.stale(files, made, "v1").select(F.col("path").cast("bigint").alias("p_partkey"), F.lit("again").alias("what"))
    return again.unionByName(encode.orphaned(files, made).select(F.col("path").cast("bigint").alias("p_partkey"), F.lit("gone").alias("what")))


@query("SELECT p_partkey AS image, p_partkey % 3 AS level FROM part WHERE p_partkey % 4 <> 1 UNION ALL SELECT o_orderkey, 7 FROM orders WHERE o_orderkey % 6 <> 5")
def displayable_images(spark, sf):
    """Section 2.9: the union of several sources' images without those that failed."""
    part = F.col("p_partkey")
    shown = lambda t, key, level, bad: slices.displayable(table(spark, sf, t).select(F.col(key).alias("image"), level.cast("bigint").alias("level")), table(spark, sf, t).filter(bad).select(F.col(key).alias("image")))
    return shown("part", "p_partkey", part % 3, part % 4 == 1).unionByName(shown("orders", "o_orderkey", F.lit(7), F.col("o_orderkey") % 6 == 5))


@query("""WITH v AS (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id * 37 % 1023 + 0.25) * pow(2.0, event_id % 45 - 30))::FLOAT AS v FROM events), a AS (SELECT *, abs(v)::DOUBLE AS a FROM v), e AS (SELECT *, floor(log2(a))::BIGINT AS e0 FROM a)
, x AS (SELECT *, CASE WHEN pow(2.0, e0) > a THEN e0 - 1 WHEN pow(2.0, e0 + 1) <= a THEN e0 + 1 ELSE e0 END AS e FROM e)
, m AS (SELECT *, CASE WHEN e < -14 THEN a * 16777216.0 ELSE (a / pow(2.0, e) - 1) * 1024 END AS s, CASE WHEN e < -14 THEN 0 ELSE e + 15 END AS b FROM x)
SELECT event_id, ((v < 0)::BIGINT * 32768 + CASE WHEN e > 15 THEN 31744 ELSE b * 1024 + floor(s + 0.5)::BIGINT END) AS near, ((v < 0)::BIGINT * 32768 + CASE WHEN e > 15 THEN 31744 ELSE b * 1024 + floor(s)::BIGINT END) AS cut FROM m""")
def pack_half(spark, sf):
    """Projection P4: floats of both signs, small, large and beyond range, to half floats, rounded and cut."""
    event = F.col("event_id")
    from ..functions import pixels

    v = (F.when(event % 2 == 0, 1).otherwise(-1) * (event * 37 % 1023 + 0.25) * F.pow(F.lit(2.0), event % 45 - 30)).cast("float")
    return table(spark, sf, "events").select("event_id", pixels.half_of(v).alias("near"), pixels.half_of(v, cut=True).alias("cut"))


@query("""WITH v AS (SELECT event_id, [(event_id * 7 % 511) * pow(2.0, event_id % 9 - 5), (event_id * 13 % 300) * pow(2.0, event_id % 7 - 4), (event_id % 200) * 0.5] AS v FROM events), t AS (SELECT *, list_max(v) AS top FROM v)
, e AS (SELECT *, CASE WHEN top > 0 THEN greatest(floor(log2(top))::BIGINT, -16) + 16 ELSE 0 END AS e0 FROM t), f AS (SELECT *, e0 + (floor(top / pow(2.0, e0 - 24) + 0.5) >= 512)::INT AS e FROM e)
SELECT event_id, floor(v[1] / pow(2.0, e - 24) + 0.5)::BIGINT + floor(v[2] / pow(2.0, e - 24) + 0.5)::BIGINT * 512 + floor(v[3] / pow(2.0, e - 24) + 0.5)::BIGINT * 262144 + e * 134217728 AS word FROM f""")
def pack_9e5(spark, sf):
    """Projection P5: three mantissas under one exponent."""
    event = F.col("event_id")
    from ..codecs import astc_hdr

    p = lambda n: F.pow(F.lit(2.0), n)
    rows = table(spark, sf, "events").select("event_id", ((event * 7 % 511) * p(event % 9 - 5)).alias("r"), ((event * 13 % 300) * p(event % 7 - 4)).alias("g"), ((event % 200) * 0.5).alias("b"))
    return _mapped(rows, lambda e, r, g, b: list(zip(e, astc_hdr.nine_e5(np.array([r, g, b]).T.reshape(-1, 3), True).tolist(), strict=True)), "event_id bigint, word bigint")


@query("""WITH c AS (SELECT event_id, event_id * 7919 % 65536 AS c FROM events), m AS (SELECT *, c & 2047 AS m FROM c)
SELECT event_id, least(31743, (c >> 11) * 1024 + (CASE WHEN m < 512 THEN 3 * m WHEN m < 1536 THEN 4 * m - 512 ELSE 5 * m - 2048 END >> 3)) AS half FROM m""")
def qlog_to_half(spark, sf):
    """Projection P6: the HDR end points' pseudo-logarithm to half floats."""
    event = F.col("event_id")
    from ..codecs import astc_hdr

    rows = table(spark, sf, "events").select("event_id", (event * 7919 % 65536).alias("c"))
    return _mapped(rows, lambda e, c: list(zip(e, astc_hdr._hdr_half(np.array(c, np.int64)).tolist(), strict=True)), "event_id bigint, half bigint")


def _endpoint_sql() -> str:
    spread = ", ".join(f"({r}, {3 if t else 5 if q else 1}, {n}, '{uastc.SPREAD[3 if t else 5, n][0] if t or q else ''}', {uastc.SPREAD[3 if t else 5, n][1] if t or q else 0})" for r, (n, t, q) in enumerate(uastc.RANGES) if 4 <= r <= 20)
    b = "list_sum([CASE WHEN pattern[k] = '0' THEN 0 ELSE ((code >> (ord(pattern[k]) - 97)) & 1) << (9 - k)::INT END for k in range(1, 10)])::BIGINT"
    repl = "(code << (8 - n)::INT) | CASE WHEN 2 * n >= 8 THEN code >> (2 * n - 8)::INT ELSE (code << greatest(0, 8 - 2 * n)::INT) | CASE WHEN 3 * n >= 8 THEN code >> (3 * n - 8)::INT ELSE code << greatest(0, 8 - 3 * n)::INT END END"
    return f"""WITH r(range, radix, n, pattern, c) AS (VALUES {spread}), v AS (SELECT *, unnest(generate_series(0, radix * (1 << n) - 1)) AS code FROM r)
, t AS (SELECT *, (code & 1) * 511 AS a, (code >> n) * c + CASE WHEN radix > 1 THEN {b} ELSE 0 END AS t FROM v)
SELECT range, code, CASE WHEN radix = 1 THEN {repl} ELSE (a & 128) | (xor(t, a) >> 2) END::BIGINT AS value FROM t"""


@query(_endpoint_sql())
def endpoint_dequant(spark, sf):
    """Projection P10: all codes of the end point ranges 4 to 20, on the scale 0..255."""
    return _mapped(spark.range(4, 21), lambda r: [(k, c, int(v)) for k in r for c, v in enumerate(uastc.endpoint_table(k))], "range int, code bigint, value bigint")


@query("SELECT vec_id, 64 AS same FROM embeddings WHERE len(embedding) = 64")
def uastc_as_astc(spark, sf):
    """Codecs B11, B25 and B30: UASTC blocks written as ASTC, read by the decoder of that layout: the same texels."""
    from ..codecs import astc, astc_hdr

    def run(key, vector):
        modes = [k for k in range(19) if k != uastc.SOLID]
        out = []
        for i, v in zip(key, vector, strict=True):
            blocks = []
            for n in range(4):
                k = modes[(i + n) % 18]
                m = uastc.MODES[k]
                of = np.abs(np.array(v[16 * n : 16 * n + 16]) * 1e4).astype(int)
                levels = len(uastc.endpoint_table(m.endpoint_range))
                codes = [int(of[j % 16] * (j + 3)) % levels for j in range(m.components * 2 * m.subsets)]
                weights = [[int(of[t] * (p + 1)) % (1 << (m.weight_bits - 1)) for p in range(m.planes)] for t in range(16)]
                blocks.append(written.uastc_block(k, i % {0: 1, 4: 11}.get(m.pattern_bits, 19), codes, weights, i % 4))
            raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)
            want = uastc.texels(raw).astype(int)
            got = astc_hdr.unorm8(astc.pack(raw), (4, 4))
            out.append((i, int((want == got).all(2).sum())))
        return out

    rows = table(spark, sf, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")
    return _mapped(rows, run, "vec_id bigint, same int")


@query("SELECT event_id, event_id % 256 AS r, event_id * 3 % 256 AS g, user_id % 256 AS b, (event_id + user_id) % 256 AS a FROM events")
def bc7_solid_blocks(spark, sf):
    """Codecs B28 and B29: blocks of one colour keep it exactly."""
    event = F.col("event_id")
    from ..codecs import bc, bc7

    u = F.col("user_id")

    def run(key, *rgba):
        t = np.repeat(np.array(rgba, np.uint8).T.reshape(-1, 1, 4), 16, axis=1)
        got = bc7.texels(bc.pack_bc7(t)).astype(int)
        return [(k, *row) for k, row in zip(key, got.min(1).tolist(), strict=True)]

    rows = table(spark, sf, "events").select("event_id", event % 256, event * 3 % 256, u % 256, (event + u) % 256)
    return _mapped(rows.toDF("event_id", "r", "g", "b", "a"), run, "event_id bigint, r bigint, g bigint, b bigint, a bigint")


@query("WITH px AS (SELECT vec_id, i, least(255, greatest(0, floor(e::DOUBLE * 255)::BIGINT + 128)) AS v FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS i, unnest(embedding) AS e FROM embeddings WHERE len(embedding) = 64)) SELECT vec_id, max(v) - min(v) AS span, true AS bc1, true AS bc7, true AS etc1 FROM px WHERE i < 16 GROUP BY vec_id")
def packed_block_errors(spark, sf):
    """Codecs B8, B28 and B29, aggregates A4 and A5: grey blocks packed and read again stay within the format's steps."""
    from ..codecs import bc, bc7, etc1

    def run(key, vector):
        v = np.clip(np.floor(np.array(vector, float)[:, :16] * 255).astype(int) + 128, 0, 255)
        span = np.ptp(v, axis=1)
        grey = np.repeat(v[:, :, None], 4, axis=2).astype(np.uint8)
        off = lambda t: np.abs(t[..., :3].astype(int) - v[:, :, None]).max((1, 2))
        limits = {"bc1": span / 6 + 10, "bc7": span / 30 + 3, "etc1": span / 2 + 12}
        got = {"bc1": bc.bc1_texels(bc.bc1(grey[..., :3])), "bc7": bc7.texels(bc.pack_bc7(grey)), "etc1": etc1.texels(etc1.pack(grey[..., :3]))}
        within = [(off(t) <= limits[n]).tolist() for n, t in got.items()]
        return list(zip(key, span.tolist(), *within, strict=True))

    rows = table(spark, sf, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")
    return _mapped(rows, run, "vec_id bigint, span bigint, bc1 boolean, bc7 boolean, etc1 boolean")
