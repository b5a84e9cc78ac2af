"""Queries on tables larger than one file of a container takes."""

import duckdb
import numpy as np
import pytest

from texelflow.codecs import uastc
from texelflow.operators import transcode
from texelflow.plans.queries import ORACLES, QUERIES
from texelflow.plans.written import MODEL, BitWriter, ktx2_file
from texelflow.sources import ktx2


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """33000 customers of a nation and 20 of another, 17000 suppliers: more than an image's rows and a stored table's symbols."""
    at = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS c_custkey, (CASE WHEN range % 1651 = 7 THEN 3 ELSE 2 END)::INT AS c_nationkey FROM range(33020)) TO '{at}/customer.parquet'")
    con.execute(f"COPY (SELECT range AS s_suppkey FROM range(17000)) TO '{at}/supplier.parquet'")
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["etc1s_container_texels", "etc1s_as_etc1", "etc1s_as_bc5"])
def test_nations_of_several_files(spark, tables, tmp_path, name):
    at, con = tables
    QUERIES[name](spark, at).write.parquet(f"{tmp_path}/got")
    con.execute(f"CREATE OR REPLACE TABLE want AS {ORACLES[name]}")
    con.execute(f"CREATE OR REPLACE TABLE got AS SELECT {', '.join(c for c, *_ in con.execute('DESCRIBE want').fetchall())} FROM '{tmp_path}/got/*.parquet'")
    n, m = (con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("got", "want"))
    assert n == m >= 33020
    assert not con.execute("FROM got EXCEPT ALL FROM want").fetchall() and not con.execute("FROM want EXCEPT ALL FROM got").fetchall()


def test_tables_that_cannot_be_stored():
    with pytest.raises(ValueError):
        BitWriter().flat_table(1 << 14)


def described(path, content, targets):
    return ktx2.described(content) | {"path": path, "content": content, "targets": targets}


def solid(*rgba):
    w = BitWriter()
    w.put(0x17, 5)
    for v in rgba:
        w.put(v, 8)
    return w.done().ljust(16, b"\0")


TARGETS = ["RGB565", "BC5", "RGBA8", "BGR565", "BC6H", "RGBA4444", "ETC1"]


def test_many_small_files_share_their_decoding(monkeypatch):
    rows = [described(str(k), ktx2_file([solid(k % 256, 3, 7, 9) * 2], 5, 4, MODEL["UASTC_LDR_4x4"]), ["RGBA8", "RGB565"]) for k in range(600)]
    calls, texels = [], uastc.texels
    monkeypatch.setattr(uastc, "texels", lambda blocks: calls.append(len(blocks)) or texels(blocks))
    got = list(transcode.results(rows))
    assert calls == [1200]
    assert [(r[0], r[5]) for r in got] == [(str(k), t) for k in range(600) for t in ("RGBA8", "RGB565")]
    assert all(g[6] == bytes([k % 256, 3, 7, 9]) * 20 for k, g in enumerate(got[::2]))


def test_files_together_give_what_each_gives_alone():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        w, h, levels = int(rng.integers(1, 14)), int(rng.integers(1, 14)), 1 + k % 3
        blocks = [-(-max(1, w >> n) // 4) * -(-max(1, h >> n) // 4) for n in range(levels)]
        data = [b"".join(solid(*rng.integers(0, 256, 4).tolist()) for _ in range(n)) for n in blocks]
        if k % 7 == 3:
            data[-1] = data[-1][:-16] + bytes([127]) * 16  # a reserved mode
        if k % 11 == 5:
            data[-1] += bytes(16)  # a length that doesn't match
        rows.append(described(str(k), ktx2_file(data, w, h, MODEL["UASTC_LDR_4x4"]), TARGETS[k % 5 :] if k % 13 else []))
    rows.append({"path": "bad", "content": b"?", "targets": ["RGBA8"], "error": "too short for a header", "texture_format": None, "scheme": None})
    rows.append({"path": "none", "content": None, "targets": None, "error": "too short for a header", "texture_format": None, "scheme": None})
    alone = [row for r in rows for row in transcode.results([r], None)]
    plain = []
    for r in rows:
        for t in r["targets"] or ():
            try:
                plain += [(r["path"], *place, t, payload, None) for *place, payload in transcode.images(r, t, None)]
            except transcode.FAULTS:
                plain.append((r["path"], t))
    assert list(transcode.results(rows)) == alone
    faulty = {r[0] for r in alone if r[7]}
    assert "bad" in faulty and len(faulty) > 20
    assert [r for r in alone if r[0] not in faulty] == [r for r in plain if r[0] not in faulty]
    # images before a fault stay, and the fault comes after them
    one = next(r for r in rows if r["path"] == "5")
    got = list(transcode.results([one | {"targets": ["RGBA8"]}]))
    assert [r[2] for r in got] == [0, 1, None] and got[-1][7] == "UASTC block data size mismatch"
