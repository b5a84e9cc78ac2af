import hashlib
import struct
import sys
import time

import pytest

from texelflow.operators import encode

SCRIPT = """
import subprocess, sys, time
out, source = sys.argv[sys.argv.index("-output_file") + 1], sys.argv[-1]
data = open(source, "rb").read()
if data == b"slow":
    subprocess.Popen(["sleep", "60"]); time.sleep(60)
if data == b"loud":
    print("x" * 5000)
if data == b"bad":
    open(out, "wb").write(b"half"); sys.exit("broken image")
open(out, "wb").write(b"sB" + data + " ".join(sys.argv[1:-3]).encode())
print("done")
"""


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s2I", 13, b"IHDR", w, h)


def test_runs_are_bounded(spark, tmp_path):
    script = tmp_path / "encoder.py"
    script.write_text(SCRIPT)
    rows = [("a/x.PNG", bytearray(png(5, 8))), ("a/even.png", bytearray(png(4, 8))), ("slow.png", bytearray(b"slow")), ("loud.png", bytearray(b"loud")), ("bad.png", bytearray(b"bad")), ("null.png", None), ("skip.png", bytearray(b"")), ("notes.txt", bytearray(b"")), ("png", bytearray(b""))]
    df = spark.createDataFrame(rows, "path string, content binary")
    images = encode.wanted(df, spark.createDataFrame([("skip.png",), ("skip.png",)], "path string"))
    begun = time.monotonic()
    got = {r["path"]: r for r in encode.encode(images, [sys.executable, str(script)], ["-q", "9"], alignment=4, seconds=3, log_bytes=1000).collect()}
    assert time.monotonic() - begun < 55
    assert set(got) == {"a/x.PNG", "a/even.png", "slow.png", "loud.png", "bad.png", "null.png"}
    assert bytes(got["a/x.PNG"]["payload"]) == b"sB" + png(5, 8) + b"-q 9 -resample 8 8" and got["a/x.PNG"]["output"] == "a/x.PNG.basis"
    assert bytes(got["a/even.png"]["payload"]).endswith(b"-q 9") and got["a/even.png"]["log"] == "done\n"
    assert "longer" in got["slow.png"]["error"] and "log above" in got["loud.png"]["error"] and "broken image" in got["bad.png"]["error"]
    assert all(got[k]["payload"] is None for k in ("slow.png", "loud.png", "bad.png")) and bytes(got["null.png"]["payload"]) == b"sB-q 9"


def test_explicit_resampling_stays():
    assert encode.aligned(["-resample", "1", "1"], png(5, 5), 4) == ["-resample", "1", "1"] and encode.aligned([], b"?", 4) == []


def test_empty_output_and_processes_left_behind(spark, tmp_path):
    script = tmp_path / "left.py"
    script.write_text("""
import subprocess, sys
out, data = sys.argv[sys.argv.index("-output_file") + 1], open(sys.argv[-1], "rb").read()
if data == b"left":
    subprocess.Popen(["sleep", "45"], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    import time; time.sleep(0.6)
open(out, "wb").write(b"" if data == b"none" else data)
""")
    df = spark.createDataFrame([(k, bytearray(k.encode())) for k in ("none", "left", "good")], "path string, content binary")
    got = {r["path"]: r for r in encode.encode(df, [sys.executable, str(script)]).collect()}
    assert got["none"]["error"] == "encoder made an empty file" and bytes(got["good"]["payload"]) == b"good"
    assert got["left"]["error"] == "encoder ended before processes that it started"
    running = [p for own in encode._children().values() for p, _ in own if b"sleep\x0045" in _command(p)]
    assert not running


def _command(pid):
    try:
        with open(f"/proc/{pid}/cmdline", "rb") as f:
            return f.read()
    except OSError:
        return b""


def test_shipped_encoder(tmp_path):
    program = b"#!/bin/sh\necho shipped\n"
    good = hashlib.sha256(program).hexdigest()
    at = encode.verified(program, good.upper(), str(tmp_path))
    assert encode.bounded([at], str(tmp_path), 10, 1000).strip() == "shipped"
    for wrong in (good, "0" * 64, "xyz", None):  # a file that is there is never written into
        with pytest.raises(OSError):
            encode.verified(program, wrong, str(tmp_path))
