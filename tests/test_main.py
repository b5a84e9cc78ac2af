import pytest
from test_ktx2 import container

from texelflow.__main__ import main


def test_exit_codes(spark, tmp_path, capsys):
    source, out = tmp_path / "a.ktx2", tmp_path / "a.raw"
    source.write_bytes(container([bytes([9, 8, 7, 6])]))
    good = ["--input", str(source), "--output", str(out), "--format", "rgba8"]
    assert main(good, spark) == 0 and out.read_bytes() == bytes([9, 8, 7, 6])
    assert "OK format=RGBA8 width=2 height=2 bytes=4" in capsys.readouterr().out
    assert main(["--help"]) == 0
    assert main([*good[:-1], "BC7"], spark) == 1 and main(["--input", str(tmp_path / "none"), *good[2:]], spark) == 1
    assert main([*good, "--image-index", "5"], spark) == 1


@pytest.mark.parametrize("args", [[], ["--input", "x"], ["stray"], ["--input"], ["--nope", "1"], ["--input", "--output"], ["--input", "a", "--output", "b", "--format", "XYZ"], ["--input", "a", "--output", "b", "--format", "BC1", "--quality", "99"], ["--input", "a", "--output", "b", "--format", "BC1", "--strict", "maybe"], ["--input", "a", "--output", "b", "--format", "BC1", "--image-index", "-1"]])
def test_wrong_options(args):
    assert main(args) == 2
