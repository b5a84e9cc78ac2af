"""One container's image as raw bytes: python -m texelflow --input FILE --output FILE --format TARGET.

Exit codes: 0 done or help, 1 a container that can't be decoded or a file that can't be read, 2 wrong options."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.transcode import transcode
from .plans import catalog
from .sources.formats import colour_space

USAGE = "usage: --input FILE --output FILE --format TARGET [--image-index N] [--linear-color-space true|false] [--quality 0..10] [--threads 1..64] [--strict true|false] [--preset NAME] [--help]"
NEEDED = ("input", "output", "format")


def _whole(name: str, least: int, most: int | None = None) -> Callable[[str], int]:
    def read(value: str) -> int:
        try:
            n = int(value)
        except ValueError:
            raise ValueError(f"--{name} must be a whole number, not {value}") from None
        if n < least or most is not None and n > most:
            raise ValueError(f"--{name} is out of range")
        return n

    return read


def _truth(name: str) -> Callable[[str], bool]:
    def read(value: str) -> bool:
        if value.lower() not in ("true", "false"):
            raise ValueError(f"--{name} must be true or false, not {value}")
        return value.lower() == "true"

    return read


#: Reader and default of each option; quality, threads, strict and preset are checked and have no effect.
OPTIONS: dict[str, tuple[Callable, object]] = {
    "input": (str, None), "output": (str, None), "format": (str.upper, None), "image-index": (_whole("image-index", 0), 0), "linear-color-space": (_truth("linear-color-space"), True),
    "quality": (_whole("quality", 0, 10), 7), "threads": (_whole("threads", 1, 64), 1), "strict": (_truth("strict"), False), "preset": (str, None),
}


def options(args: Sequence[str]) -> dict[str, object]:
    found = {name: default for name, (_, default) in OPTIONS.items()}
    rest = iter(args)
    for arg in rest:
        if not arg.startswith("--") or arg[2:] not in OPTIONS:
            raise ValueError(f"unknown option {arg}")
        value = next(rest, None)
        if value is None or value.startswith("--"):
            raise ValueError(f"{arg} has no value")
        found[arg[2:]] = OPTIONS[arg[2:]][0](value)
    if any(found[n] is None for n in NEEDED):
        raise ValueError("--input, --output and --format are needed")
    if found["format"] not in catalog.TARGETS:
        raise ValueError(f"unknown format {found['format']}")
    return found


def main(args: Sequence[str], spark: SparkSession | None = None) -> int:
    if "--help" in args:
        print(USAGE)
        return 0
    try:
        o = options(args)
    except ValueError as e:
        print(f"Error: {e}\n{USAGE}", file=sys.stderr)
        return 2
    try:
        content = Path(o["input"]).read_bytes()
        spark = spark or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        file = spark.createDataFrame([(o["input"], bytearray(content))], "path string, content binary")
        rows = transcode(file, o["format"], o["image-index"]).orderBy(F.col("error").isNull(), "level").collect()  # one file's levels
        if not rows or rows[0]["error"]:
            raise OSError(rows[0]["error"] if rows else "no image")
        payload = b"".join(bytes(r["payload"]) for r in rows)
        Path(o["output"]).write_bytes(payload)
    except (OSError, PySparkException) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    space = colour_space(content) if o["linear-color-space"] else "sRGB"
    print(f"OK format={o['format']} width={rows[0]['width']} height={rows[0]['height']} bytes={len(payload)} colorSpace={space}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
