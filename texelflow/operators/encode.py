"""Runs an external texture encoder over many images: bounded in time, log and output, one row per image.

Files are told apart and given their place as tables (sources S2 and S3, join J7); each task runs the encoder on its own
images in a folder of its own, and gives the encoded bytes back as a column, so nothing is left on a machine."""

from __future__ import annotations

import hashlib
import os
import re
import signal
import struct
import subprocess
import tempfile
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder that an image is encoded in is one of the task's machine, as the external program needs files; it goes
#: with the image, and only columns leave the task.

#: Extensions of source images, and bounds of the limits.
EXTENSIONS = ("png", "jpg", "jpeg", "tga", "qoi", "hdr", "exr")
MOST_SECONDS, SECONDS, LOG_BYTES = 86400, 300, 1 << 20
OUT = "path string, output string, payload binary, log string, error string"
NAMES = ("path", "output", "payload", "log", "error")
POLL = 0.05


def wanted(files: DataFrame, excluded: DataFrame | None = None, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Files (path, ...) with a wanted extension, but for those whose path `excluded` (path) lists."""
    kept = files.filter(F.lower(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", -1)).isin(*extensions) & F.element_at(F.split("path", "/"), -1).contains("."))
    return kept if excluded is None else kept.join(excluded.select("path").distinct(), "path", "left_anti")


def size_of(content: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG or QOI image; null of others."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">2I", content[16:24])
    if content[:4] == b"qoif" and len(content) >= 12:
        return struct.unpack(">2I", content[4:12])
    return None


def aligned(arguments: Sequence[str], content: bytes, alignment: int) -> list[str]:
    """The arguments, with a resampling to the next multiples if the image needs one and none is asked for."""
    size = size_of(content) if alignment > 1 and not {"-resample", "-resample_factor"} & set(arguments) else None
    up = size and tuple(-(-v // alignment) * alignment for v in size)
    return [*arguments, "-resample", *map(str, up)] if size and up != size else list(arguments)


def _children() -> dict[int, list[tuple[int, str]]]:
    """(process, start time) by parent, of all processes of this machine."""
    out: dict[int, list[tuple[int, str]]] = {}
    for name in os.listdir("/proc") if os.path.isdir("/proc") else ():
        if name.isdigit():
            try:
                with open(f"/proc/{name}/stat", "rb") as f:
                    rest = f.read().rpartition(b")")[2].split()
            except OSError:
                continue
            out.setdefault(int(rest[1]), []).append((int(name), rest[19].decode()))
    return out


def _descendants(pid: int) -> set[tuple[int, str]]:
    """Those of a running process, in whatever session they are."""
    children, found, todo = _children(), set(), [pid]
    while todo:
        for child in children.get(todo.pop(), ()):
            if child not in found:
                found.add(child)
                todo.append(child[0])
    return found


def _alive(found: set[tuple[int, str]]) -> list[int]:
    """Which of them still run: a number that another process has by now doesn't count."""
    now = {c for own in _children().values() for c in own}
    return [pid for pid, start in found if (pid, start) in now]


def bounded(command: Sequence[str], folder: str, seconds: float, log_bytes: int) -> str:
    """Runs a command and gives its log. It and all it starts end with the time or the log's room (TimeoutError, OSError);
    a command that ends before what it started is a fault too."""
    log = os.path.join(folder, "log")
    with open(log, "wb") as sink:
        process = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=sink, stderr=subprocess.STDOUT, cwd=folder, start_new_session=True)
        end = time.monotonic() + seconds
        seen: set[tuple[int, str]] = set()
        try:
            while process.poll() is None:
                seen |= _descendants(process.pid)
                if os.path.getsize(log) > log_bytes:
                    raise OSError(f"log above {log_bytes} bytes")
                if time.monotonic() > end:
                    raise TimeoutError(f"encoder ran longer than {seconds} s")
                time.sleep(POLL)
            if _alive(seen):
                raise OSError("encoder ended before processes that it started")
        finally:
            for pid in _alive(seen):
                try:
                    os.kill(pid, signal.SIGKILL)
                except ProcessLookupError:
                    pass
            try:
                os.killpg(process.pid, signal.SIGKILL)  # descendants too
            except ProcessLookupError:
                pass
            process.wait()
    if os.path.getsize(log) > log_bytes:
        raise OSError(f"log above {log_bytes} bytes")
    with open(log, "rb") as source:
        text = source.read().decode("utf-8", "replace")
    if process.returncode:
        raise OSError(f"encoder ended with {process.returncode}: {text[-2000:]}")
    return text


def verified(program: bytes, sha256: str, folder: str) -> str:
    """Puts a shipped encoder into the folder and gives its place: only if its SHA-256 is the one stated."""
    if not re.fullmatch(r"[0-9a-fA-F]{64}", sha256 or ""):
        raise OSError("no valid SHA-256 of the encoder")
    if hashlib.sha256(program).hexdigest() != sha256.lower():
        raise OSError("the encoder's SHA-256 is another")
    at = os.path.join(folder, "encoder")
    with open(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o700), "wb") as f:  # never into a file that is there
        f.write(program)
    return at


def stale(files: DataFrame, made: DataFrame, settings: str) -> DataFrame:
    """Files (path, content) to encode again, with the state to keep: those whose content or settings (encoder, arguments) differ
    from `made` (path, state), the states of the outputs there are."""
    state = F.sha2(F.concat(F.lit(settings + "\n").cast("binary"), F.coalesce("content", F.lit(b""))), 256)
    rows = files.withColumn("state", state)
    return rows.join(made.select("path", "state"), ["path", "state"], "left_anti")


def orphaned(files: DataFrame, made: DataFrame) -> DataFrame:
    """Outputs (path, ...) whose source is gone; they are to be removed."""
    return made.join(files.select("path"), "path", "left_anti")


def encode(files: DataFrame, encoder: Sequence[str], arguments: Sequence[str] = (), alignment: int = 1, seconds: float = SECONDS, log_bytes: int = LOG_BYTES) -> DataFrame:
    """OUT rows of images (path, content): `encoder` [arguments] -output_file OUT IN. A failed image is a row with its fault.

    output is the path with `.basis` after it. Null content is an empty image."""
    if alignment < 1 or not 1 <= seconds <= MOST_SECONDS or log_bytes < 1:
        raise ValueError("alignment from 1, seconds from 1 to a day, log bytes from 1")

    def one(path: str | None, content: bytes) -> tuple:
        with tempfile.TemporaryDirectory() as folder:
            source, output = os.path.join(folder, "in" + os.path.splitext(path or "")[1]), os.path.join(folder, "out.basis")
            with open(source, "wb") as sink:
                sink.write(content)
            named = None if path is None else path + ".basis"
            try:
                log = bounded([*encoder, *aligned(arguments, content, alignment), "-output_file", output, source], folder, seconds, log_bytes)
                with open(output, "rb") as made:
                    payload = made.read()
                if not payload:
                    raise OSError("encoder made an empty file")
                return path, named, payload, log, None
            except OSError as e:  # partial output goes with the folder
                return path, named, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one(r["path"], bytes(r["content"] or b"")), kinds, strict=True)], list(NAMES))

    return files.select("path", "content").mapInArrow(run, OUT)
