"""Decoders behind SQL: a table function over container bytes, with a decoder of choice behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

Image = tuple[int, int, int, int, bytes]


@dataclass(frozen=True)
class Backend:
    """decode(content, target, image or None) gives (image, level, width, height, payload); None: there is no decoder."""

    name: str
    decode: Callable[[bytes, str, int | None], Iterator[Image]] | None = None

    @property
    def available(self) -> bool:
        return self.decode is not None

    def images(self, content: bytes, target: str, image: int | None) -> Iterator[Image]:
        if self.decode is None:
            raise ValueError(f"{self.name} has no decoder; register one")
        yield from self.decode(content, target, image)


def default() -> Backend:
    """This package's readers."""
    from ..operators.transcode import of_bytes

    return Backend("texelflow", of_bytes)


MISSING = Backend("missing")
OUT = "image int, level int, width int, height int, payload binary, error string"


def register(spark: SparkSession, name: str = "texture_images", backend: Backend | None = None) -> None:
    """Makes name(content, target, image) a table function of the session: OUT rows; a fault is a row with `error`.

    image is null for all images. In SQL: SELECT ... FROM files f, LATERAL texture_images(f.content, 'RGBA8', NULL)."""
    chosen = backend or default()

    class TextureImages:
        def eval(self, content, target, image):
            from texelflow.operators.transcode import FAULTS

            try:
                for found in chosen.images(bytes(content or b""), target, image):
                    yield *found, None
            except FAULTS as e:
                yield None, None, None, None, None, str(e) or "malformed"

    spark.udtf.register(name, udtf(TextureImages, returnType=OUT))
