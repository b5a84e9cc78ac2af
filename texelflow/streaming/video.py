"""Texture video: each frame's blocks are coded against the frame before, at the same place.

State per (path, level, alpha) is the last frame's packed end point and selector of each block. In a batch each block
is a group of its own, whose last change up to a frame is its value there, so a long or large video is spread over
tasks; a stream keeps the last frame between batches and folds the ordered frames of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["path", "level", "is_alpha"]
OUT = "path string, level int, is_alpha boolean, frame int, blocks array<int>"


def step(state: np.ndarray | None, places, values, blocks: int) -> np.ndarray:
    """The next frame: changed places get their value, all others stay."""
    out = np.zeros(blocks, np.int64) if state is None else state.copy()
    out[np.asarray(places, np.int64)] = np.asarray(values, np.int64)
    return out


def _folded(pdf: pd.DataFrame, state: np.ndarray | None) -> tuple[pd.DataFrame, np.ndarray | None]:
    rows = []
    for r in pdf.sort_values("frame").itertuples():
        state = step(state, r.places, r.values_, r.n_blocks)
        rows.append((r.path, r.level, r.is_alpha, r.frame, state.tolist()))
    return pd.DataFrame(rows, columns=["path", "level", "is_alpha", "frame", "blocks"]), state


def frames(deltas: DataFrame) -> DataFrame:
    """All frames from deltas (key, frame, n_blocks, places, values_); blocks that never changed are 0."""
    each = deltas.select(*KEY, "frame", F.posexplode(F.arrays_zip("places", "values_")).alias("nth", "c"))
    last = F.max_by("c.values_", "nth").alias("value")  # of several changes of a block in one frame
    changes = each.groupBy(*KEY, "frame", F.col("c.places").alias("place")).agg(last)
    grid = deltas.select(*KEY, "frame", F.posexplode(F.array_repeat(F.lit(0), F.col("n_blocks"))).alias("place", "none")).drop("none")
    so_far = Window.partitionBy(*KEY, "place").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.last("value", ignorenulls=True).over(so_far), F.lit(0)).cast("int")
    rows = grid.join(changes, [*KEY, "frame", "place"], "left").withColumn("value", value)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])  # one frame's
    return rows.groupBy(*KEY, "frame").agg(whole.alias("blocks"))


def streamed(deltas: DataFrame) -> DataFrame:
    """The same over a stream whose micro-batches bring the frames in order."""

    def update(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = np.array(state.get[0], np.int64) if state.exists else None
        whole = pd.concat(list(pdfs))
        out, last = _folded(whole, last)
        state.update((last.tolist(),))
        yield out

    from pyspark.sql.streaming.state import GroupStateTimeout

    return deltas.groupBy(*KEY).applyInPandasWithState(update, OUT, "blocks array<int>", "append", GroupStateTimeout.NoTimeout)
