"""Steady frames of camera sessions: the batch form by windows, and the stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geometry import distance
from ..operators.shapes import area

STABLE_FRAMES, AREA, BLUR, JITTER = 8, 0.35, 45.0, 14.0
OUTPUT = "session_id long, frame_no long, stable_count int, stable boolean, captured boolean"
STATE = "count int, corners array<struct<x:double,y:double>>, capturing boolean"


def usable(frames: DataFrame, least_area: float = AREA, least_blur: float = BLUR) -> DataFrame:
    """Adds ok: a quad was found, it is large enough and the frame sharp enough. Done before any state is kept."""
    good = F.col("corners").isNotNull() & (area(F.col("corners")) >= F.col("frame_area") * least_area) & (F.col("blur_variance") >= least_blur)
    return frames.withColumn("ok", F.coalesce(good, F.lit(False)))


def stable_frames(frames: DataFrame, needed: int = STABLE_FRAMES, least_area: float = AREA, least_blur: float = BLUR, jitter: float = JITTER) -> DataFrame:
    """session_id, frame_no, stable_count, stable for each frame. The count starts anew at every frame that isn't usable (0)
    or whose corners jump from the frame before (1); from ``needed`` on every frame is stable."""
    order = Window.partitionBy("session_id").orderBy("ts", "frame_no")
    last = F.lag(F.struct("ok", "corners")).over(order)
    far = F.exists(F.zip_with("corners", last["corners"], lambda a, b: distance(a["x"], a["y"], b["x"], b["y"])), lambda d: d > jitter)
    rows = usable(frames, least_area, least_blur).withColumn("_new", ~F.col("ok") | ~F.coalesce(last["ok"], F.lit(False)) | F.coalesce(far, F.lit(True)))
    runs = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.row_number().over(Window.partitionBy("session_id", "_run").orderBy("ts", "frame_no"))
    counted = runs.withColumn("stable_count", F.when(F.col("ok"), count).otherwise(0).cast("int"))
    return counted.select("session_id", "frame_no", "ts", "stable_count", (F.col("stable_count") >= needed).alias("stable"))


class SteadyFrames(StatefulProcessor):
    """Keeps the count, the last corners and whether a capture is under way. captured is true on the first stable frame of an
    episode; a frame that breaks the run ends the episode, and so does a row with control = 'reset'."""

    def __init__(self, needed: int = STABLE_FRAMES, jitter: float = JITTER) -> None:
        self.needed, self.jitter = needed, jitter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("steady", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, corners, capturing = self.state.get() if self.state.exists() else (0, None, False)
        corners = None if corners is None else [(c[0], c[1]) for c in corners]
        out = []
        frames = pd.concat(list(rows)).sort_values(["ts", "frame_no"], kind="stable")
        for f in frames.itertuples():
            if getattr(f, "control", None) == "reset" or not f.ok:
                count, corners, capturing = 0, None, False
            else:
                now = [(c["x"], c["y"]) for c in f.corners]
                near = corners is not None and all(((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= self.jitter for (a, b), (c, d) in zip(now, corners))
                count, corners = (count + 1 if near else 1), now
                capturing = capturing and near
            stable = count >= self.needed
            out.append((key[0], f.frame_no, count, stable, stable and not capturing))
            capturing = capturing or stable
        self.state.update((count, corners, capturing))
        yield pd.DataFrame(out, columns=["session_id", "frame_no", "stable_count", "stable", "captured"])

    def close(self) -> None:
        pass


def steady_stream(frames: DataFrame, needed: int = STABLE_FRAMES, least_area: float = AREA, least_blur: float = BLUR, jitter: float = JITTER) -> DataFrame:
    """The same as a stream: frames is a streaming table of usable()'s input. Frames of a batch are taken by time; a frame
    that comes in a later batch than a newer one counts as new, as there is no event-time order across batches. Needs the
    RocksDB state store."""
    checked = usable(frames, least_area, least_blur)
    return checked.groupBy("session_id").transformWithStateInPandas(SteadyFrames(needed, jitter), OUTPUT, "Append", "None")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
