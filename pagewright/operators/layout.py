"""Layout: raw detections to regions with roles, crops, and reading order by recursive cuts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp
from ..schemas import layout_classes

SCORE, PAD, SMALL_HEIGHT, UPSCALE = 0.4, 6, 90, 2
GAP = np.float32(0.02)


def regions(detections: DataFrame, threshold: float = SCORE) -> DataFrame:
    """Regions of detections: the first valid_count rows (all if null), known classes, scores not under the threshold,
    boxes truncated and held to 0 on the left and top, degenerate ones dropped. A score that is no number passes."""
    dim = F.broadcast(layout_classes(detections.sparkSession))
    known = detections.where("valid_count is null or det_no < valid_count").where(~(F.col("score") < threshold) | F.isnan("score")).join(dim, "class_id")
    boxed = known.withColumns(
        {"left": F.greatest(F.lit(0), F.col("x1").cast("int")), "top": F.greatest(F.lit(0), F.col("y1").cast("int")), "right": F.col("x2").cast("int"), "bottom": F.col("y2").cast("int")}
    )
    return boxed.where("right > left and bottom > top").drop("x1", "y1", "x2", "y2", "valid_count")


def crops(regions: DataFrame, width: str = "width", height: str = "height", pad: int = PAD) -> DataFrame:
    """Adds the crop of each region that is not skipped: padded, held to the page, at least one pixel; small ones are to be
    scaled up. Regions beyond the page's edge keep no crop and are dropped."""
    kept = regions.where("role <> 'SKIP'")
    w, h = F.col(width), F.col(height)
    kept = kept.withColumns({"crop_left": clamp(F.col("left") - pad, 0, F.greatest(w - 1, F.lit(0))), "crop_top": clamp(F.col("top") - pad, 0, F.greatest(h - 1, F.lit(0)))})
    kept = kept.withColumns({"crop_right": F.least(F.greatest(F.col("right") + pad, F.col("crop_left") + 1), w), "crop_bottom": F.least(F.greatest(F.col("bottom") + pad, F.col("crop_top") + 1), h)})
    small = F.col("crop_bottom") - F.col("crop_top") < SMALL_HEIGHT
    return kept.where("crop_right > crop_left and crop_bottom > crop_top").withColumn("coord_scale", F.when(small, UPSCALE).otherwise(1))


def line_crops(lines: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Adds the crop of each text line: held to the page, at least one pixel, without padding."""
    w, h = F.col(width), F.col(height)
    held = lines.withColumns({"crop_left": clamp(F.col("left"), 0, w - 1), "crop_top": clamp(F.col("top"), 0, h - 1)})
    return held.withColumns({"crop_right": F.least(F.greatest(F.col("right"), F.col("crop_left") + 1), w), "crop_bottom": F.least(F.greatest(F.col("bottom"), F.col("crop_top") + 1), h)})


def detected(pages: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Detections of a model's output column: arrays of class, score and four edges, in order. Pages without any have no row."""
    each = pages.select(*keys, F.posexplode(rows).alias("det_no", "d"))
    names = ("class_id", "score", "x1", "y1", "x2", "y2")
    wide = each.where(F.size("d") >= len(names))
    return wide.select(*keys, "det_no", F.get("d", F.lit(0)).cast("int").alias("class_id"), *[F.get("d", F.lit(i)).alias(n) for i, n in enumerate(names) if i], F.lit(None).cast("int").alias("valid_count"))


def analysed(pages: DataFrame, keys: Sequence[str], rows: str, threshold: float = SCORE) -> DataFrame:
    """A layout model's output as regions in reading order."""
    return reading_order(regions(detected(pages, keys, rows), threshold), keys, ["det_no"])


def _bands(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Band number of each interval."""
    order = np.argsort(start, kind="stable")
    far = np.maximum.accumulate(end[order])
    gap = max(1, int(np.float32(max(1, end.max() - start.min())) * GAP))
    out = np.empty(len(start), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(start[order][1:] - far[:-1] >= gap)])
    return out


def read_order(boxes: np.ndarray) -> list[int]:
    """Rows of boxes (left, top, right, bottom) in reading order. A group is cut at gaps of its preferred axis, rows first;
    its parts then prefer the other axis. If only the other axis has gaps, the parts keep the preference. A group without
    gaps is read by top and left."""
    out: list[int] = []
    waiting = [(np.arange(len(boxes)), True)]
    while waiting:
        own, rows_first = waiting.pop()
        if len(own) > 1:
            for across, then in ((rows_first, not rows_first), (not rows_first, rows_first)):
                band = _bands(boxes[own, 1 if across else 0], boxes[own, 3 if across else 2])
                if band.max() > 0:
                    by_start = own[np.argsort(boxes[own, 1 if across else 0], kind="stable")]
                    number = dict(zip(own.tolist(), band.tolist()))
                    parts = [[i for i in by_start.tolist() if number[i] == b] for b in range(band.max() + 1)]
                    waiting += [(np.array(p), then) for p in reversed(parts)]
                    break
            else:
                out += own[np.lexsort((boxes[own, 0], boxes[own, 1]))].tolist()
        else:
            out += own.tolist()
    return out


def _ordered(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in lists:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in batch.to_pylist()])]) if len(batch) else [0]
        flat = batch.flatten()
        boxes = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("left", "top", "right", "bottom")], 1) if len(flat) else np.empty((0, 4), np.int64)
        places = []
        for a, b in zip(starts[:-1], starts[1:]):
            order = read_order(boxes[a:b])
            place = [0] * len(order)
            for p, i in enumerate(order):
                place[i] = p
            places.append(place)
        yield pa.array(places, pa.list_(pa.int32()))


def reading_order(regions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds reading_no to the regions of each page (keys), whose rows come in the given order.

    One shuffle brings a page's regions together as a list (a page has dozens at most); the recursion runs in Arrow
    batches of pages, so its cost is per region and not per call."""
    fields = [F.col(c).cast("long").alias(c) if c in ("left", "top", "right", "bottom") else F.col(c) for c in regions.columns if c not in keys]
    listed = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("r")))).alias("_l"))
    boxes = F.transform("_l", lambda x: F.struct(*[x["r"][c].alias(c) for c in ("left", "top", "right", "bottom")]))
    placed = listed.select(*keys, F.col("_l.r").alias("_l"), F.arrow_udf(_ordered, "array<int>")(boxes).alias("_p"))
    return placed.select(*keys, F.explode(F.arrays_zip("_l", "_p")).alias("x")).select(*keys, "x._l.*", F.col("x._p").alias("reading_no"))
