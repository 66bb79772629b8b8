"""Arithmetic of boxes, corners and sizes, as column functions. Integer casts truncate, as the data model asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Means and deviations by channel for detectors; recognisers take 0.5 for both.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def turned(rotation: Column, by: Column) -> Column:
    return F.pmod(rotation + by, F.lit(360))


def detector_side(side: Column, longer: Column) -> Column:
    """A side of the detector's input: the longer one at most 960, each the nearest multiple of 32, at least 32."""
    scale = F.least(F.lit(1.0), F.lit(960.0) / longer)
    return F.greatest(F.lit(32), (half_up(side * scale / 32) * 32)).cast("int")


def recogniser_width(w: Column, h: Column, height: int = 48, most: int = 320) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), half_up(height * w.cast("double") / h))).cast("int")


def table_side(side: Column, longer: Column) -> Column:
    return clamp((side * (F.lit(488.0) / longer)).cast("int"), 1, 488)


def illumination_kernel(w: Column, h: Column) -> Column:
    size = F.greatest(F.lit(31), F.floor(F.least(w, h) / 8))
    return F.when(size % 2 == 0, size + 1).otherwise(size)


def ruling_kernel(side: Column) -> Column:
    return F.greatest(F.lit(15), F.floor(side / 20)).cast("int")


def normalised(v: Column, mean: float, deviation: float) -> Column:
    return (v / 255.0 - mean) / deviation


def denormalised(box: Column, scale: Column, w: Column, h: Column) -> Column:
    """A quad in image pixels: fractions of the 488-pixel input are scaled up first; even places are x, odd ones y."""
    shares = F.forall(box, lambda v: (v >= -0.05) & (v <= 2.0))
    return F.transform(F.when(shares, F.transform(box, lambda v: v * 488.0)).otherwise(box), lambda v, i: clamp(v / scale, 0.0, F.when(i % 2 == 0, w).otherwise(h).cast("double")))


def quadratic(a: Column, b: Column, c: Column, x: Column) -> Column:
    return a * x * x + b * x + c
