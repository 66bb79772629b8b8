"""Scan quality: blur, brightness and clipping of grey pictures, with a score and a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp

BLACK, WHITE = 15, 240


def laplacian(data: Column, w: Column, h: Column) -> Column:
    """Four-neighbour Laplacian of a picture given row by row; pixels beyond an edge mirror those inside it."""

    def at(y: Column, x: Column) -> Column:
        mirror = lambda i, n: F.when(n == 1, F.lit(0)).when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)
        return F.get(data, (mirror(y, h) * w + mirror(x, w)).cast("int"))

    def one(v: Column, i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        return (at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * v).cast("double")

    return F.transform(data, one)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def measured(pictures: DataFrame) -> DataFrame:
    """Adds blur_variance (of the Laplacian, over all pixels), mean_brightness and clipped_fraction to pictures (h, w, data).
    A picture is one array, so nothing is shuffled."""
    lap = pictures.withColumn("_l", laplacian(F.col("data"), F.col("w"), F.col("h")))
    centred = lap.withColumn("_m", _mean(F.col("_l")))
    return centred.withColumns({
        "blur_variance": F.aggregate("_l", F.lit(0.0), lambda s, v: s + (v - F.col("_m")) * (v - F.col("_m"))) / F.size("_l"),
        "mean_brightness": _mean(F.transform("data", lambda v: v.cast("double"))),
        "clipped_fraction": F.size(F.filter("data", lambda v: (v <= BLACK) | (v > WHITE))).cast("double") / F.size("data"),
    }).drop("_l", "_m")


def blur_score(variance: Column) -> Column:
    return clamp(variance / 150.0 * 100.0, 0.0, 100.0)


def brightness_score(mean: Column) -> Column:
    return F.when(mean.between(170.0, 245.0), 100.0).when(mean < 170.0, clamp(mean / 170.0 * 100.0, 0.0, 100.0)).otherwise(clamp((255.0 - mean) / 10.0 * 100.0, 0.0, 100.0))


def score(variance: Column, mean: Column, clipped: Column) -> Column:
    return clamp(blur_score(variance) * 0.6 + brightness_score(mean) * 0.4 - clamp(clipped * 200.0, 0.0, 40.0), 0.0, 100.0).cast("int")


# The messages of a score.
EXCELLENT = "Excellent scan — text clarity is high."
BLURRY = "image looks a bit blurry — hold the phone steadier or move closer"
DARK = "lighting is low — try a brighter, more even light source"
BRIGHT = "image looks overexposed/washed out"
BETTER, GOOD = "Could be better: ", "Good scan."


def message(total: Column, variance: Column, mean: Column) -> Column:
    issues = F.array_compact(F.array(F.when(blur_score(variance) < 50, F.lit(BLURRY)), F.when(mean < 130, F.lit(DARK)), F.when(mean > 245, F.lit(BRIGHT))))
    return F.when(total >= 80, F.lit(EXCELLENT)).when(F.size(issues) > 0, F.concat(F.lit(BETTER), F.array_join(issues, "; "))).otherwise(F.lit(GOOD))


def judged(pictures: DataFrame) -> DataFrame:
    rows = measured(pictures)
    rows = rows.withColumn("score", score(F.col("blur_variance"), F.col("mean_brightness"), F.col("clipped_fraction")))
    return rows.withColumn("message", message(F.col("score"), F.col("blur_variance"), F.col("mean_brightness")))
