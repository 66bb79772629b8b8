"""Page sessions as tables (session_id, position, page_id, rotation): every edit gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import turned


def renumbered(pages: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("position", "page_id")
    return pages.withColumn("position", (F.row_number().over(order) - 1).cast("int"))


def appended(pages: DataFrame, new: DataFrame) -> DataFrame:
    """new (session_id, page_id) behind the pages of their sessions, in order of page_id, not rotated."""
    ends = pages.groupBy("session_id").agg((F.max("position") + 1).alias("_end"))
    order = Window.partitionBy("session_id").orderBy("page_id")
    placed = new.join(ends, "session_id", "left").withColumn("position", (F.coalesce("_end", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    return pages.unionByName(placed.select("session_id", "position", "page_id", F.lit(0).alias("rotation")))


def removed(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the pages of gone (session_id, page_id); later ones move up. Unknown pages change nothing."""
    return renumbered(pages.join(gone, ["session_id", "page_id"], "left_anti"))


def rotated(pages: DataFrame, turns: DataFrame) -> DataFrame:
    """Pages of turns (session_id, page_id, degrees) turned, to one of 0, 90, 180, 270."""
    met = pages.join(turns, ["session_id", "page_id"], "left")
    return met.withColumn("rotation", turned(F.col("rotation"), F.coalesce("degrees", F.lit(0)))).drop("degrees")


def moved(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """One page per session moved from a place to another (moves: session_id, from_no, to_no), as if taken out and put in
    again; places out of range or equal change nothing."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    met = pages.withColumn("_n", n).join(moves, "session_id", "left")
    p, a, b = F.col("position"), F.col("from_no"), F.col("to_no")
    valid = a.between(0, F.col("_n") - 1) & b.between(0, F.col("_n") - 1) & (a != b)
    place = F.when(~F.coalesce(valid, F.lit(False)), p).when(p == a, b).when((p > a) & (p <= b), p - 1).when((p < a) & (p >= b), p + 1).otherwise(p)
    return met.withColumn("position", place.cast("int")).drop("_n", "from_no", "to_no")


def labels(pages: DataFrame) -> DataFrame:
    """Adds label: Page 1, Page 2 and so on."""
    return pages.withColumn("label", F.concat(F.lit("Page "), (F.col("position") + 1).cast("string")))


def counted(pages: DataFrame) -> DataFrame:
    return pages.groupBy("session_id").agg(F.count("*").alias("n_pages"))
