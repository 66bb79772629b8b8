"""One-dimensional clustering of intervals, rows and runs: window functions over one shuffle by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], breaks, name: str) -> DataFrame:
    """Numbers groups of rows in order of start; breaks(start, largest end before) begins a new one. The largest end so
    far counts, not the last row's, as an interval may hold the next ones."""
    rows = Window.partitionBy(*keys).orderBy(start, *order)
    before = F.max(end).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | breaks(F.col(start), before), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, (F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def clusters(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], fraction: float, name: str = "cluster_no") -> DataFrame:
    """Bands of intervals: a gap of at least max(1, trunc(span * fraction)) begins a new one. The product is of 32-bit floats."""
    whole = Window.partitionBy(*keys)
    span = F.greatest(F.lit(1), F.max(end).over(whole) - F.min(start).over(whole))
    gap = F.greatest(F.lit(1), (span.cast("float") * F.lit(fraction).cast("float")).cast("int"))
    return _numbered(df.withColumn("_gap", gap), keys, start, end, order, lambda s, e: s - e >= F.col("_gap"), name).drop("_gap")


def rows(df: DataFrame, keys: Sequence[str], top: str, bottom: str, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Rows of boxes that overlap vertically; boxes that only touch are in different rows."""
    return _numbered(df, keys, top, bottom, order, lambda s, e: s >= e, name)


def bands(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], width: Column, name: str = "col_no") -> DataFrame:
    """Column bands: a gap of at least max(4, trunc(2% of the crop's width)) begins a new one."""
    return _numbered(df, keys, start, end, order, lambda s, e: s - e >= F.greatest(F.lit(4), (width * 0.02).cast("int")), name)


def runs(hits: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """keys, boundary_no, pos: the middle of each run of successive positions."""
    order = Window.partitionBy(*keys).orderBy(pos)
    islands = hits.select(*keys, pos, (F.col(pos) - F.row_number().over(order)).alias("_run"))
    middle = islands.groupBy(*keys, "_run").agg(F.expr(f"(min({pos}) + max({pos})) div 2").cast("int").alias("pos"))
    return middle.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).alias("boundary_no"), "pos")


def cells(boundaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cell_no, low, high: the intervals between successive boundaries."""
    order = Window.partitionBy(*keys).orderBy("boundary_no")
    return boundaries.select(*keys, F.col("boundary_no").alias("cell_no"), F.col("pos").alias("low"), F.lead("pos").over(order).alias("high")).where("high is not null")
