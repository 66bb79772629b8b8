"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as 64-bit ones and floats as doubles, so that results have the types of their SQL."""
    wide = {"tinyint": "long", "smallint": "long", "int": "long", "float": "double"}
    return df.select(*[F.col(c).cast(wide[t]).alias(c) if t in wide else F.col(c) for c, t in df.dtypes])
