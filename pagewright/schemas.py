"""Fixed dimensions of the data model: layout classes with their roles, and page styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The ids and names of the layout classes, and the role that each one has in a document.
LAYOUT_CLASSES = [
    (0, "PARAGRAPH_TITLE", "TITLE"),
    (1, "IMAGE", "IMAGE"),
    (2, "TEXT", "PARAGRAPH"),
    (3, "NUMBER", "SKIP"),
    (4, "ABSTRACT", "PARAGRAPH"),
    (5, "CONTENT", "PARAGRAPH"),
    (6, "FIGURE_TITLE", "TITLE"),
    (7, "FORMULA", "PARAGRAPH"),
    (8, "TABLE", "TABLE"),
    (9, "TABLE_TITLE", "TITLE"),
    (10, "REFERENCE", "PARAGRAPH"),
    (11, "DOC_TITLE", "MAIN_TITLE"),
    (12, "FOOTNOTE", "PARAGRAPH"),
    (13, "HEADER", "SKIP"),
    (14, "ALGORITHM", "PARAGRAPH"),
    (15, "FOOTER", "SKIP"),
    (16, "SEAL", "IMAGE"),
    (17, "CHART_TITLE", "TITLE"),
    (18, "CHART", "IMAGE"),
    (19, "FORMULA_NUMBER", "SKIP"),
    (20, "HEADER_IMAGE", "SKIP"),
    (21, "FOOTER_IMAGE", "SKIP"),
    (22, "ASIDE_TEXT", "PARAGRAPH"),
]
HEADER, FOOTER = 13, 15

# Name, font size, line multiplier, paragraph spacing and margin (density-independent), background, ink.
STYLES = [
    ("Plain", 16.0, 1.15, 12.0, 24.0, "#FFFFFF", "#000000"),
    ("Book", 15.0, 1.4, 20.0, 40.0, "#FBF8F2", "#1A1A1A"),
    ("Notes", 19.0, 1.6, 24.0, 28.0, "#FFFFFF", "#0D2B4E"),
]

WORD = "struct<text:string,left:int,top:int,right:int,bottom:int,confidence:float>"
BLOCK = "kind string, text string, rows array<array<string>>, image_ref string"


def layout_classes(spark: SparkSession) -> DataFrame:
    """The 23 classes; small enough to broadcast anywhere."""
    return spark.createDataFrame(LAYOUT_CLASSES, "class_id int, class_name string, role string")


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, "style string, font double, line_mult double, para double, margin double, background string, ink string")


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
