"""Pagination: blocks flow onto pages of a style. Text measurement is a parameter: characters of even width by default."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_W, PAGE_H, DENSITY = 1240, 1754, 2.0
# Font scale and line multiplier of titles and cells, spacing, paddings and least width of table columns.
TITLE, MAIN_TITLE, CELL = 1.3, 1.65, 0.85
TITLE_LINES, CELL_LINES, MAIN_SPACING = 1.2, 1.1, 1.3
CELL_H, CELL_V, LEAST_COLUMN = 6.0, 4.0, 40.0
BAND_FONT, LABEL_GAP = 10.0, 12.0
PLACED = "array<struct<item_no:int,page_no:int,y:double>>"
PLACED_TYPE = pa.list_(pa.struct([("item_no", pa.int32()), ("page_no", pa.int32()), ("y", pa.float64())]))


def geometry(style: DataFrame) -> DataFrame:
    """Adds margin_px, content_w, content_h, bottom_y, spacing_px to a style."""
    margin = F.col("margin") * DENSITY
    return style.withColumns({
        "margin_px": margin, "content_w": F.greatest(F.lit(1), (PAGE_W - 2 * margin).cast("int")), "content_h": PAGE_H - 2 * margin, "bottom_y": PAGE_H - margin, "spacing_px": F.col("para") * DENSITY,
    })


@dataclass(frozen=True)
class Metric:
    """A font's measures as column functions of text and size: half of the size for each character, rounded-up lines."""

    char_share: float = 0.5

    def width(self, text: Column, size: Column) -> Column:
        return F.length(text) * size * self.char_share

    def lines(self, text: Column, size: Column, width: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(self.width(text, size) / width)).cast("int")

    def line_height(self, size: Column, multiplier: Column | float) -> Column:
        return F.ceil(size * multiplier).cast("int")


def text_items(blocks: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """Adds font, n_lines, line_h and after (space behind) to text blocks joined with a style's geometry."""
    kind = F.col("kind")
    size = F.col("font") * DENSITY * F.when(kind == "MAIN_TITLE", MAIN_TITLE).when(kind == "TITLE", TITLE).otherwise(1.0)
    sized = blocks.withColumn("font_px", size)
    multiplier = F.when(kind.isin("TITLE", "MAIN_TITLE"), TITLE_LINES).otherwise(F.col("line_mult"))
    return sized.withColumns({
        "n_lines": F.when(F.length(F.trim("text")) == 0, 0).otherwise(metric.lines(F.col("text"), F.col("font_px"), F.col("content_w"))),
        "line_h": metric.line_height(F.col("font_px"), multiplier),
        "after": F.col("spacing_px") * F.when(kind == "MAIN_TITLE", MAIN_SPACING).otherwise(1.0),
    })


def column_widths(cells: DataFrame, keys: Sequence[str], metric: Metric = Metric()) -> DataFrame:
    """keys, col_no, width for cells (keys, row_no, col_no, text, font, content_w): the widest cell with its paddings, at
    least 80 pixels, all scaled to fill the content's width."""
    size = F.col("font") * DENSITY * CELL
    ideal = cells.groupBy(*keys, "col_no").agg(F.greatest(F.lit(LEAST_COLUMN * DENSITY), F.max(metric.width(F.col("text"), size) + 2 * CELL_H * DENSITY)).alias("ideal"), F.first("content_w").alias("content_w"))
    return ideal.withColumn("width", F.col("ideal") * F.col("content_w") / F.sum("ideal").over(Window.partitionBy(*keys))).drop("ideal", "content_w")


def row_heights(cells: DataFrame, widths: DataFrame, keys: Sequence[str], metric: Metric = Metric()) -> DataFrame:
    """keys, row_no, height: the tallest cell and its paddings."""
    size = F.col("font") * DENSITY * CELL
    inner = F.greatest(F.lit(1), (F.col("width") - 2 * CELL_H * DENSITY).cast("int"))
    tall = metric.lines(F.col("text"), size, inner) * metric.line_height(size, CELL_LINES)
    return cells.join(widths, [*keys, "col_no"]).groupBy(*keys, "row_no").agg((F.max(tall) + 2 * CELL_V * DENSITY).alias("height"))


def image_size(w: Column, h: Column, content_w: Column, content_h: Column) -> dict[str, Column]:
    """Size of an image that fills the content's width, or its height if it would be taller."""
    tall = content_w * (h.cast("double") / w)
    return {"draw_w": F.when(tall > content_h, content_h / (h.cast("double") / w)).otherwise(content_w.cast("double")), "draw_h": F.least(tall, content_h)}


def placed(items: list[dict], top: float, bottom: float) -> list[dict]:
    """Page and y of items (height, after) that are never split. What doesn't fit goes to a new page; what is taller than
    a page begins on a new page and overflows there. What has no height stays where it is."""
    page, y, out = 0, top, []
    for i, item in enumerate(items):
        if 0 < item["height"] and bottom - y < item["height"]:
            page, y = page + 1, top
        out.append({"item_no": i, "page_no": page, "y": y})
        y += item["height"] + item["after"]
    return out


def _placed(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for items, tops, bottoms in columns:
        yield pa.array([placed(i, t, b) for i, t, b in zip(items.to_pylist(), tops.to_pylist(), bottoms.to_pylist())], PLACED_TYPE)


def table_heights(rows: Column, font: Column, content_w: Column, metric: Metric = Metric()) -> Column:
    """Heights of a table's rows, an array: as column_widths() and row_heights() have them, for a table that is one value.
    Rows may differ in length; places without a cell are empty ones of one line."""
    size = font * DENSITY * CELL
    n_cols = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    text = lambda r, c: F.coalesce(F.get(r, c), F.lit(""))
    columns = F.when(n_cols > 0, F.sequence(F.lit(0), n_cols - 1)).otherwise(F.array().cast("array<int>"))
    ideal = F.transform(columns, lambda c: F.greatest(F.lit(LEAST_COLUMN * DENSITY), F.array_max(F.transform(rows, lambda r: metric.width(text(r, c), size))) + 2 * CELL_H * DENSITY))
    total = F.aggregate(ideal, F.lit(0.0), lambda t, w: t + w)
    inner = F.transform(ideal, lambda w: F.greatest(F.lit(1), (w * content_w / total - 2 * CELL_H * DENSITY).cast("int")))
    tall = lambda r: F.array_max(F.transform(inner, lambda w, c: metric.lines(text(r, c), size, w)))
    heights = F.transform(rows, lambda r: tall(r) * metric.line_height(size, CELL_LINES) + F.lit(2 * CELL_V * DENSITY))
    return F.when(n_cols > 0, heights).otherwise(F.array().cast("array<double>"))


def flow_items(items: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """One row per unbreakable item, with line_no, height and space: each line of a text, each row of a table, each image; the
    last of a block has the space behind. Blocks without any (blank texts, tables without cells, images without a side)
    still move on by their space. Needs block_no, kind, n_lines, line_h, after, and for tables and images font, content_w,
    content_h, rows, image_w, image_h (null elsewhere)."""
    image = F.when((F.col("image_w") > 0) & (F.col("image_h") > 0), F.array(image_size(F.col("image_w"), F.col("image_h"), F.col("content_w"), F.col("content_h"))["draw_h"]))
    own = F.when(F.col("kind") == "TABLE", table_heights(F.col("rows"), F.col("font"), F.col("content_w"), metric)).when(F.col("kind") == "IMAGE", image)
    heights = own.otherwise(F.array_repeat(F.col("line_h").cast("double"), F.coalesce("n_lines", F.lit(0))))
    each = items.withColumn("_h", F.when(F.size(heights) > 0, heights).otherwise(F.array(F.lit(0.0)))).select(*items.columns, F.posexplode("_h").alias("line_no", "height"), F.size("_h").alias("_n"))
    return each.withColumn("space", F.when(F.col("line_no") == F.col("_n") - 1, F.col("after")).otherwise(0.0)).drop("_n")


def paginated(items: DataFrame, keys: Sequence[str], order: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """keys, order, page_no, y and the carried columns (one value a document) of items (keys, order, height, space, margin_px,
    bottom_y). The fold over a document carries y, so it is no window; a document's items are one list in one Arrow batch row."""
    first = [F.first(c).alias(c) for c in carried]
    listed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "height", F.col("space").alias("after")))).alias("i"), F.first("margin_px").alias("t"), F.first("bottom_y").alias("b"), *first)
    done = listed.select(*keys, *carried, "i", F.arrow_udf(_placed, PLACED)(F.transform("i", lambda x: F.struct(x["height"].alias("height"), x["after"].alias("after"))), F.col("t"), F.col("b")).alias("p"))
    return done.select(*keys, *carried, F.explode(F.arrays_zip("i", "p")).alias("x")).select(*keys, *[F.col(f"x.i.{o}").alias(o) for o in order], "x.p.page_no", "x.p.y", *carried)


def fitted(text: Column, width: Column, size: float, metric: Metric = Metric()) -> Column:
    """A text cut to a width, with an ellipsis where something is cut."""
    most = F.floor(width / (size * metric.char_share)).cast("int")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), F.greatest(most - 1, F.lit(0))), F.lit("…")))


def stamped(pages: DataFrame, keys: Sequence[str], metric: Metric = Metric()) -> DataFrame:
    """Adds label, header and footer to pages (keys, page_no, content_w, header_text, footer_text): the footer leaves room
    for the widest label."""
    total = F.count("*").over(Window.partitionBy(*keys))
    size = BAND_FONT * DENSITY
    labelled = pages.withColumn("label", F.concat_ws(" / ", (F.col("page_no") + 1).cast("string"), total.cast("string"))).withColumn("_n", F.length(total.cast("string")) * 2 + 3)
    room = F.greatest(F.col("content_w") - F.col("_n") * size * metric.char_share - LABEL_GAP * DENSITY, F.lit(0.0))
    return labelled.withColumns({"header": fitted(F.col("header_text"), F.col("content_w"), size, metric), "footer": fitted(F.col("footer_text"), room, size, metric)}).drop("_n")
