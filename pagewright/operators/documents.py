"""Documents of recognised regions: typed blocks in reading order, running headers and footers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, collapse
from ..schemas import FOOTER, HEADER, layout_classes

NO_ROWS = "array<array<string>>"


def structured_blocks(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of regions (keys, region_no, class_id, full_text, paragraphs, table_rows, image_ref): keys, region_no, part_no,
    kind, text, rows, image_ref.

    Titles are collapsed and dropped if empty; a paragraph region gives its paragraphs that aren't blank, else its
    collapsed text; tables without rows go; images stay. Skipped roles give no block.
    """
    dim = F.broadcast(layout_classes(regions.sparkSession).select("class_id", "role"))
    known = regions.join(dim, "class_id").where("role <> 'SKIP'")
    whole = collapse(F.coalesce(F.col("full_text"), F.lit("")))
    full = F.filter(F.array(whole), lambda t: F.length(t) > 0)
    pars = F.filter(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda t: ~blank(t))
    texts = F.when(F.col("role") == "PARAGRAPH", F.when(F.size(pars) > 0, pars).otherwise(full)).when(F.col("role").isin("TITLE", "MAIN_TITLE"), full)
    block = lambda text, rows, image: F.struct(text.cast("string").alias("text"), rows.cast(NO_ROWS).alias("rows"), image.cast("string").alias("image_ref"))
    none = F.lit(None)
    made = (
        F.when(F.col("role") == "TABLE", F.filter(F.array(block(none, F.col("table_rows"), none)), lambda b: F.size(F.coalesce(b["rows"], F.array().cast(NO_ROWS))) > 0))
        .when(F.col("role") == "IMAGE", F.array(block(none, none, F.col("image_ref"))))
        .otherwise(F.transform(texts, lambda t: block(t, none, none)))
    )
    return known.select(*keys, "region_no", F.col("role").alias("kind"), F.posexplode(made).alias("part_no", "b")).select(*keys, "region_no", "part_no", "kind", "b.*")


def flat_blocks(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of pages without regions: their paragraphs that aren't blank."""
    pars = F.filter("paragraphs", lambda t: ~blank(t))
    each = pages.select(*keys, F.posexplode(pars).alias("part_no", "text"))
    return each.select(*keys, F.lit(0).alias("region_no"), "part_no", F.lit("PARAGRAPH").alias("kind"), "text", F.lit(None).cast(NO_ROWS).alias("rows"), F.lit(None).cast("string").alias("image_ref"))


def by_layout(pages: DataFrame, regions: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Regions of the pages (keys, failed if any) whose layout counts, and the pages that have none or whose layout failed.
    A page meets its regions as one list, so both results and all that follows from them read the same two shuffles."""
    own = [c for c in regions.columns if c not in keys]
    whole = pages.join(regions.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_r")), [*keys], "left")
    if "failed" in pages.columns:
        whole = whole.withColumn("_r", F.when(~F.coalesce("failed", F.lit(False)), F.col("_r")))
    return whole.where("_r is not null").select(*keys, F.inline("_r")), whole.where("_r is null").drop("_r")


def assembled(pages: DataFrame, regions: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of pages (keys, paragraphs, failed if any), structured where a page has regions and flat elsewhere; and the
    regions that counted, for running_texts()."""
    good, bare = by_layout(pages, regions, keys)
    return structured_blocks(good, keys).unionByName(flat_blocks(bare, keys)), good


def numbered(blocks: DataFrame, doc: Sequence[str], page: str) -> DataFrame:
    """Adds block_no within a document by page, region and part."""
    order = Window.partitionBy(*doc).orderBy(page, "region_no", "part_no")
    return blocks.withColumn("block_no", (F.row_number().over(order) - 1).cast("int"))


def running_texts(regions: DataFrame, doc: Sequence[str], page: str) -> DataFrame:
    """doc, header_text, footer_text: within a page the last header that isn't empty counts, in a document the first page
    that has one; the same for footers. Documents with neither have no row."""
    text = collapse(F.coalesce(F.col("full_text"), F.lit("")))
    found = regions.where(F.col("class_id").isin(HEADER, FOOTER)).withColumn("_t", text).where("_t <> ''")
    last = found.groupBy(*doc, page, "class_id").agg(F.max_by("_t", "region_no").alias("_t"))
    pick = lambda c: F.min_by(F.when(F.col("class_id") == c, F.col("_t")), F.when(F.col("class_id") == c, F.col(page)))
    return last.groupBy(*doc).agg(pick(HEADER).alias("header_text"), pick(FOOTER).alias("footer_text"))
