"""Interval clustering, layout regions, crops and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, layout
from ..schemas import LAYOUT_CLASSES, layout_classes, values_sql
from ..sources import adapters
from .common import widened

CLASSES_SQL = f"classes AS (SELECT * FROM ({values_sql(LAYOUT_CLASSES)}) v(class_id, class_name, role))"


def bands_sql(source: str, keys: str, start: str, end: str, order: str, gap: str, name: str) -> str:
    """CTEs a_<name>, b_<name> and <name>: source with a band number."""
    return f"""a_{name} AS (SELECT *, {gap} AS gap_, max("{end}") OVER (PARTITION BY {keys} ORDER BY "{start}", {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM {source}),
b_{name} AS (SELECT *, CASE WHEN before_ IS NULL OR "{start}" - before_ >= gap_ THEN 1 ELSE 0 END AS new_ FROM a_{name}),
{name} AS (SELECT * EXCLUDE (gap_, before_, new_), (sum(new_) OVER (PARTITION BY {keys} ORDER BY "{start}", {order} ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS {name}_no FROM b_{name})"""


def span_gap(keys: str, start: str, end: str, fraction: float) -> str:
    return f'greatest(1, trunc(greatest(1, max("{end}") OVER (PARTITION BY {keys}) - min("{start}") OVER (PARTITION BY {keys}))::FLOAT * {fraction}::FLOAT))::BIGINT'


def interval_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of table words on the horizontal axis, at both gap fractions."""
    w = adapters.table_words(spark, sf_dir)
    one = intervals.clusters(w, ["table_id"], "left", "right", ["ord"], 0.02, "band_no")
    return widened(intervals.clusters(one, ["table_id"], "left", "right", ["ord"], 0.035, "column_no").select("table_id", "ord", "band_no", "column_no"))


INTERVAL_CLUSTERS = f"""WITH {adapters.TABLE_WORDS_SQL}, {bands_sql("table_words", "table_id", "left", "right", "ord", span_gap("table_id", "left", "right", 0.02), "band")},
{bands_sql("band", "table_id", "left", "right", "ord", span_gap("table_id", "left", "right", 0.035), "col")} SELECT table_id, ord, band_no, col_no AS column_no FROM col"""


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = adapters.table_words(spark, sf_dir)
    rowed = intervals.rows(w, ["table_id"], "top", "bottom", ["ord"])
    return widened(intervals.bands(rowed, ["table_id"], "left", "right", ["ord"], F.col("width")).select("table_id", "ord", "row_no", "col_no"))


WORD_ROWS = f"""WITH {adapters.TABLE_WORDS_SQL}, {bands_sql("table_words", "table_id", "top", "bottom", "ord", "0", "row")}, {bands_sql("row", "table_id", "left", "right", "ord", "greatest(4, trunc(width * 0.02))", "col")}
SELECT table_id, ord, row_no, col_no FROM col"""


def line_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles of runs of bright rows of pictures, and the cells between them."""
    p = adapters.rasters(spark, sf_dir).select("page_id", F.posexplode("data").alias("i", "v"))
    hits = p.groupBy("page_id", F.expr("i div 8").alias("y")).agg(F.count_if(F.col("v") >= 128).alias("lit")).where("lit >= 8 * 0.5")
    edges = intervals.runs(hits, ["page_id"], "y")
    return widened(edges.join(intervals.cells(edges, ["page_id"]).withColumnRenamed("cell_no", "boundary_no"), ["page_id", "boundary_no"], "left"))


LINE_BOUNDARIES = f"""WITH {adapters.RASTERS_SQL}, hits AS (SELECT page_id, y FROM pixels GROUP BY page_id, y HAVING count(*) FILTER (v >= 128) >= 4),
runs AS (SELECT page_id, (min(y) + max(y)) // 2 AS pos FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS run FROM hits) GROUP BY page_id, run)
SELECT page_id, row_number() OVER w - 1 AS boundary_no, pos, CASE WHEN lead(pos) OVER w IS NOT NULL THEN pos END AS low, lead(pos) OVER w AS high FROM runs WINDOW w AS (PARTITION BY page_id ORDER BY pos)"""


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of raw detections with class and role."""
    hard = spark.createDataFrame([(-1, 0, 2, 0.39, 0.0, 0.0, 9.0, 9.0, None), (-1, 1, 23, 0.9, 0.0, 0.0, 9.0, 9.0, None), (-1, 2, 2, 0.4, -3.9, 2.7, 10.9, 8.2, None), (-1, 3, 2, 0.9, 5.2, 5.0, 5.9, 9.0, None)], adapters.detections(spark, sf_dir).schema)
    regions = layout.regions(adapters.detections(spark, sf_dir).unionByName(hard))
    return widened(regions.select("page_id", "det_no", "class_name", "role", "score", "left", "top", "right", "bottom"))


REGIONS_SQL = f"""{CLASSES_SQL}, regions AS (SELECT page_id, det_no, d.class_id, class_name, role, score, greatest(0, trunc(x1)::BIGINT) AS "left", greatest(0, trunc(y1)::BIGINT) AS top, trunc(x2)::BIGINT AS "right", trunc(y2)::BIGINT AS bottom
  FROM all_detections d JOIN classes c ON d.class_id = c.class_id WHERE NOT (score < 0.4) AND (valid_count IS NULL OR det_no < valid_count) AND trunc(x2) > greatest(0, trunc(x1)) AND trunc(y2) > greatest(0, trunc(y1)))"""
LAYOUT_REGIONS = f"""WITH {adapters.DETECTIONS_SQL}, all_detections AS (SELECT * FROM detections UNION ALL VALUES (-1, 0, 2, 0.39, 0.0, 0.0, 9.0, 9.0, NULL), (-1, 1, 23, 0.9, 0.0, 0.0, 9.0, 9.0, NULL), (-1, 2, 2, 0.4, -3.9, 2.7, 10.9, 8.2, NULL), (-1, 3, 2, 0.9, 5.2, 5.0, 5.9, 9.0, NULL)),
{REGIONS_SQL} SELECT page_id, det_no, class_name, role, score, "left", top, "right", bottom FROM regions"""


def region_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded crops of regions on pages of 500 by 480 pixels."""
    regions = layout.regions(adapters.detections(spark, sf_dir)).withColumns({"width": F.lit(500), "height": F.lit(480)})
    return widened(layout.crops(regions).select("page_id", "det_no", "crop_left", "crop_top", "crop_right", "crop_bottom", "coord_scale"))


REGION_CROPS = f"""WITH {adapters.DETECTIONS_SQL}, all_detections AS (SELECT * FROM detections), {REGIONS_SQL},
c AS (SELECT page_id, det_no, greatest(0, least("left" - 6, 499)) AS l, greatest(0, least(top - 6, 479)) AS t, "right", bottom FROM regions WHERE role <> 'SKIP'),
e AS (SELECT page_id, det_no, l, t, least(greatest("right" + 6, l + 1), 500) AS r, least(greatest(bottom + 6, t + 1), 480) AS b FROM c)
SELECT page_id, det_no, l AS crop_left, t AS crop_top, r AS crop_right, b AS crop_bottom, CASE WHEN b - t < 90 THEN 2::BIGINT ELSE 1 END AS coord_scale FROM e WHERE r > l AND b > t"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of pages in reading order."""
    regions = layout.regions(adapters.detections(spark, sf_dir)).select("page_id", "det_no", "left", "top", "right", "bottom")
    return widened(layout.reading_order(regions, ["page_id"], ["det_no"]).select("page_id", "det_no", "reading_no"))


def _reading_sql(levels: int = 8) -> str:
    """The cuts of one level after another; a group that is not cut at a level is never cut again."""
    parts = [f"WITH {adapters.DETECTIONS_SQL}, all_detections AS (SELECT * FROM detections), {REGIONS_SQL}", "l0 AS (SELECT page_id, det_no, \"left\", top, \"right\", bottom, '' AS path, true AS rows_first FROM regions)"]
    keys = "page_id, path"
    for i in range(levels):
        parts += [
            bands_sql(f"l{i}", keys, "top", "bottom", "det_no", span_gap(keys, "top", "bottom", 0.02), f"v{i}"),
            bands_sql(f"v{i}", keys, "left", "right", "det_no", span_gap(keys, "left", "right", 0.02), f"h{i}"),
            f"m{i} AS (SELECT *, max(v{i}_no) OVER (PARTITION BY {keys}) AS nv, max(h{i}_no) OVER (PARTITION BY {keys}) AS nh FROM h{i})",
            f"""l{i + 1} AS (SELECT page_id, det_no, "left", top, "right", bottom, path || CASE WHEN rows_first AND nv > 0 OR NOT rows_first AND nh = 0 AND nv > 0 THEN chr((65 + v{i}_no)::INT) WHEN nh > 0 THEN chr((65 + h{i}_no)::INT) ELSE 'A' END AS path,
  CASE WHEN rows_first AND nv > 0 OR NOT rows_first AND nh > 0 THEN NOT rows_first ELSE rows_first END AS rows_first FROM m{i})""",
        ]
    return ",\n".join(parts) + f'\nSELECT page_id, det_no, row_number() OVER (PARTITION BY page_id ORDER BY path, top, "left", det_no) - 1 AS reading_no FROM l{levels}'


READING_ORDER = _reading_sql()


def class_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many detections of each role there are, by a lookup of classes; unknown classes go."""
    d = adapters.detections(spark, sf_dir)
    return d.join(F.broadcast(layout_classes(spark)), "class_id").groupBy("role").agg(F.count("*").alias("n"))


CLASS_ROLES = f"WITH {adapters.DETECTIONS_SQL}, {CLASSES_SQL} SELECT role, count(*) AS n FROM detections JOIN classes USING (class_id) GROUP BY role"

def analysed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout model's output rows as regions in reading order; the rows come from detections."""
    d = adapters.detections(spark, sf_dir)
    row = F.array(*[F.col(c).cast("double") for c in ("class_id", "score", "x1", "y1", "x2", "y2")])
    pages = d.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_no", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return widened(layout.analysed(pages, ["page_id"], "rows").select("page_id", "det_no", "reading_no"))


def line_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of lines on pages of 300 by 60 pixels."""
    lines = adapters.table_words(spark, sf_dir).withColumns({"width": F.lit(300), "height": F.lit(60), "left": F.col("left") - 5})
    return widened(layout.line_crops(lines).select("table_id", "ord", "crop_left", "crop_top", "crop_right", "crop_bottom"))


LINE_CROPS = f"""WITH {adapters.TABLE_WORDS_SQL}, c AS (SELECT table_id, ord, greatest(0, least("left" - 5, 299)) AS l, greatest(0, least(top, 59)) AS t, "right" AS r, bottom AS b FROM table_words)
SELECT table_id, ord, l AS crop_left, t AS crop_top, least(greatest(r, l + 1), 300)::BIGINT AS crop_right, least(greatest(b, t + 1), 60)::BIGINT AS crop_bottom FROM c"""

QUERIES = {f.__name__: f for f in (analysed_pages, line_crops, interval_clusters, word_rows, line_boundaries, layout_regions, region_crops, reading_order, class_roles)}
# the model's rows are counted from 0 as they are, so all of a page's detections take part
ORACLE_SQL = {
    "analysed_pages": READING_ORDER.replace(" AND (valid_count IS NULL OR det_no < valid_count)", ""), "line_crops": LINE_CROPS, "interval_clusters": INTERVAL_CLUSTERS, "word_rows": WORD_ROWS, "line_boundaries": LINE_BOUNDARIES, "layout_regions": LAYOUT_REGIONS, "region_crops": REGION_CROPS,
    "reading_order": READING_ORDER, "class_roles": CLASS_ROLES,
}
