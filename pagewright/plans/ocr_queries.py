"""Line-based recognition: flow, words, paragraphs, decoding, boxes and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import ocr
from ..sources import adapters
from .common import widened
from .table_queries import BEST_SQL


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines: lines of documents, three to a row, with uneven heights."""
    docs = adapters.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    left, top = (F.col("n") % 3) * 400, F.expr("n div 3") * 24 + (F.col("n") % 3) * 2 + F.when(F.expr("n div 3") % 4 == 3, 9).otherwise(0)
    return docs.select("doc_id", "n", "text", left.cast("int").alias("left"), top.cast("int").alias("top"), (left + 300 + F.length("text") % 50).cast("int").alias("right"), (top + 15).cast("int").alias("bottom"))


LINES_SQL = """raw_lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
rec AS (SELECT doc_id, n, text, (n % 3) * 400 AS "left", (n // 3) * 24 + (n % 3) * 2 + CASE WHEN (n // 3) % 4 = 3 THEN 9 ELSE 0 END AS top, (n % 3) * 400 + 300 + length(text) % 50 AS "right",
  (n // 3) * 24 + (n % 3) * 2 + CASE WHEN (n // 3) % 4 = 3 THEN 9 ELSE 0 END + 15 AS bottom FROM raw_lines),
flow AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top // 20, "left", n) - 1 AS line_no FROM rec WHERE length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) > 0)"""


def line_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widened(ocr.line_order(_lines(spark, sf_dir), ["doc_id"], ["n"]).select("doc_id", "n", "line_no"))


LINE_FLOW = f"WITH {LINES_SQL} SELECT doc_id, n, line_no FROM flow"


def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = ocr.line_order(_lines(spark, sf_dir), ["doc_id"], ["n"])
    return widened(ocr.paragraphs(flow, ["doc_id"]))


LINE_PARAGRAPHS = f"""WITH {LINES_SQL}, gaps AS (SELECT *, CASE WHEN top - lag(bottom) OVER w > greatest(1, lag(bottom) OVER w - lag(top) OVER w) * 0.6::DOUBLE THEN 1 ELSE 0 END AS new FROM flow WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
pars AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS par_no FROM gaps) SELECT doc_id, par_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM pars GROUP BY doc_id, par_no"""


def line_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = ocr.line_order(_lines(spark, sf_dir), ["doc_id"], ["n"])
    return widened(ocr.word_boxes(flow, ["doc_id"]))


# the running edge is a 32-bit float that is rounded at every word: a fold, as a running sum would be of doubles
LINE_WORD_BOXES = f"""WITH {LINES_SQL}, ws AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM flow),
shares AS (SELECT *, list_transform(w, lambda x: ((("right" - "left")::FLOAT) * (length(x)::FLOAT / greatest(1, list_sum(list_transform(w, lambda y: length(y))))::FLOAT)::FLOAT)::FLOAT) AS s FROM ws),
edges AS (SELECT *, list_transform(generate_series(0, len(w)), lambda k: CASE WHEN k = 0 THEN "left"::FLOAT ELSE list_reduce(list_prepend("left"::FLOAT, s[1:k]), lambda a, b: (a + b)::FLOAT) END) AS e FROM shares)
SELECT doc_id, line_no, k - 1 AS word_no, w[k] AS text, trunc(e[k])::BIGINT AS "left", top, trunc(e[k + 1])::BIGINT AS "right", bottom, 0.0::DOUBLE AS confidence FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM edges)"""

VOCABULARY = ["", *[chr(97 + i % 26) for i in range(55)]]


def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of logits; every other step is said twice."""
    steps = adapters.logits(spark, sf_dir)
    doubled = steps.select("seq_id", F.explode(F.array(F.col("step") * 2, F.when(F.col("step") % 2 == 0, F.col("step") * 2 + 1))).alias("step"), "logits").where("step is not null")
    return widened(ocr.greedy_text(doubled, ["seq_id"], VOCABULARY))


GREEDY_DECODE = f"""WITH {adapters.LOGITS_SQL}, {BEST_SQL}, twice AS (SELECT seq_id, step * 2 AS step, idx FROM best UNION ALL SELECT seq_id, step * 2 + 1, idx FROM best WHERE step % 2 = 0),
prev AS (SELECT *, lag(idx, 1, -1) OVER (PARTITION BY seq_id ORDER BY step) AS last FROM twice)
SELECT seq_id, coalesce(string_agg(chr((97 + (idx - 1) % 26)::INT), '' ORDER BY step) FILTER (idx <> 0 AND idx <> last AND idx < {len(VOCABULARY)}), '') AS text FROM prev GROUP BY seq_id"""


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ocr.line_page(_lines(spark, sf_dir), ["doc_id"], ["n"])
    return widened(r.select("doc_id", F.md5("full_text").alias("digest"), "n_words", F.size("paragraphs").alias("n_paragraphs")))


LINE_PAGES = f"""WITH {LINES_SQL}, gaps AS (SELECT *, CASE WHEN top - lag(bottom) OVER w > greatest(1, lag(bottom) OVER w - lag(top) OVER w) * 0.6::DOUBLE THEN 1 ELSE 0 END AS new FROM flow WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY line_no)) AS digest, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words, 1 + sum(new)::BIGINT AS n_paragraphs FROM gaps GROUP BY doc_id"""


def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final boxes of raw detections."""
    raw = adapters.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 300).cast("int").alias("x"), (F.col("l_partkey") % 300).cast("int").alias("y"), (F.col("l_quantity") * 2).cast("int").alias("w"), (F.col("l_linenumber") * 3).cast("int").alias("h"),
        (F.col("l_discount") * 10).alias("score"), F.lit(320).alias("resized_w"), F.lit(320).alias("resized_h"), F.lit(640).alias("orig_w"), F.lit(700).alias("orig_h"),
    )
    return widened(ocr.text_boxes(raw).select("l_orderkey", "l_linenumber", "left", "top", "right", "bottom"))


TEXT_BOXES = """WITH raw AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey % 300 AS x, l_partkey % 300 AS y, trunc(l_quantity * 2)::BIGINT AS w, l_linenumber * 3 AS h, l_discount * 10 AS score FROM lineitem),
o AS (SELECT *, (w * h)::DOUBLE * 1.5 / (2.0 * (w + h))::DOUBLE AS d FROM raw WHERE w >= 4 AND h >= 4 AND score >= 0.6),
b AS (SELECT l_orderkey, l_linenumber, floor(greatest(x - d, 0.0) / (320.0::DOUBLE / 640) + 0.5)::BIGINT AS "left", floor(greatest(y - d, 0.0) / (320.0::DOUBLE / 700) + 0.5)::BIGINT AS top,
  least(floor(least(x + w + d, 320.0) / (320.0::DOUBLE / 640) + 0.5), 640)::BIGINT AS "right", least(floor(least(y + h + d, 320.0) / (320.0::DOUBLE / 700) + 0.5), 700)::BIGINT AS bottom FROM o)
SELECT * FROM b WHERE "right" > "left" AND bottom > top"""


def input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of model inputs and kernels for pictures of many sizes."""
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4000 + 1).cast("int").alias("w"), (F.col("p_partkey") * 91 % 3000 + 1).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    longer = F.greatest(w, h)
    return widened(rows.select(
        "p_partkey", geo.detector_side(w, longer).alias("det_w"), geo.detector_side(h, longer).alias("det_h"), geo.recogniser_width(w, h).alias("rec_w"), geo.table_side(w, longer).alias("table_w"),
        geo.table_side(h, longer).alias("table_h"), F.round(480.0 / h, 9).alias("scale_h"), F.round(480.0 / w, 9).alias("scale_w"), geo.illumination_kernel(w, h).alias("light"), geo.ruling_kernel(w).alias("ruling"),
        F.round(geo.normalised(w % 256, geo.MEAN[0], geo.DEVIATION[0]), 9).alias("norm"), F.round(F.col("p_partkey") % 101 / 50.0, 9).alias("intensity"), geo.turned((w % 4) * 90, -(h % 9) * 90).alias("turn"),
    ))


INPUT_SIZES = """WITH s AS (SELECT p_partkey, p_partkey * 37 % 4000 + 1 AS w, p_partkey * 91 % 3000 + 1 AS h FROM part), l AS (SELECT *, greatest(w, h) AS m, greatest(31, least(w, h) // 8) AS k FROM s)
SELECT p_partkey, greatest(32, floor(w * least(1.0, 960.0::DOUBLE / m) / 32 + 0.5) * 32)::BIGINT AS det_w, greatest(32, floor(h * least(1.0, 960.0::DOUBLE / m) / 32 + 0.5) * 32)::BIGINT AS det_h,
  greatest(1, least(320, floor(48 * w::DOUBLE / h + 0.5)))::BIGINT AS rec_w, greatest(1, least(488, trunc(w * (488.0::DOUBLE / m))))::BIGINT AS table_w, greatest(1, least(488, trunc(h * (488.0::DOUBLE / m))))::BIGINT AS table_h,
  round(480.0::DOUBLE / h, 9) AS scale_h, round(480.0::DOUBLE / w, 9) AS scale_w, k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS light, greatest(15, w // 20) AS ruling,
  round(((w % 256) / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 9) AS norm, round(p_partkey % 101 / 50.0::DOUBLE, 9) AS intensity, ((((w % 4) * 90 - (h % 9) * 90) % 360) + 360) % 360 AS turn FROM l"""


def quad_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted quads in image pixels: some as fractions, some in input pixels."""
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("p_partkey") * (i + 3)) % 100).cast("double"))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.transform(v, lambda x: x / 100.0)).otherwise(F.transform(v, lambda x: x * 5.0)).alias("box"))
    out = rows.select("p_partkey", geo.denormalised(F.col("box"), F.lit(0.75), F.lit(600), F.lit(420)).alias("b"))
    return widened(out.select("p_partkey", *[F.round(F.get("b", F.lit(i)), 6).alias(f"v{i}") for i in range(8)]))


QUAD_BOXES = """WITH r AS (SELECT p_partkey, list_transform(range(8), lambda i: ((p_partkey * (i + 3)) % 100)::DOUBLE * CASE WHEN p_partkey % 2 = 0 THEN 0.01 ELSE 5.0 END) AS b FROM part),
s AS (SELECT p_partkey, CASE WHEN list_max(b) <= 2.0 AND list_min(b) >= -0.05 THEN list_transform(b, lambda v: v * 488.0) ELSE b END AS b FROM r)
SELECT p_partkey, """ + ", ".join(f"round(greatest(0.0, least(b[{i + 1}] / 0.75::DOUBLE, {600 if i % 2 == 0 else 420}.0)), 6)::DOUBLE AS v{i}" for i in range(8)) + " FROM s"

QUERIES = {f.__name__: f for f in (line_flow, line_paragraphs, line_word_boxes, greedy_decode, line_pages, text_boxes, input_sizes, quad_boxes)}
ORACLE_SQL = {
    "line_flow": LINE_FLOW, "line_paragraphs": LINE_PARAGRAPHS, "line_word_boxes": LINE_WORD_BOXES, "greedy_decode": GREEDY_DECODE, "line_pages": LINE_PAGES, "text_boxes": TEXT_BOXES,
    "input_sizes": INPUT_SIZES, "quad_boxes": QUAD_BOXES,
}
