"""Adapters: deterministic inputs of the operators, made from plain tables. Each has its SQL beside it.

There are no page images or recognition results among the tables, so words get boxes from their place in the text,
regions and table words from order lines, frames from events, pixels and logits from embeddings, blocks from HTML.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import clamp

CHAR_WIDTH, LINE_HEIGHT, WORD_HEIGHT = 8, 20, 16


def _starts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = [[np.concatenate([[0], np.cumsum(np.array(line[:-1], np.int64) + 1)]) if line else [] for line in lines] for lines in batch.to_pylist()]
        yield pa.array(out, pa.list_(pa.list_(pa.int64())))


def word_starts(lengths: Column) -> Column:
    """Where each word of each line begins if one blank stands between words."""
    return F.arrow_udf(_starts, "array<array<long>>")(lengths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts dealt out by document. What follows explodes them into words and works document by document, so one shuffle of
    the compact texts stands for later ones of the words, and few large row groups still keep all cores busy."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, word_no, text, left, top, right, bottom: words of documents on a grid of characters."""
    docs = documents(spark, sf_dir).select("doc_id", F.transform(F.split("text", "\n"), lambda x: tx.words(x)).alias("ws"))
    placed = docs.select("doc_id", "ws", word_starts(F.transform("ws", lambda ws: F.transform(ws, lambda w: F.length(w)))).alias("at"))
    lines = placed.select("doc_id", F.posexplode(F.arrays_zip("ws", "at")).alias("line_no", "x"))
    each = lines.select("doc_id", "line_no", F.posexplode(F.arrays_zip(F.col("x.ws").alias("w"), F.col("x.at").alias("at"))).alias("word_no", "y")).select("doc_id", "line_no", "word_no", F.col("y.w").alias("text"), "y.at")
    left = (F.col("at") * CHAR_WIDTH).cast("int")
    return each.select(
        "doc_id", "line_no", "word_no", "text", left.alias("left"), (F.col("line_no") * LINE_HEIGHT).alias("top"),
        (left + F.length("text") * CHAR_WIDTH).cast("int").alias("right"), (F.col("line_no") * LINE_HEIGHT + WORD_HEIGHT).alias("bottom"),
    )


WORDS_SQL = """
lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
line_words AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS ws FROM lines),
words AS (SELECT doc_id, line_no, word_no, text, "left", line_no * 20 AS top, "left" + length(text) * 8 AS "right", line_no * 20 + 16 AS bottom FROM (
  SELECT doc_id, line_no, i - 1 AS word_no, ws[i] AS text, 8 * (length(coalesce(array_to_string(ws[1:i - 1], ' '), '')) + CASE WHEN i > 1 THEN 1 ELSE 0 END) AS "left"
  FROM (SELECT doc_id, line_no, ws, unnest(generate_series(1, len(ws))) AS i FROM line_words WHERE len(ws) > 0)))"""


def hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, hocr: the documents as hOCR pages, one paragraph each, lines and words with boxes; every seventh word
    has no confidence. Built on the split text, without a shuffle."""
    docs = documents(spark, sf_dir).select("doc_id", F.transform(F.split("text", "\n"), lambda x: tx.words(x)).alias("lines"))
    split = docs.select("doc_id", "lines", word_starts(F.transform("lines", lambda ws: F.transform(ws, lambda w: F.length(w)))).alias("at"))

    def escaped(w):
        for entity, char in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
            w = F.replace(w, F.lit(char), F.lit(entity))
        return w

    def word(y):
        def one(w, i):
            left = F.get(F.get("at", y), i) * CHAR_WIDTH
            box = F.concat_ws(" ", left, y * LINE_HEIGHT, left + F.length(w) * CHAR_WIDTH, y * LINE_HEIGHT + WORD_HEIGHT)
            conf = F.when(i % 7 == 6, F.lit("")).otherwise(F.concat(F.lit("; x_wconf "), (90 + i % 10).cast("string")))
            return F.concat(F.lit("<span class='ocrx_word' id='w' title='bbox "), box, conf, F.lit("'>"), escaped(w), F.lit("</span>"))

        return one

    line = lambda ws, y: F.concat(F.lit("<span class='ocr_line' title='x'>"), F.array_join(F.transform(ws, word(y)), " "), F.lit("</span>"))
    page = F.concat(F.lit("<p class='ocr_par' lang='x'>"), F.array_join(F.transform("lines", line), "\n"), F.lit("</p>"))
    return split.select("doc_id", page.alias("hocr"))


HOCR_SQL = """
page_lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS y, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
page_words AS (SELECT doc_id, y, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS ws FROM page_lines),
hocr_lines AS (SELECT doc_id, y, '<span class=''ocr_line'' title=''x''>' || coalesce(array_to_string(list_transform(generate_series(1, len(ws)), lambda i:
  '<span class=''ocrx_word'' id=''w'' title=''bbox ' || (8 * (length(coalesce(array_to_string(ws[1:i - 1], ' '), '')) + CASE WHEN i > 1 THEN 1 ELSE 0 END))::VARCHAR || ' ' || (y * 20)::VARCHAR || ' ' ||
  (8 * (length(coalesce(array_to_string(ws[1:i - 1], ' '), '')) + CASE WHEN i > 1 THEN 1 ELSE 0 END + length(ws[i])))::VARCHAR || ' ' || (y * 20 + 16)::VARCHAR ||
  CASE WHEN (i - 1) % 7 = 6 THEN '' ELSE '; x_wconf ' || (90 + (i - 1) % 10)::VARCHAR END || '''>' ||
  replace(replace(replace(replace(replace(ws[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</span>'), ' '), '') || '</span>' AS h FROM page_words),
hocr AS (SELECT doc_id, '<p class=''ocr_par'' lang=''x''>' || string_agg(h, chr(10) ORDER BY y) || '</p>' AS hocr FROM hocr_lines GROUP BY doc_id)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, det_no, class_id, score, x1, y1, x2, y2 (float), valid_count: order lines as raw detections of a page."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.row_number().over(order) - 1).alias("det_no"), "l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_linenumber"
    )
    x, y = (F.col("l_suppkey") % 4) * 150 - 3.5, (F.col("l_partkey") % 10) * 60 - 2.5
    return rows.select(
        "page_id", "det_no", (F.col("l_partkey") % 25).cast("int").alias("class_id"), F.round(F.col("l_discount") * 10, 1).alias("score"), x.alias("x1"), y.alias("y1"),
        (x + 40 + F.col("l_quantity") * 3).alias("x2"), (y + 20 + F.col("l_linenumber") * 7).alias("y2"), (6 + F.col("page_id") % 3).cast("int").alias("valid_count"),
    )


DETECTIONS_SQL = """
detections AS (SELECT page_id, det_no, class_id, score, x AS x1, y AS y1, x + 40 + l_quantity * 3 AS x2, y + 20 + l_linenumber * 7 AS y2, 6 + page_id % 3 AS valid_count FROM (
  SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS det_no, l_partkey % 25 AS class_id,
    round(l_discount * 10, 1) AS score, (l_suppkey % 4) * 150 - 3.5::DOUBLE AS x, (l_partkey % 10) * 60 - 2.5::DOUBLE AS y, l_quantity, l_linenumber FROM lineitem))"""


def table_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, ord, text, left, top, right, bottom, width: order lines as the words of a table crop 400 pixels wide."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    left, top = ((F.col("l_suppkey") % 5) * 70 + F.col("l_partkey") % 7).cast("int"), ((F.col("l_linenumber") % 4) * 25 + F.col("l_partkey") % 3).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), (F.row_number().over(order) - 1).alias("ord"), F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("text"),
        left.alias("left"), top.alias("top"), (left + 20 + F.col("l_quantity").cast("int")).alias("right"), (top + 18).alias("bottom"), F.lit(400).alias("width"),
    )


TABLE_WORDS_SQL = """
table_words AS (SELECT table_id, ord, text, "left", top, "left" + 20 + q AS "right", top + 18 AS bottom, 400 AS width FROM (
  SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord,
    l_returnflag || l_linestatus || trunc(l_quantity)::INT::VARCHAR AS text, (l_suppkey % 5) * 70 + l_partkey % 7 AS "left", (l_linenumber % 4) * 25 + l_partkey % 3 AS top, trunc(l_quantity)::INT AS q FROM lineitem))"""


def table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, tokens, boxes: order lines as the token stream of a table, a new row at every third cell. Spans come from
    the line number; boxes (8 numbers) belong to cell openings."""
    w = table_words(spark, sf_dir)
    cells = w.select("table_id", "ord", "left", "top", "right", "bottom", (F.col("ord") % 5).alias("k"))
    spans = F.when(F.col("k") == 1, F.array(F.lit("<td"), F.lit(' colspan="2"'), F.lit(">"), F.lit("</td>"))).when(F.col("k") == 3, F.array(F.lit("<td"), F.lit(' rowspan="2"'), F.lit(">"), F.lit("</td>"))).otherwise(F.array(F.lit("<td></td>")))
    opened = F.when(F.col("ord") % 3 == 0, F.array(F.lit("<tr>"))).otherwise(F.array().cast("array<string>"))
    box = F.array(*[F.col(c).cast("double") for c in ("left", "top", "right", "top", "right", "bottom", "left", "bottom")])
    cells = cells.select("table_id", "ord", F.concat(opened, spans).alias("t"), F.concat(F.transform(opened, lambda _: F.lit(None).cast("array<double>")), F.array(box), F.array_repeat(F.lit(None).cast("array<double>"), F.size(spans) - 1)).alias("b"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "t", "b")))
    return cells.groupBy("table_id").agg(listed.alias("x")).select("table_id", F.flatten("x.t").alias("tokens"), F.flatten("x.b").alias("boxes"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, ts, frame_no, corners (4 points or null), frame_area, blur_variance: events as camera frames."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    jitter = (F.col("event_id") % 9).cast("double") + F.hour("ts")
    corner = lambda x, y: F.struct((x + jitter).alias("x"), F.lit(y).cast("double").alias("y"))
    quad = F.array(corner(F.lit(10.0), 10), corner(F.lit(210.0), 10), corner(F.lit(210.0), 160), corner(F.lit(10.0), 160))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "ts", (F.row_number().over(order) - 1).cast("long").alias("frame_no"), F.when(F.col("event_type") != "error", quad).alias("corners"),
        F.lit(60_000.0).alias("frame_area"), (F.col("value") * 10).alias("blur_variance"),
    )


FRAMES_SQL = """
frames AS (SELECT user_id AS session_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, event_type <> 'error' AS found,
  10.0 + event_id % 9 + hour(ts) AS x, 60000.0 AS frame_area, value * 10 AS blur_variance FROM events)"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, h, w, data: embeddings as grey pictures of 8 by 8 pixels."""
    grey = F.transform("embedding", lambda v: clamp(F.floor(128 + 256 * v), 0, 255).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), grey.alias("data"))


RASTERS_SQL = """
rasters AS (SELECT vec_id AS page_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + 256 * v::DOUBLE)::BIGINT))) AS data FROM embeddings),
pixels AS (SELECT page_id, i // 8 AS y, i % 8 AS x, data[i + 1] AS v FROM (SELECT page_id, data, unnest(generate_series(0, 63)) AS i FROM rasters))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, step, logits: embeddings as the steps of sequences of 25."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 25").alias("seq_id"), (F.col("vec_id") % 25).alias("step"), F.col("embedding").alias("logits"))


LOGITS_SQL = "logits AS (SELECT vec_id // 25 AS seq_id, vec_id % 25 AS step, embedding AS logits FROM embeddings)"


def html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, region_no, class_id, full_text: headings, paragraphs, footers and menus of web pages. Pages are
    dealt to documents of five."""
    rx = r"(?s)<(h1|p|footer|nav)\b[^>]*>(.*?)</\1>"
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]*>", " "), r"\s+", " ")
    rows = table(spark, sf_dir, "pages").select(
        F.expr("page_id div 5").alias("doc_id"), (F.col("page_id") % 5).cast("int").alias("page_no"),
        F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(rx), 1).alias("tag"), F.regexp_extract_all("html", F.lit(rx), 2).alias("body"))).alias("region_no", "r"),
    )
    kind = F.when(F.col("r.tag") == "h1", 11).when(F.col("r.tag") == "p", 2).when(F.col("r.tag") == "footer", 15).otherwise(13)
    return rows.select("doc_id", "page_no", "region_no", kind.alias("class_id"), tx.unescape(plain(F.col("r.body"))).alias("full_text"))


HTML_SQL = r"""
tags AS (SELECT page_id // 5 AS doc_id, page_id % 5 AS page_no, regexp_extract_all(html, '(?s)(<h1\b[^>]*>.*?</h1>|<p\b[^>]*>.*?</p>|<footer\b[^>]*>.*?</footer>|<nav\b[^>]*>.*?</nav>)') AS parts FROM pages),
html_regions AS (SELECT doc_id, page_no, region_no, CASE WHEN part LIKE '<h1%' THEN 11 WHEN part LIKE '<p%' THEN 2 WHEN part LIKE '<footer%' THEN 15 ELSE 13 END AS class_id,
  replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part, '(?s)^<[^>]*>', ''), '(?s)</[a-z0-9]+>$', ''), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'),
    '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS full_text
  FROM (SELECT doc_id, page_no, unnest(generate_series(0, len(parts) - 1)) AS region_no, unnest(parts) AS part FROM tags))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, position, page_id, rotation: conversations as page lists."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("position"), F.concat_ws("-", "conv_id", "turn").alias("page_id"), ((F.col("turn") % 4) * 90).cast("int").alias("rotation")
    )


SESSIONS_SQL = "sessions AS (SELECT conv_id AS session_id, turn AS position, conv_id || '-' || turn AS page_id, (turn % 4) * 90 AS rotation FROM conversations)"
