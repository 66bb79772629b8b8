"""Documents from regions, pagination, sessions and steady frames; the flagship is document_blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, pagination, session
from ..schemas import STYLES, styles, values_sql
from ..shared import scratch_path
from ..sources import adapters
from ..streaming import capture
from .common import widened
from .layout_queries import CLASSES_SQL

NO_ROWS = "array<array<string>>"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of web pages, each seventh page of a document with a small table and an image in place of two paragraphs."""
    r = adapters.html_regions(spark, sf_dir)
    kind = F.when((F.col("class_id") == 2) & (F.col("region_no") % 7 == 3), 8).when((F.col("class_id") == 2) & (F.col("region_no") % 7 == 5), 1).otherwise(F.col("class_id"))
    pars = F.split("full_text", r"\. ")
    return r.withColumns({
        "class_id": kind, "paragraphs": F.when(F.col("region_no") % 2 == 0, pars).otherwise(F.array(F.lit(" "))), "table_rows": F.when(kind == 8, F.transform(pars, lambda p, i: F.when(i % 2 == 0, F.array(p)).otherwise(F.array(F.substring(p, 1, 12), p)))).cast(NO_ROWS),
        "image_ref": F.when(kind == 1, F.concat_ws("/", "doc_id", "page_no", "region_no")),
    })


REGIONS_CTE = r"""regions AS (SELECT doc_id, page_no, region_no, CASE WHEN class_id = 2 AND region_no % 7 = 3 THEN 8 WHEN class_id = 2 AND region_no % 7 = 5 THEN 1 ELSE class_id END AS class_id, full_text FROM html_regions)"""
TRIM = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of documents in order, with their documents' running header and footer. Pages without regions give their
    plain paragraphs; of a failed page, regions don't count."""
    regions = _regions(spark, sf_dir)
    pages = adapters.table(spark, sf_dir, "pages").select(F.expr("page_id div 5").alias("doc_id"), (F.col("page_id") % 5).cast("int").alias("page_no"), F.array("url", F.lit(" ")).alias("paragraphs"), (F.col("page_id") % 11 == 4).alias("failed"))
    blocks, good = documents.assembled(pages, regions, ["doc_id", "page_no"])
    blocks = documents.numbered(blocks, ["doc_id"], "page_no")
    texts = documents.running_texts(good, ["doc_id"], "page_no")
    return blocks.join(texts, "doc_id", "left").select("doc_id", "page_no", "block_no", "kind", "rows", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "image_ref", "header_text", "footer_text")])


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the blocks of documents with their header and footer."""
    return widened(_blocks(spark, sf_dir).select("doc_id", "page_no", "block_no", "kind", "text", F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), "image_ref", "header_text", "footer_text"))


BLOCKS_CTE = f"""{adapters.HTML_SQL}, {REGIONS_CTE}, {CLASSES_SQL},
pg AS (SELECT page_id // 5 AS doc_id, page_id % 5 AS page_no, url, page_id % 11 = 4 AS failed FROM pages),
good AS (SELECT r.* FROM regions r JOIN pg USING (doc_id, page_no) WHERE NOT failed),
typed AS (SELECT g.*, role, string_split(full_text, '. ') AS ps, {TRIM.format("full_text")} AS whole FROM good g JOIN classes c USING (class_id) WHERE role <> 'SKIP'),
texts AS (SELECT doc_id, page_no, region_no, role, CASE WHEN role = 'PARAGRAPH' AND region_no % 2 = 0 AND len(list_filter(ps, lambda p: trim(p) <> '')) > 0 THEN list_filter(ps, lambda p: trim(p) <> '') WHEN role IN ('TABLE', 'IMAGE') THEN [''] WHEN whole <> '' THEN [whole] ELSE [] END AS ts,
  CASE WHEN role = 'TABLE' THEN ps ELSE [] END AS trows, CASE WHEN role = 'IMAGE' THEN doc_id || '/' || page_no || '/' || region_no ELSE '' END AS image_ref FROM typed),
parts AS (SELECT doc_id, page_no, region_no, i AS part_no, role AS kind, ts[i] AS text, trows, image_ref FROM (SELECT *, unnest(generate_series(1, len(ts))) AS i FROM texts WHERE len(ts) > 0)
  UNION ALL SELECT doc_id, page_no, 0, 1, 'PARAGRAPH', url, [], '' FROM pg WHERE failed OR (doc_id, page_no) NOT IN (SELECT doc_id, page_no FROM good)),
found AS (SELECT doc_id, page_no, region_no, class_id, {TRIM.format("full_text")} AS t FROM good WHERE class_id IN (13, 15)),
last AS (SELECT doc_id, page_no, class_id, max_by(t, region_no) AS t FROM found WHERE t <> '' GROUP BY ALL),
running AS (SELECT doc_id, min_by(t, page_no) FILTER (class_id = 13) AS h, min_by(t, page_no) FILTER (class_id = 15) AS f FROM last GROUP BY doc_id),
blocks AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, region_no, part_no) - 1 AS block_no, kind, text, trows, len(trows) AS n_rows, image_ref, coalesce(h, '') AS header_text, coalesce(f, '') AS footer_text FROM parts LEFT JOIN running USING (doc_id))"""
DOCUMENT_BLOCKS = f"WITH {BLOCKS_CTE} SELECT doc_id, page_no, block_no, kind, text, n_rows::BIGINT AS n_rows, image_ref, header_text, footer_text FROM blocks"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the flagship's blocks, texts, tables and images, in a style chosen by document."""
    image = F.col("kind") == "IMAGE"
    sides = {"image_w": F.when(image, F.lit(256) * (F.col("block_no") % 3)), "image_h": F.when(image, F.col("block_no") * 97 % 700 + 1)}  # every third has no width
    names = F.array(*[F.lit(s[0]) for s in STYLES])
    styled = _blocks(spark, sf_dir).withColumns(sides).withColumn("style", F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int"))).join(F.broadcast(pagination.geometry(styles(spark))), "style")
    return pagination.flow_items(pagination.text_items(styled))


def paginated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page and place of every text line, table row and image of documents."""
    return widened(pagination.paginated(_items(spark, sf_dir), ["doc_id"], ["block_no", "line_no"]).withColumn("y", F.round("y", 6)))


ITEMS_CTE = f"""{BLOCKS_CTE}, styles AS (SELECT * FROM ({values_sql(STYLES)}) v(style, font, line_mult, para, margin, background, ink)),
styled AS (SELECT b.*, s.style, font, font * 2.0 * CASE kind WHEN 'MAIN_TITLE' THEN 1.65 WHEN 'TITLE' THEN 1.3 ELSE 1.0 END AS px, CASE WHEN kind IN ('TITLE', 'MAIN_TITLE') THEN 1.2 ELSE line_mult END AS mult, margin * 2.0 AS margin_px, greatest(1, trunc(1240 - 4.0 * margin))::BIGINT AS content_w, (1754 - 4.0 * margin)::DOUBLE AS content_h, para * 2.0 AS spacing
  FROM blocks b JOIN styles s ON s.style = ['Plain', 'Book', 'Notes'][(doc_id % 3 + 1)::INT]),
rws AS (SELECT doc_id, block_no, content_w, (font * 2.0::DOUBLE * 0.85::DOUBLE)::DOUBLE AS px, len(trows) AS n, i - 1 AS line_no, unnest([0, 1]) AS c, trows[i] AS p FROM (SELECT *, unnest(generate_series(1, len(trows))) AS i FROM styled WHERE kind = 'TABLE')),
cls AS (SELECT *, CASE WHEN line_no % 2 = 0 THEN CASE c WHEN 0 THEN p ELSE '' END WHEN c = 0 THEN substr(p, 1, 12) ELSE p END AS t FROM rws WHERE c = 0 OR n > 1),
ideal AS (SELECT doc_id, block_no, c, greatest(80.0, max(length(t) * px * 0.5::DOUBLE) + 24.0)::DOUBLE AS w FROM cls GROUP BY ALL),
wid AS (SELECT doc_id, block_no, c, w, sum(w) OVER (PARTITION BY doc_id, block_no) AS total FROM ideal),
trow AS (SELECT doc_id, block_no, line_no, max(greatest(1, ceil(length(t) * px * 0.5::DOUBLE / greatest(1, trunc(w * content_w / total - 24.0))))) * max(ceil(px * 1.1::DOUBLE)) + 16.0 AS tall FROM cls JOIN wid USING (doc_id, block_no, c) GROUP BY ALL),
img AS (SELECT doc_id, block_no, CASE WHEN block_no % 3 = 0 THEN 0.0 ELSE least(content_w * ((block_no * 97 % 700 + 1)::DOUBLE / (256 * (block_no % 3))), content_h) END AS tall FROM styled WHERE kind = 'IMAGE'),
sized AS (SELECT *, CASE WHEN kind = 'TABLE' THEN n_rows WHEN kind = 'IMAGE' THEN 1 WHEN trim(text) = '' THEN 0 ELSE greatest(1, ceil(length(text) * px::DOUBLE * 0.5::DOUBLE / content_w))::BIGINT END AS n_lines, ceil(px::DOUBLE * mult::DOUBLE)::BIGINT AS line_h, (spacing * CASE kind WHEN 'MAIN_TITLE' THEN 1.3 ELSE 1.0 END)::DOUBLE AS after FROM styled),
items AS (SELECT doc_id, block_no, line_no, margin_px::DOUBLE AS top, (1754 - margin_px)::DOUBLE AS bottom, CASE WHEN kind = 'TABLE' THEN trow.tall WHEN kind = 'IMAGE' THEN img.tall WHEN n_lines > 0 THEN line_h ELSE 0 END::DOUBLE AS h, CASE WHEN line_no = greatest(n_lines, 1) - 1 THEN after ELSE 0.0 END AS space, header_text, footer_text, content_w,
  row_number() OVER (PARTITION BY doc_id ORDER BY block_no, line_no) AS k FROM (SELECT *, unnest(generate_series(0, greatest(n_lines, 1) - 1)) AS line_no FROM sized) LEFT JOIN trow USING (doc_id, block_no, line_no) LEFT JOIN img USING (doc_id, block_no)),
fold(doc_id, k, page_no, y, next) AS (SELECT doc_id, k, CASE WHEN h > 0 AND bottom - top < h THEN 1 ELSE 0 END, top, top + h + space FROM items WHERE k = 1
  UNION ALL SELECT i.doc_id, i.k, f.page_no + CASE WHEN i.h > 0 AND i.bottom - f.next < i.h THEN 1 ELSE 0 END, CASE WHEN i.h > 0 AND i.bottom - f.next < i.h THEN i.top ELSE f.next END, CASE WHEN i.h > 0 AND i.bottom - f.next < i.h THEN i.top ELSE f.next END + i.h + i.space FROM fold f JOIN items i ON i.doc_id = f.doc_id AND i.k = f.k + 1)"""
PAGINATED_LINES = f"WITH RECURSIVE {ITEMS_CTE.replace('items AS (', 'items AS MATERIALIZED (', 1)} SELECT i.doc_id, i.block_no, i.line_no, f.page_no::BIGINT AS page_no, round(f.y, 6) AS y FROM fold f JOIN items i USING (doc_id, k)"


def stamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, headers and footers of laid-out pages."""
    carried = ["header_text", "footer_text", "content_w"]
    placed = pagination.paginated(_items(spark, sf_dir), ["doc_id"], ["block_no", "line_no"], carried)
    docs = placed.groupBy("doc_id").agg(F.max("page_no").alias("last"), *[F.first(c).alias(c) for c in carried])
    pages = docs.select("doc_id", *carried, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page_no"))
    return widened(pagination.stamped(pages, ["doc_id"]).select("doc_id", "page_no", "label", "header", "footer"))


def _fit(text: str, width: str) -> str:
    return f"CASE WHEN length({text}) <= floor(({width}) / 10.0) THEN {text} ELSE substr({text}, 1, greatest(floor(({width}) / 10.0)::INT - 1, 0)) || '…' END"


STAMPED_PAGES = f"""WITH RECURSIVE {ITEMS_CTE.replace('items AS (', 'items AS MATERIALIZED (', 1)}, n AS (SELECT doc_id, max(page_no) + 1 AS n FROM fold GROUP BY doc_id),
t AS (SELECT doc_id, any_value(header_text) AS ht, any_value(footer_text) AS ft, any_value(content_w) AS w FROM items GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(n)) AS page_no, n, ht, ft, w FROM n JOIN t USING (doc_id))
SELECT doc_id, page_no::BIGINT AS page_no, (page_no + 1) || ' / ' || n AS label, {_fit("ht", "w")} AS header, {_fit("ft", "greatest(w - (length(n::VARCHAR) * 2 + 3) * 10.0 - 24.0, 0.0)")} AS footer FROM p"""


def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column widths, row heights and image sizes of tables in the plain style."""
    words = adapters.table_words(spark, sf_dir).select("table_id", F.expr("ord div 2").alias("row_no"), (F.col("ord") % 2).alias("col_no"), F.repeat("text", (F.col("ord") % 5).cast("int")).alias("text"))
    cells = words.withColumns({"font": F.lit(16.0), "content_w": F.lit(1144)})
    widths = pagination.column_widths(cells, ["table_id"])
    heights = pagination.row_heights(cells, widths, ["table_id"])
    image = pagination.image_size(F.col("table_id") % 900 + 1, F.col("row_no") * 700 + 50, F.lit(1144), F.lit(1658.0))
    out = heights.join(widths.groupBy("table_id").agg(F.round(F.max("width"), 6).alias("widest")), "table_id")
    return widened(out.select("table_id", "row_no", "height", "widest", *[F.round(c, 6).alias(n) for n, c in image.items()]))


TABLE_LAYOUT = f"""WITH {adapters.TABLE_WORDS_SQL}, cells AS (SELECT table_id, ord // 2 AS row_no, ord % 2 AS col_no, repeat(text, (ord % 5)::INT) AS text FROM table_words),
ideal AS (SELECT table_id, col_no, greatest(80.0, max(length(text) * 27.2::DOUBLE * 0.5::DOUBLE + 24.0))::DOUBLE AS i FROM cells GROUP BY ALL), w AS (SELECT table_id, col_no, i * 1144 / sum(i) OVER (PARTITION BY table_id) AS width FROM ideal),
hh AS (SELECT table_id, row_no, max(greatest(1, ceil(length(text) * 27.2::DOUBLE * 0.5::DOUBLE / greatest(1, trunc(width - 24.0)))) * 30) + 16.0 AS height FROM cells JOIN w USING (table_id, col_no) GROUP BY ALL),
z AS (SELECT *, 1144 * ((row_no * 700 + 50)::DOUBLE / (table_id % 900 + 1)) AS tall, (row_no * 700 + 50)::DOUBLE / (table_id % 900 + 1) AS aspect FROM hh)
SELECT table_id, row_no, height::DOUBLE AS height, widest, round(CASE WHEN tall > 1658 THEN 1658.0 / aspect ELSE 1144 END, 6)::DOUBLE AS draw_w, round(least(tall, 1658.0), 6)::DOUBLE AS draw_h FROM z JOIN (SELECT table_id, round(max(width), 6) AS widest FROM w GROUP BY table_id) USING (table_id)"""


def session_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after a removal, a turn, a move and two new pages each."""
    pages = adapters.sessions(spark, sf_dir)
    ids = pages.select("session_id").distinct()
    page = lambda n: F.concat_ws("-", "session_id", F.lit(n)).alias("page_id")
    after = session.removed(pages, ids.where("session_id % 3 = 0").select("session_id", page(1)))
    after = session.rotated(after, ids.select("session_id", page(0), ((F.col("session_id") % 5 - 2) * 90).cast("int").alias("degrees")))
    after = session.moved(after, ids.select("session_id", (F.col("session_id") % 4).cast("int").alias("from_no"), (F.col("session_id") % 7).cast("int").alias("to_no")))
    after = session.appended(after, ids.where("session_id % 2 = 0").select("session_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("page_id")))
    return widened(session.labels(after).join(session.counted(after), "session_id").select("session_id", "position", "page_id", "rotation", "label", "n_pages"))


SESSION_EDITS = f"""WITH {adapters.SESSIONS_SQL}, gone AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY position, page_id) - 1 AS position, page_id, rotation FROM sessions WHERE NOT (session_id % 3 = 0 AND page_id = session_id || '-1')),
turned AS (SELECT session_id, position, page_id, CASE WHEN page_id = session_id || '-0' THEN (rotation + (session_id % 5 - 2) * 90 + 720) % 360 ELSE rotation END AS rotation, count(*) OVER (PARTITION BY session_id) AS n, session_id % 4 AS a, session_id % 7 AS b FROM gone),
moved AS (SELECT session_id, CASE WHEN a >= n OR b >= n OR a = b THEN position WHEN position = a THEN b WHEN position > a AND position <= b THEN position - 1 WHEN position < a AND position >= b THEN position + 1 ELSE position END AS position, page_id, rotation FROM turned),
ends AS (SELECT session_id, max(position) + 1 AS e FROM moved GROUP BY session_id),
added AS (SELECT * FROM moved UNION ALL SELECT s.session_id, coalesce(e, 0) + i, p, 0 FROM (SELECT DISTINCT session_id FROM sessions WHERE session_id % 2 = 0) s LEFT JOIN ends USING (session_id), (VALUES (0, 'x'), (1, 'y')) v(i, p))
SELECT session_id, position::BIGINT AS position, page_id, rotation, 'Page ' || (position + 1)::BIGINT AS label, count(*) OVER (PARTITION BY session_id) AS n_pages FROM added"""


def stable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady frames of camera sessions, in batch."""
    rows = capture.stable_frames(adapters.frames(spark, sf_dir), needed=3)
    return widened(rows.select("session_id", "frame_no", "stable_count", "stable"))


STABLE_FRAMES = f"""WITH {adapters.FRAMES_SQL}, ok AS (SELECT *, found AND 200 * 150 >= frame_area * 0.35 AND coalesce(blur_variance >= 45.0, false) AS ok FROM frames),
jumps AS (SELECT *, NOT ok OR NOT coalesce(lag(ok) OVER w, false) OR coalesce(abs(x - lag(x) OVER w) > 14.0, true) AS new FROM ok WINDOW w AS (PARTITION BY session_id ORDER BY ts, frame_no)),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY session_id ORDER BY ts, frame_no ROWS UNBOUNDED PRECEDING) AS run FROM jumps),
c AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY session_id, run ORDER BY ts, frame_no) ELSE 0 END AS stable_count FROM runs)
SELECT session_id, frame_no, stable_count, stable_count >= 3 AS stable FROM c"""


def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions as a stream: one row per session with its stable frames and captures. The state is kept
    from batch to batch; the SQL counts islands. The state store and the results are in the shared folder and not on one machine."""
    folder = scratch_path(spark, "frames")
    spark.conf.set(*capture.ROCKSDB)
    adapters.frames(spark, sf_dir).coalesce(4).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(adapters.frames(spark, sf_dir).schema).parquet(f"{folder}/in")
    query = capture.steady_stream(source, needed=3).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(capture.OUTPUT).parquet(f"{folder}/out")
    return widened(out.groupBy("session_id").agg(F.count("*").alias("frames"), F.count_if("stable").alias("stable_frames"), F.count_if("captured").alias("captures")))


CAPTURE_STREAM = f"""{STABLE_FRAMES.partition("SELECT session_id, frame_no, stable_count")[0]}SELECT session_id, count(*) AS frames, count(*) FILTER (stable_count >= 3) AS stable_frames, count(*) FILTER (stable_count = 3) AS captures FROM c GROUP BY session_id"""
QUERIES = {f.__name__: f for f in (document_blocks, paginated_lines, stamped_pages, table_layout, session_edits, stable_frames, capture_stream)}
ORACLE_SQL = {
    "document_blocks": DOCUMENT_BLOCKS, "paginated_lines": PAGINATED_LINES, "stamped_pages": STAMPED_PAGES, "table_layout": TABLE_LAYOUT, "session_edits": SESSION_EDITS, "stable_frames": STABLE_FRAMES,
    "capture_stream": CAPTURE_STREAM,
}
