"""Tables from token streams, ruled lines and word positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..sources import adapters
from .common import widened
from .layout_queries import bands_sql, span_gap

KEYS = ["table_id"]
GRID_COLUMNS = "table_id, row_no, col_no, text"


def _boundaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ruled lines of tables: rows at 0, 25, ..., 100, columns at 0, 80, ..., 400."""
    ids = adapters.table_words(spark, sf_dir).select("table_id").distinct()
    lines = lambda n, step: ids.select("table_id", F.posexplode(F.sequence(F.lit(0), F.lit(n * step), F.lit(step))).alias("boundary_no", "pos"))
    return lines(4, 25), lines(5, 80)


def table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widened(tables.stream_grid(adapters.table_words(spark, sf_dir), KEYS))


STREAM_CTE = f"""{bands_sql("table_words", "table_id", "top", "bottom", "ord", "0", "row")}, {bands_sql("row", "table_id", "left", "right", "ord", "greatest(4, trunc(width * 0.02))", "col")},
limits AS (SELECT table_id, col_no, min("left") AS x1, max("right") AS x2 FROM col GROUP BY ALL),
places AS (SELECT * FROM (SELECT DISTINCT table_id, row_no FROM col) JOIN (SELECT DISTINCT table_id, col_no FROM col) USING (table_id)),
stream AS (SELECT p.table_id, p.row_no, p.col_no, coalesce(string_agg(w.text, ' ' ORDER BY w."left", w.ord), '') AS text FROM places p JOIN limits l USING (table_id, col_no)
  LEFT JOIN col w ON w.table_id = p.table_id AND w.row_no = p.row_no AND (w."left" + w."right") // 2 BETWEEN l.x1 AND l.x2 GROUP BY ALL)"""
TABLE_STREAM = f"WITH {adapters.TABLE_WORDS_SQL}, {STREAM_CTE} SELECT {GRID_COLUMNS} FROM stream"


def table_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cols = _boundaries(spark, sf_dir)
    return widened(tables.lattice_grid(rows, cols, adapters.table_words(spark, sf_dir), KEYS))


LATTICE_CTE = """grid AS (SELECT table_id, r AS row_no, c AS col_no, r * 25 AS y1, r * 25 + 25 AS y2, c * 80 AS x1, c * 80 + 80 AS x2 FROM (SELECT DISTINCT table_id FROM table_words), range(4) a(r), range(5) b(c)),
lattice AS (SELECT g.table_id, row_no, col_no, coalesce(string_agg(text, ' ' ORDER BY "left", ord), '') AS text FROM grid g
  LEFT JOIN table_words w ON w.table_id = g.table_id AND ("left" + "right") // 2 BETWEEN x1 AND x2 AND (top + bottom) // 2 BETWEEN y1 AND y2 GROUP BY ALL)"""
TABLE_LATTICE = f"WITH {adapters.TABLE_WORDS_SQL}, {LATTICE_CTE} SELECT {GRID_COLUMNS} FROM lattice"


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of token streams with spans."""
    cells = tables.cells_of_tokens(adapters.table_tokens(spark, sf_dir), KEYS)
    return widened(cells.select("table_id", "cell_no", "row_start", "col_start", "row_span", "col_span", F.get("box", F.lit(0)).alias("x1"), F.get("box", F.lit(5)).alias("y2")))


# Cells come three to a row. In the adapter's order a cell of two columns is at 1 mod 5, one of two rows at 3 mod 5; the
# columns that cells of the row above reach down to are carried as a list from cell to cell.
CELLS_CTE = """c0 AS (SELECT table_id, ord, ord // 3 AS row_start, CASE WHEN ord % 5 = 3 THEN 2 ELSE 1 END AS row_span, CASE WHEN ord % 5 = 1 THEN 2 ELSE 1 END AS col_span, "left", bottom, top, "right" FROM table_words),
walk(table_id, ord, col_start, above, below) AS (
  SELECT table_id, ord, 0, []::INT[], CASE WHEN row_span = 2 THEN [0] ELSE []::INT[] END FROM c0 WHERE ord = 0
  UNION ALL SELECT table_id, ord, col, above, CASE WHEN row_span = 2 THEN list_append(below, col) ELSE below END FROM (
    SELECT table_id, ord, row_span, above, below, (SELECT min(k) FROM range(first, first + 20) r(k) WHERE NOT list_contains(above, k::INT))::INT AS col FROM (
      SELECT c.table_id, c.ord, c.row_span, CASE WHEN c.ord % 3 = 0 THEN w.below ELSE w.above END AS above, CASE WHEN c.ord % 3 = 0 THEN []::INT[] ELSE w.below END AS below,
        CASE WHEN c.ord % 3 = 0 THEN 0 ELSE w.col_start + CASE WHEN w.ord % 5 = 1 THEN 2 ELSE 1 END END AS first FROM walk w JOIN c0 c ON c.table_id = w.table_id AND c.ord = w.ord + 1))),
cells AS (SELECT c.table_id, c.ord AS cell_no, c.row_start, w.col_start::BIGINT AS col_start, c.row_span::BIGINT AS row_span, c.col_span::BIGINT AS col_span, "left", top, "right", bottom FROM c0 c JOIN walk w USING (table_id, ord))"""
TABLE_CELLS = f"""WITH RECURSIVE {adapters.TABLE_WORDS_SQL.replace("table_words AS (", "table_words AS MATERIALIZED (", 1)}, {CELLS_CTE}
SELECT table_id, cell_no, row_start, col_start, row_span, col_span, "left"::DOUBLE AS x1, bottom::DOUBLE AS y2 FROM cells"""


def table_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of learned cells, filled with words."""
    return widened(tables.learned_grid(tables.cells_of_tokens(adapters.table_tokens(spark, sf_dir), KEYS), adapters.table_words(spark, sf_dir), KEYS))


LEARNED_CTE = """sized AS (SELECT table_id, max(row_start + row_span) AS n_rows, max(col_start + col_span) AS n_cols FROM cells GROUP BY table_id),
filled AS (SELECT c.table_id, row_start, col_start, cell_no, coalesce(string_agg(w.text, ' ' ORDER BY w."left", w.ord), '') AS text FROM cells c LEFT JOIN table_words w ON w.table_id = c.table_id
  AND (w."left" + w."right") / 2 BETWEEN c."left" AND c."right" AND (w.top + w.bottom) / 2 BETWEEN c.top AND c.bottom GROUP BY ALL),
latest AS (SELECT table_id, row_start AS row_no, col_start AS col_no, max_by(text, cell_no) AS text FROM filled GROUP BY ALL),
learned AS (SELECT p.table_id, p.row_no, p.col_no, coalesce(l.text, '') AS text FROM (SELECT table_id, row_no, unnest(range(n_cols)) AS col_no FROM (SELECT table_id, n_cols, unnest(range(n_rows)) AS row_no FROM sized)) p LEFT JOIN latest l USING (table_id, row_no, col_no))"""
TABLE_LEARNED = f"WITH RECURSIVE {adapters.TABLE_WORDS_SQL}, {CELLS_CTE}, {LEARNED_CTE} SELECT {GRID_COLUMNS} FROM learned"


def table_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of recognised lines: words of documents, lines as rows."""
    w = adapters.words(spark, sf_dir).withColumnRenamed("doc_id", "table_id")
    # words are set apart so that there are columns at all
    spread = w.withColumns({"left": F.col("left") + (F.col("word_no") % 4) * 3000, "right": F.col("right") + (F.col("word_no") % 4) * 3000})
    return widened(tables.recovered_grid(spread, KEYS))


TABLE_RECOVERED = f"""WITH {adapters.WORDS_SQL}, spread AS (SELECT doc_id AS table_id, line_no, word_no, text, "left" + (word_no % 4) * 3000 AS "left", "right" + (word_no % 4) * 3000 AS "right" FROM words),
{bands_sql("spread", "table_id", "left", "right", "line_no, word_no", span_gap("table_id", "left", "right", 0.035), "col")},
filled AS (SELECT table_id, line_no AS row_no, col_no, string_agg(text, ' ' ORDER BY "left", word_no) AS text FROM col GROUP BY ALL)
SELECT table_id, row_no, col_no, coalesce(text, '') AS text FROM (SELECT DISTINCT table_id, row_no FROM filled) JOIN (SELECT DISTINCT table_id, col_no FROM filled) USING (table_id) LEFT JOIN filled USING (table_id, row_no, col_no)"""


def table_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table by the first way that gives it a grid: here the model knows tables of five words or more, and lines are
    ruled in those of three or more."""
    words = adapters.table_words(spark, sf_dir)
    sizes = words.groupBy("table_id").agg(F.count("*").alias("n"))
    streams = adapters.table_tokens(spark, sf_dir).where(F.size(F.array_compact("boxes")) >= 5)
    ruled = sizes.where("n >= 3")
    rows, cols = (b.join(ruled, KEYS, "left_semi") for b in _boundaries(spark, sf_dir))
    return widened(tables.recognised(words, KEYS, tables.cells_of_tokens(streams, KEYS), rows, cols))


TABLE_CASCADE = f"""WITH RECURSIVE {adapters.TABLE_WORDS_SQL}, {CELLS_CTE}, {LEARNED_CTE}, {LATTICE_CTE}, {STREAM_CTE}, n AS (SELECT table_id, count(*) AS n FROM table_words GROUP BY table_id)
SELECT {GRID_COLUMNS}, 'LEARNED_MODEL' AS source FROM learned JOIN n USING (table_id) WHERE n >= 5 UNION ALL SELECT {GRID_COLUMNS}, 'RULED_LINES' FROM lattice JOIN n USING (table_id) WHERE n BETWEEN 3 AND 4
UNION ALL SELECT {GRID_COLUMNS}, 'WORD_CLUSTERING' FROM stream JOIN n USING (table_id) WHERE n < 3"""


def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without word boxes: a row per line, or per paragraph where there is no line."""
    docs = adapters.table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    pages = docs.select(F.col("doc_id").alias("table_id"), F.when(F.col("doc_id") % 2 == 0, F.split("text", "\n")).otherwise(none).alias("lines"), F.array("text", F.lit(" \t")).alias("paragraphs"))
    return widened(tables.rows_without_words(pages, KEYS))


TABLE_FALLBACK = r"""WITH t AS (SELECT doc_id AS table_id, list_filter(CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10)) ELSE [text, ' ' || chr(9)] END, lambda x: length(regexp_replace(x, '[\s\p{Z}]+', '', 'g')) > 0) AS ts FROM documents)
SELECT table_id, i - 1 AS row_no, ts[i] AS text FROM (SELECT table_id, ts, unnest(generate_series(1, len(ts))) AS i FROM t WHERE len(ts) > 0)"""

TOKENS = ["sos", "<tr>", "<td></td>", "<td", ">", "</td>", "</tr>", *[f"t{i}" for i in range(50)], "eos"]


def token_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of logits up to the end mark; only cells keep their box."""
    steps = adapters.logits(spark, sf_dir).withColumn("box", F.when(F.col("step") < 20, F.array((F.col("step") * 8).cast("double"))))
    out = tables.decoded_tokens(steps, ["seq_id"], TOKENS)
    return widened(out.select("seq_id", "step", "token", F.get("box", F.lit(0)).alias("x1")))


BEST_SQL = "best AS (SELECT seq_id, step, list_position(logits, list_max(logits)) - 1 AS idx FROM logits)"
TOKEN_DECODE = f"""WITH {adapters.LOGITS_SQL}, {BEST_SQL}, cut AS (SELECT *, min(step) FILTER (idx = {len(TOKENS) - 1}) OVER (PARTITION BY seq_id) AS last FROM best),
vocab AS (SELECT {TOKENS!r} AS v) SELECT seq_id, step, v[idx + 1] AS token, CASE WHEN v[idx + 1] IN ('<td>', '<td', '<td></td>') AND step < 20 THEN (step * 8)::DOUBLE END AS x1 FROM cut, vocab
WHERE (last IS NULL OR step < last) AND idx < {len(TOKENS)} AND v[idx + 1] <> 'sos'"""

QUERIES = {f.__name__: f for f in (table_stream, table_lattice, table_cells, table_learned, table_recovered, table_cascade, table_fallback, token_decode)}
ORACLE_SQL = {
    "table_stream": TABLE_STREAM, "table_lattice": TABLE_LATTICE, "table_cells": TABLE_CELLS, "table_learned": TABLE_LEARNED, "table_recovered": TABLE_RECOVERED, "table_cascade": TABLE_CASCADE,
    "table_fallback": TABLE_FALLBACK, "token_decode": TOKEN_DECODE,
}
