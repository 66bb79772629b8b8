"""Table structure: token streams to cells, words to cells, and the order in which the ways are tried."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, in_order
from ..shared import stored
from . import intervals

COLUMN_GAP = 0.035
CELL_OPENERS = ("<td>", "<td", "<td></td>")
SPANS = {"c": re.compile(r'colspan="(\d+)"'), "r": re.compile(r'rowspan="(\d+)"')}
MOST_SPAN = 2**31 - 1
#: Places of a grid that are all listed. A larger one, which takes spans of huge numbers, has the rows and columns in which
#: a cell begins.
MOST_PLACES = 1_000_000
PLACES = ("cell_no", "row_start", "col_start", "row_span", "col_span", "token_no")
CELLS = f"array<struct<{','.join(f'{n}:long' for n in PLACES)}>>"
CELLS_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in PLACES]))


class Occupied:
    """Columns that cells of earlier rows or of this row still cover; spans are kept as ranges, however large."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, int, int, int]] = []

    def free_from(self, row: int, col: int) -> int:
        moved = True
        while moved:
            moved = False
            for top, bottom, left, right in self.ranges:
                if top <= row < bottom and left <= col < right:
                    col, moved = right, True
        return col

    def add(self, row: int, col: int, rows: int, cols: int) -> None:
        self.ranges = [x for x in self.ranges if x[1] > row]
        if rows > 0 and cols > 0:
            self.ranges.append((row, row + rows, col, col + cols))


def grid_cells(tokens: Sequence[str]) -> list[dict]:
    """Cells of a structure stream. A row mark starts the next row (the first one starts row 0), a cell goes to the next
    free column, its spans cover further places; other tokens count for nothing."""
    taken, out = Occupied(), []
    row, col, begun, at = 0, 0, False, 0
    while at < len(tokens):
        opener, token = at, tokens[at]
        at += 1
        if token == "<tr>":
            row, col, begun = row + begun, 0, True
        elif token in CELL_OPENERS:
            spans = {"c": 1, "r": 1}
            if token == "<td":
                while at < len(tokens) and tokens[at] != ">":
                    for kind, rx in SPANS.items():
                        if m := rx.search(tokens[at]):
                            n = int(m[1])
                            spans[kind] = n if n <= MOST_SPAN else 1
                    at += 1
                at += 1
            col = taken.free_from(row, col)
            out.append({"cell_no": len(out), "row_start": row, "col_start": col, "row_span": spans["r"], "col_span": spans["c"], "token_no": opener})
            taken.add(row, col, spans["r"], spans["c"])
            col += spans["c"]
            if at < len(tokens) and tokens[at] == "</td>":
                at += 1
    return out


def _cells(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in lists:
        yield pa.array([grid_cells(t or []) for t in batch.to_pylist()], CELLS_TYPE)


def cells_of_tokens(streams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cell_no, row_start, col_start, row_span, col_span, box for streams of keys, tokens, boxes (null or 8 numbers)."""
    made = streams.select(*keys, "boxes", F.arrow_udf(_cells, CELLS)(F.col("tokens")).alias("cells"))
    each = made.select(*keys, "boxes", F.explode("cells").alias("c"))
    return each.select(*keys, "c.cell_no", "c.row_start", "c.col_start", "c.row_span", "c.col_span", F.get("boxes", F.col("c.token_no").cast("int")).alias("box"))


def decoded_tokens(steps: DataFrame, keys: Sequence[str], vocabulary: Sequence[str], start: str = "sos", end: str = "eos") -> DataFrame:
    """keys, step, token, box of steps (keys, step, logits, box): the most likely token of each step up to the first end;
    starts and indices beyond the vocabulary are skipped, and only cells keep their box."""
    whole = Window.partitionBy(*keys)
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    best = steps.select(*keys, "step", argmax(F.col("logits")).alias("idx"), "box")
    cut = best.withColumn("_end", F.min(F.when(F.col("idx") == len(vocabulary) - 1, F.col("step"))).over(whole)).where("_end is null or step < _end")
    named = cut.withColumn("token", F.get(vocab, F.col("idx"))).where(F.col("token").isNotNull() & (F.col("token") != start))
    return named.select(*keys, "step", "token", F.when(F.col("token").isin(*CELL_OPENERS), F.col("box")).alias("box"))


def argmax(logits):
    """Index of the largest number, the first among equals; not-a-numbers never win, and 0 is the answer without any number."""
    numbers = F.transform(logits, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    return F.greatest(F.array_position(numbers, F.array_max(numbers)) - 1, F.lit(0)).cast("int")


def learned_grid(cells: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row_no, col_no, text: a dense grid of cells (with box) and the words whose centre is in a cell's box, edges
    included. A cell without a box or word is blank, as are the places that a span covers; of two cells in one place
    the later one counts. Of a grid of over MOST_PLACES places only the rows and columns in which a cell begins are listed."""
    xs, ys = (F.transform(F.sequence(F.lit(i), F.lit(i + 6), F.lit(2)), lambda k: F.get("box", k)) for i in (0, 1))
    edges = [f(c).alias(n) for n, f, c in (("x1", F.array_min, xs), ("x2", F.array_max, xs), ("y1", F.array_min, ys), ("y2", F.array_max, ys))]
    sized = cells.select(*keys, "cell_no", F.col("row_start").alias("row_no"), F.col("col_start").alias("col_no"), (F.col("row_start") + F.col("row_span")).alias("row_end"), (F.col("col_start") + F.col("col_span")).alias("col_end"), *edges)
    cx, cy = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    met = _left_range(sized, words.select(*keys, "ord", "text", "left", cx.alias("cx"), cy.alias("cy")), keys)
    texts = met.groupBy(*keys, "cell_no", "row_no", "col_no", "row_end", "col_end").agg(in_order(("left", "ord"), "text", " ").alias("text"))
    filled = texts.groupBy(*keys, "row_no", "col_no").agg(F.max_by("text", "cell_no").alias("text"), F.max("row_end").alias("row_end"), F.max("col_end").alias("col_end"))
    begun = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("row_no", "_rows"), ("col_no", "_cols"))]
    listed = filled.groupBy(*keys).agg(_places().alias("_m"), F.max("row_end").alias("_r"), F.max("col_end").alias("_c"), *begun).where("_r > 0 and _c > 0")
    whole = F.col("_r").cast("double") * F.col("_c") <= MOST_PLACES
    rows, cols = (F.when(whole, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.col(own)) for n, own in (("_r", "_rows"), ("_c", "_cols")))
    return _dense(listed, keys, rows, cols)


def _left_range(cells: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    c, w = cells.alias("c"), words.alias("w")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"c.{k}") == F.col(f"w.{k}"))
    inside = F.col("w.cx").between(F.col("c.x1"), F.col("c.x2")) & F.col("w.cy").between(F.col("c.y1"), F.col("c.y2"))
    return c.join(w, same & inside, "left").select("c.*", "w.ord", "w.text", "w.left")


def _places():
    """An aggregate: texts by their place."""
    return F.map_from_entries(F.collect_list(F.struct(F.struct("row_no", "col_no").alias("k"), F.col("text").alias("v"))))


def _dense(listed: DataFrame, keys: Sequence[str], rows: Column, cols: Column) -> DataFrame:
    """keys, row_no, col_no, text for all places of tables (keys, _m: texts by place); places without text are blank. A table
    is one row here, so the grid needs no join."""
    text = lambda r, c: F.coalesce(F.try_element_at("_m", F.struct(r.alias("row_no"), c.alias("col_no"))), F.lit(""))
    grid = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row_no"), c.alias("col_no"), text(r, c).alias("text")))))
    return listed.select(*keys, F.explode(grid).alias("g")).select(*keys, "g.*")


def lattice_grid(rows: DataFrame, cols: DataFrame, words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row_no, col_no, text from boundaries of ruled lines (keys, boundary_no, pos). Needs two on each axis. A word
    whose centre (halved without remainder) is on a line belongs to both cells.

    The boundaries of a table are two lists in one row, which its words meet by key; a word looks its cells up by place, so
    no word is compared with a whole grid, and all sums work on one shuffle by table."""
    listed = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("boundary_no", "pos"))), lambda b: b["pos"]).alias(name)).where(F.size(name) > 1)
    ruled = listed(rows, "_ys").join(listed(cols, "_xs"), [*keys])
    numbers = lambda lines: F.sequence(F.lit(0), F.size(lines) - 2)
    around = lambda lines, at: F.filter(numbers(lines), lambda i: at.between(F.get(lines, i), F.get(lines, i + 1)))
    centred = words.select(*keys, "ord", "text", "left", F.expr("(left + right) div 2").alias("_cx"), F.expr("(top + bottom) div 2").alias("_cy"))
    met = centred.join(ruled, [*keys]).select(*keys, "ord", "text", "left", "_cx", "_xs", F.explode(around("_ys", F.col("_cy"))).alias("row_no"))
    met = met.select(*keys, "ord", "text", "left", "row_no", F.explode(around("_xs", F.col("_cx"))).alias("col_no"))
    filled = met.groupBy(*keys, "row_no", "col_no").agg(in_order(("left", "ord"), "text", " ").alias("text"))
    whole = ruled.join(filled.groupBy(*keys).agg(_places().alias("_m")), [*keys], "left")
    return _dense(whole, keys, numbers("_ys"), numbers("_xs"))


def stream_grid(words: DataFrame, keys: Sequence[str], width: str = "width") -> DataFrame:
    """keys, row_no, col_no, text from word positions alone: rows of words that overlap, bands of words without wide gaps,
    a word in the band that its centre is in.

    Bands don't overlap and hold their words whole, so that band is the word's own, and the search for it needs no join:
    all windows and sums work on one shuffle by table."""
    banded = intervals.bands(intervals.rows(words, keys, "top", "bottom", ["ord"]), keys, "left", "right", ["ord"], F.col(width), "col_no")
    return _grid_of(banded, keys, ("left", "ord"))


def _grid_of(placed: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    filled = placed.groupBy(*keys, "row_no", "col_no").agg(in_order(order, "text", " ").alias("text"))
    listed = filled.groupBy(*keys).agg(_places().alias("_m"), F.array_sort(F.collect_set("row_no")).alias("_r"), (F.max("col_no") + 1).alias("_c"))
    return _dense(listed, keys, F.col("_r"), F.sequence(F.lit(0), F.col("_c") - 1))


def recovered_grid(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row_no, col_no, text with recognised lines as rows (line_no, word_no) and columns clustered over all words."""
    numbered = intervals.clusters(words, keys, "left", "right", ["line_no", "word_no"], COLUMN_GAP, "col_no")
    return _grid_of(numbered.withColumnRenamed("line_no", "row_no"), keys, ("left", "word_no"))


def recognised(words: DataFrame, keys: Sequence[str], cells: DataFrame | None = None, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """keys, row_no, col_no, text, source: each table with words by the first way that gives it a grid: learned cells (if it
    has any), ruled lines (if it has two on each axis), word positions.

    The way is settled from counts by table before any grid is made, and each way runs on its own tables. The words with
    their way are a table in the shared folder, as three ways read them."""
    some = lambda df, least: df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
    sizes = words.select(*keys).distinct()
    if cells is not None:
        sizes = sizes.join(some(cells.where("row_start + row_span > 0 and col_start + col_span > 0"), 1).withColumn("_learned", F.lit(True)), [*keys], "left")
    if rows is not None and cols is not None:
        sizes = sizes.join(some(rows, 2).join(some(cols, 2), [*keys]).withColumn("_ruled", F.lit(True)), [*keys], "left")
    flags = [F.col(c).isNotNull() if c in sizes.columns else F.lit(False) for c in ("_learned", "_ruled")]
    ways = sizes.select(*keys, F.when(flags[0], 0).when(flags[1], 1).otherwise(2).alias("_way"))
    tagged = stored(words.join(ways, [*keys]), "tagged")
    own = lambda df, way: df.join(tagged.where(F.col("_way") == way).select(*keys).distinct(), [*keys], "left_semi")
    out = stream_grid(tagged.where("_way = 2"), keys).withColumn("source", F.lit("WORD_CLUSTERING"))
    if cells is not None:
        out = out.unionByName(learned_grid(own(cells, 0), tagged.where("_way = 0"), keys).withColumn("source", F.lit("LEARNED_MODEL")))
    if rows is not None and cols is not None:
        out = out.unionByName(lattice_grid(own(rows, 1), own(cols, 1), tagged.where("_way = 1"), keys).withColumn("source", F.lit("RULED_LINES")))
    return out


def rows_without_words(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row_no, text of tables without word boxes: a row per line, or per paragraph if there is no line; blanks go."""
    texts = F.filter(F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.col("paragraphs")), lambda t: ~blank(t))
    return pages.select(*keys, F.posexplode(texts).alias("row_no", "text"))


def table_vocabulary(lines: Sequence[str], start: str = "sos", end: str = "eos") -> list[str]:
    """The token list of a dictionary's lines: no line ends, no empty lines, no bare cell mark, the whole cell for certain,
    and both marks around them."""
    tokens = [t for t in (x.rstrip("\r\n") for x in lines) if t]
    if "<td>" in tokens:
        tokens.remove("<td>")
    return [start, *tokens, *([] if "<td></td>" in tokens else ["<td></td>"]), end]
