"""Hand-derived cases of single operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import documents, hocr, intervals, layout, ocr, pagination, quality, session, shapes, tables


def bands(spark, pairs, fraction):
    df = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(pairs)], "g int, idx int, start int, end int")
    rows = intervals.clusters(df, ["g"], "start", "end", ["idx"], fraction).orderBy("cluster_no", "start", "idx").collect()
    out = {}
    for r in rows:
        out.setdefault(r.cluster_no, []).append(r.idx)
    return list(out.values())


@pytest.mark.parametrize(("pairs", "fraction", "want"), [
    ([(0, 10), (10, 20), (50, 60)], 0.02, [[0, 1], [2]]), ([(5, 10), (0, 4)], 0.02, [[1], [0]]), ([(0, 100), (10, 20), (50, 60)], 0.02, [[0, 1, 2]]), ([(0, 400), (408, 1000)], 0.02, [[0, 1]]),
    ([(0, 400), (420, 1000)], 0.02, [[0], [1]]), ([(0, 30), (40, 70), (100, 130)], 0.035, [[0], [1], [2]]), ([], 0.02, []),
])
def test_bands(spark, pairs, fraction, want):
    assert bands(spark, pairs, fraction) == want


def test_bands_against_a_plain_scan(spark):
    rng = random.Random(3)
    rows = [(g, i, s, s + rng.randrange(0, 40, 5)) for g in range(60) for i in range(rng.randint(1, 14)) for s in [rng.randrange(0, 300, 5)]]
    df = spark.createDataFrame(rows, "g int, idx int, start int, end int")
    got = {(r.g, r.idx): r.cluster_no for r in intervals.clusters(df, ["g"], "start", "end", ["idx"], 0.035).collect()}
    for g in range(60):
        own = sorted([r for r in rows if r[0] == g], key=lambda r: (r[2], r[1]))
        gap = max(1, int(np.float32(max(1, max(r[3] for r in own) - min(r[2] for r in own))) * np.float32(0.035)))
        n, far = -1, None
        for r in own:
            if far is None or r[2] - far >= gap:
                n += 1
            far = r[3] if far is None else max(far, r[3])
            assert got[g, r[1]] == n


def test_touching_rows_split(spark):
    df = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "g int, ord int, top int, bottom int")
    assert [r.row_no for r in intervals.rows(df, ["g"], "top", "bottom", ["ord"]).orderBy("ord").collect()] == [0, 1]


def test_runs(spark):
    df = spark.createDataFrame([(1, p) for p in (3, 4, 5, 9)], "g int, pos int")
    assert [r.pos for r in intervals.runs(df, ["g"], "pos").orderBy("boundary_no").collect()] == [4, 9]


def test_reading_order():
    box = {"T": (0, 0, 400, 20), "L1": (0, 40, 190, 100), "R1": (210, 40, 400, 100), "L2": (0, 110, 190, 200), "R2": (210, 110, 400, 200)}
    order = lambda b: [list(b)[i] for i in layout.read_order(np.array(list(b.values())))]
    assert order(box) == ["T", "L1", "R1", "L2", "R2"]
    assert order({k: v for k, v in (box | {"R1": (210, 40, 400, 200)}).items() if k != "R2"}) == ["T", "L1", "L2", "R1"]
    assert layout.read_order(np.empty((0, 4), int)) == []


HOCR = (
    "<span class='ocrx_word' title='bbox 1 1 2 2; x_wconf 50'>early</span><p class='ocr_par' id='p'><span class='ocr_line' id='l'>"
    "<span class='ocrx_word' id='word_1_1' title='bbox 34 22 187 45; x_wconf 96'>Hello</span> <span class='ocrx_word' title='bbox 1 2 3 4'>plain</span></span>"
    "<span class='ocr_line'><span class='ocrx_word' title='bbox 5 6 7 8; x_wconf 9'> &amp;lt;\t</span><span class='ocrx_word' title='bbox 5 6 7 8; x_wconf 9'> </span></span></p>"
)


def test_hocr(spark):
    pages = spark.createDataFrame([(1, HOCR), (2, "")], "id int, hocr string")
    assert [(r.text, r.left, r.top, r.right, r.bottom, r.confidence) for r in hocr.words(pages, ["id"]).orderBy("word_no").collect()] == [("early", 1, 1, 2, 2, 50.0), ("Hello", 34, 22, 187, 45, 96.0), ("<", 5, 6, 7, 8, 9.0)]
    assert [r.text for r in hocr.paragraphs(pages, ["id"]).collect()] == ["Hello plain <"]
    assert [r.text for r in hocr.lines(pages, ["id"]).orderBy("line_no").collect()] == ["Hello plain", "<"]
    assert [(r.line_no, r.text) for r in hocr.line_words(pages, ["id"]).orderBy("line_no").collect()] == [(0, "Hello"), (1, "<")]


@pytest.mark.parametrize(("tokens", "want"), [
    (["<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "<tr>", "<td></td>", "<td></td>"], [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]),
    (["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>"], [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]),
    (["<td></td>", "<tr>", "<td></td>"], [(0, 0, 1, 1), (0, 1, 1, 1)]), (["<tr>", "<td", ' colspan="0"', ">", "</td>", "<td></td>"], [(0, 0, 1, 0), (0, 0, 1, 1)]),
    (["<tr>", "<td", ' rowspan="2000000000"', ">", "<tr>", "<td></td>"], [(0, 0, 2_000_000_000, 1), (1, 1, 1, 1)]), ([], []),
])
def test_structure_tokens(tokens, want):
    assert [(c["row_start"], c["col_start"], c["row_span"], c["col_span"]) for c in tables.grid_cells(tokens)] == want


def test_word_on_a_rule_is_in_both_cells(spark):
    edges = lambda ps: spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "t int, boundary_no int, pos int")
    words = spark.createDataFrame([(1, 0, "x", 40, 0, 60, 10)], "t int, ord int, text string, left int, top int, right int, bottom int")
    assert [r.text for r in tables.lattice_grid(edges([0, 20]), edges([0, 50, 100]), words, ["t"]).orderBy("col_no").collect()] == ["x", "x"]


def test_greedy_text(spark):
    best = [0, 5, 5, 0, 5, 3, 3]
    steps = spark.createDataFrame([(1, t, [float(i == b) for i in range(6)]) for t, b in enumerate(best)] + [(2, 0, [float("nan"), 1.0, 0.5, 0.0, 0.0, 0.0])], "s int, step int, logits array<float>")
    got = {r.s: r.text for r in ocr.greedy_text(steps, ["s"], ["", "a", "b", "c", "d", "e"]).collect()}
    assert got == {1: "eec", 2: "a"}


def test_word_boxes_and_paragraphs(spark):
    lines = spark.createDataFrame([(1, 0, "ab cde", 0, 0, 50, 20), (1, 1, "one two three", 7, 24, 100, 44), (1, 2, "x", 0, 60, 9, 80)], "p int, line_no int, text string, left int, top int, right int, bottom int")
    assert [(r.left, r.right) for r in ocr.word_boxes(lines, ["p"]).orderBy("line_no", "word_no").collect()] == [(0, 20), (20, 50), (7, 32), (32, 57), (57, 100), (0, 9)]
    assert [r.text for r in ocr.paragraphs(lines, ["p"]).orderBy("par_no").collect()] == ["ab cde one two three", "x"]


@pytest.mark.parametrize(("measures", "score", "message"), [
    ((75.0, 200.0, 0.0), 70, quality.GOOD), ((300.0, 200.0, 0.0), 100, quality.EXCELLENT), ((150.0, 250.0, 0.0), 80, quality.EXCELLENT),
    ((30.0, 100.0, 0.3), 0, f"{quality.BETTER}{quality.BLURRY}; {quality.DARK}"), ((74.0, 129.0, 0.05), 49, f"{quality.BETTER}{quality.BLURRY}; {quality.DARK}"),
])
def test_quality(spark, measures, score, message):
    v, m, c = (F.lit(x) for x in measures)
    row = spark.range(1).select(quality.score(v, m, c).alias("s")).select("s", quality.message(F.col("s"), v, m).alias("m")).first()
    assert (row.s, row.m) == (score, message)


def test_sizes_and_names(spark):
    side = lambda w, h: spark.range(1).select(*[geo.detector_side(F.lit(x), F.greatest(F.lit(w), F.lit(h))) for x in (w, h)]).first()[:]
    assert [tuple(side(*x)) for x in ((3000, 4000), (640, 480), (10, 10), (1240, 1754))] == [(736, 960), (640, 480), (32, 32), (672, 960)]
    names = spark.createDataFrame([("a/b:c?",), (" \t",), (None,)], "n string").select(tx.clean_name(F.col("n")).alias("c")).collect()
    assert [r.c for r in names] == ["a_b_c_", None, None]
    assert spark.range(1).select(geo.turned(F.lit(0), F.lit(-90)), geo.turned(F.lit(270), F.lit(90))).first()[:] == (270, 0)
    assert spark.range(1).select(tx.unescape(F.lit("&amp;lt; &copy;"))).first()[0] == "< &copy;"


def test_moves(spark):
    pages = spark.createDataFrame([(1, i, c, 0) for i, c in enumerate("ABCD")], "session_id int, position int, page_id string, rotation int")
    move = lambda a, b: "".join(r.page_id for r in session.moved(pages, spark.createDataFrame([(1, a, b)], "session_id int, from_no int, to_no int")).orderBy("position").collect())
    assert (move(0, 2), move(1, 9), move(3, 0)) == ("BCAD", "ABCD", "DABC")


def test_running_texts(spark):
    rows = [(1, 1, 0, 13, "x"), (1, 1, 1, 13, " y "), (1, 1, 2, 13, " "), (1, 2, 0, 13, "z"), (1, 2, 1, 15, "f"), (2, 0, 0, 2, "t")]
    df = spark.createDataFrame(rows, "doc int, page int, region_no int, class_id int, full_text string")
    assert [tuple(r) for r in documents.running_texts(df, ["doc"], "page").collect()] == [(1, "y", "f")]


def test_tall_items_terminate():
    items = [{"height": 30.0, "after": 0.0}, {"height": 500.0, "after": 5.0}, {"height": 10.0, "after": 0.0}]
    assert [(p["page_no"], p["y"]) for p in pagination.placed(items, 10.0, 100.0)] == [(0, 10.0), (1, 10.0), (2, 10.0)]


def test_corner_order_ties(spark):
    q = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    c = spark.range(1).select(shapes.ordered_corners(q).alias("c"), shapes.area(q).alias("a")).first()
    assert [(p.x, p.y) for p in c.c] == [(0, 0), (10, 0), (10, 10), (0, 10)] and c.a == 100
