"""Large pictures, huge spans, meeting names, and the chains from models to texts, tables and pages."""

import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewright.operators import documents, models, ocr, pagination, raster, tables
from pagewright.sinks import pdf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def plain_groups(lit):
    """Groups of neighbouring pixels by a plain flood."""
    seen, out = ~lit, []
    for start in zip(*np.nonzero(lit)):
        if seen[start]:
            continue
        seen[start], group, todo = True, [], [start]
        while todo:
            y, x = todo.pop()
            group.append((int(y), int(x)))
            for n in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if 0 <= n[0] < lit.shape[0] and 0 <= n[1] < lit.shape[1] and not seen[n]:
                    seen[n] = True
                    todo.append(n)
        out.append(sorted(group))
    return out


def test_groups_of_pixels_against_a_plain_flood():
    rng = np.random.default_rng(4)
    for h, w, share in [(1, 1, 1.0), (7, 9, 0.0), (9, 7, 1.0), *((int(rng.integers(1, 30)), int(rng.integers(1, 30)), s) for s in np.linspace(0.1, 0.9, 40))]:
        lit = rng.random((h, w)) < share
        assert [[tuple(p) for p in g.tolist()] for g in raster.components(lit)] == plain_groups(lit)
    a = rng.integers(0, 256, (40, 50)).astype(float)
    weak, strong = raster.edges(a, 200, 200) > 0, raster.edges(a, 500, 500) > 0
    want = np.zeros_like(weak)
    for g in plain_groups(weak):
        if any(strong[p] for p in g):
            want[tuple(np.array(g).T)] = True
    assert ((raster.edges(a, 200, 500) > 0) == want).all()


def test_a_whole_page_takes_seconds():
    page = np.full((1754, 1240), 30.0)
    page[200:1500, 150:1100] = 235.0
    rng = np.random.default_rng(1)
    page[260:1400:12, 200:1000] -= rng.integers(0, 120, (95, 800))
    began = time.process_time()
    corners = raster.page_corners(page)
    assert corners is not None and np.abs(np.array(corners) - [[150, 200], [1099, 200], [1099, 1499], [150, 1499]]).max() <= 4
    assert raster.tensor(page, 960, 672, (0.5,) * 3, (0.5,) * 3).shape == (3, 960, 672)
    assert raster.upscaled(page).shape == (3508, 2480) and raster.flattened(page).shape == page.shape
    assert raster.box_regions(np.where(page > 100, 0.9, 0.1))
    assert time.process_time() - began < 60


def test_resizing_keeps_constants_and_ramps():
    ramp = np.tile(np.arange(40.0), (30, 1))
    assert (raster.resized(np.full((9, 13, 3), 77.0), 20, 31) == 77).all()
    assert np.abs(raster.resized(ramp, 30, 20)[:, 1:-1] - np.round(np.arange(20) * 2 + 0.5)[None, 1:-1]).max() <= 1
    assert raster.resized(ramp.T, 20, 30).T.tolist() == raster.resized(ramp, 30, 20).tolist()


@pytest.mark.parametrize("span", ["900000000", "2147483647", "99999999999999999999"])
def test_huge_spans_make_no_huge_grid(spark, span):
    tokens = ["<tr>", "<td", f' colspan="{span}"', f' rowspan="{span}"', ">", "</td>", "<td></td>", "<td", f' colspan="{span}"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>"]
    box = [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0] if t == "<td" else None for t in tokens]
    streams = spark.createDataFrame([(1, tokens, box), (2, ["<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "<tr>", "<td></td>", "<td></td>", "</tr>"], None)], "table_id long, tokens array<string>, boxes array<array<double>>")
    words = spark.createDataFrame([(1, 0, "word", 2, 2, 4, 4)], "table_id long, ord int, text string, left int, top int, right int, bottom int")
    rows = tables.learned_grid(tables.cells_of_tokens(streams, ["table_id"]), words, ["table_id"]).collect()
    assert len([r for r in rows if r.table_id == 2]) == 4 and len(rows) < 30
    assert sum(r.text == "word" for r in rows) >= 1


def test_names_that_end_in_numbers_do_not_meet(spark):
    names = ["a", "a", "a_1", "a", "a_1", "a_2", "a", "a_1_1", "b_01", "b", "b", "a_0", "a_99999999999999999999"]
    docs = spark.createDataFrame(list(enumerate(names)), "n long, name string").withColumn("at", F.lit("2024-01-01").cast("timestamp")).withColumn("extra", F.lit(1))
    got = [r.file_name for r in pdf.file_names(docs, "name", "at", ["n"]).orderBy("n").collect()]
    assert len(set(got)) == len(names) and all(g == f"{n}.pdf" for i, (g, n) in enumerate(zip(got, names)) if n not in names[:i])
    assert got[:4] == ["a.pdf", "a_3.pdf", "a_1.pdf", "a_4.pdf"] and got[10] == "b_1.pdf"


def test_tables_and_images_among_lines(spark):
    style = {"font": 16.0, "line_mult": 1.4, "para": 8.0, "content_w": 1144, "content_h": 1658.0, "margin_px": 48.0, "bottom_y": 1706.0, "spacing_px": 16.0}
    blocks = [("PARAGRAPH", "x" * 300, None, None, None), ("TABLE", "", [["a"], ["b", "c" * 400], []], None, None), ("IMAGE", "", None, 100, 900), ("IMAGE", "", None, 100, 0), ("TABLE", "", [[], []], None, None), ("TITLE", "end", None, None, None)]
    rows = spark.createDataFrame([(1, i, *b) for i, b in enumerate(blocks)], "doc_id long, block_no int, kind string, text string, rows array<array<string>>, image_w int, image_h int")
    items = pagination.flow_items(pagination.text_items(rows.select("*", *[F.lit(v).alias(k) for k, v in style.items()])))
    got = [(r.block_no, r.line_no, r.height, r.space) for r in items.orderBy("block_no", "line_no").collect()]
    # 5 lines of 45 pixels; the second column leaves the first a pixel, on which a letter of 13.6 takes 14 lines; the image is held to the page
    assert [g[2] for g in got[:5]] == [45.0] * 5 and [g[0] for g in got] == [0] * 5 + [1] * 3 + [2, 3, 4, 5]
    assert [g[2] for g in got[5:8]] == [14 * 30 + 16.0, 14 * 30 + 16.0, 46.0] and got[8][2] == 1658.0 and got[9][2] == got[10][2] == 0.0
    assert [g[3] for g in got[5:11]] == [0.0, 0.0, 16.0, 16.0, 16.0, 16.0]
    placed = {(r.block_no, r.line_no): (r.page_no, r.y) for r in pagination.paginated(items, ["doc_id"], ["block_no", "line_no"]).collect()}
    assert placed[1, 1] == (0, 48.0 + 5 * 45 + 16 + 436) and placed[1, 2] == (0, 48.0 + 5 * 45 + 16 + 872) and placed[2, 0] == (1, 48.0)
    assert placed[3, 0] == (1, 48.0 + 1658 + 16) and placed[5, 0][0] == 2


class Ink:
    closed = 0

    def probabilities(self, picture):
        return picture / 255.0

    def logits(self, line):
        return [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0 if line.shape[1] > 12 else -1.0]]

    def structure(self, picture):
        steps = ["sos", "<tr>", "<td></td>", "<td></td>", "</tr>", "eos"]
        vocabulary = ["sos", "<tr>", "</tr>", "<td></td>", "eos"]
        return [[float(v == s) for v in vocabulary] for s in steps], [[float(i)] * 8 for i in range(len(steps))]

    def recognise(self, picture):
        if picture.shape[0] == 1:
            raise ValueError("no text")
        return {"full_text": "read", "words": [{"text": "read", "left": 0, "top": 0, "right": 4, "bottom": 4, "confidence": 90.0}], "paragraphs": ["read"], "lines": ["read"]}


def picture(h, w, boxes=()):
    a = np.zeros((h, w))
    for top, left, bottom, right in boxes:
        a[top:bottom, left:right] = 250
    return {"h": h, "w": w, "channels": 1, "data": a.ravel().tolist()}


PAGES = "page_id long, picture struct<h:int,w:int,channels:int,data:array<double>>"


def test_lines_are_found_cut_out_and_read(spark):
    pages = spark.createDataFrame([(1, picture(60, 60, [(5, 5, 15, 50), (40, 8, 50, 18)])), (2, picture(10, 10)), (3, None)], PAGES)
    lines = models.read_lines(pages, ["page_id"], Ink, Ink, ["", "a", "b"])
    got = sorted((r.page_id, r.det_no, r.text) for r in lines.collect())
    assert got == [(1, 0, "ab"), (1, 1, "ab")]
    assert [(r.full_text, r.n_words) for r in ocr.line_page(lines, ["page_id"], ["det_no"]).collect()] == [("ab\nab", 2)]


def test_tables_are_read_from_model_steps(spark):
    crops = spark.createDataFrame([(1, picture(4, 4)), (2, None)], PAGES)
    cells = models.read_tables(crops, ["page_id"], Ink, ["sos", "<tr>", "</tr>", "<td></td>", "eos"]).orderBy("cell_no").collect()
    assert [(r.page_id, r.row_start, r.col_start, r.box[0]) for r in cells] == [(1, 0, 0, 2.0), (1, 0, 1, 3.0)]


def test_pages_that_can_not_be_read_keep_their_plain_text(spark):
    pages = spark.createDataFrame([(1, picture(4, 4)), (2, picture(1, 4))], PAGES).withColumn("paragraphs", F.array(F.lit("plain"), F.lit(" ")))
    read = models.read_pages(pages, Ink)
    assert sorted((r.page_id, r.failed, r.full_text) for r in read.collect()) == [(1, False, "read"), (2, True, "plain\n ")]
    regions = spark.createDataFrame([(p, 0, 2, "laid out", None, None, None) for p in (1, 2)], "page_id long, region_no int, class_id int, full_text string, paragraphs array<string>, table_rows array<array<string>>, image_ref string")
    blocks, _ = documents.assembled(read, regions, ["page_id"])
    assert sorted((r.page_id, r.text) for r in blocks.collect()) == [(1, "laid out"), (2, "plain")]


def test_models_are_closed(spark, tmp_path):
    class Closing(Ink):
        def close(self):
            (tmp_path / "closed").write_text("yes")

        def detect(self, picture):
            return [[0.0] * 6]

    rows = spark.createDataFrame([(1, picture(2, 2))], PAGES)
    assert rows.select(models.detect_layout(Closing)(F.col("picture")).alias("d")).collect()[0].d and (tmp_path / "closed").exists()


def test_files_are_extracted_once(spark, tmp_path):
    source, folder = tmp_path / "dictionary.txt", tmp_path / "shared"
    source.write_text("a\nb\n")
    path = models.extracted(spark, str(source), str(folder))
    assert open(path.removeprefix("file:")).read() == "a\nb\n"
    source.write_text("changed")
    assert open(models.extracted(spark, str(source), str(folder)).removeprefix("file:")).read() == "a\nb\n"
    (folder / "dictionary.txt.done").unlink()
    assert open(models.extracted(spark, str(source), str(folder)).removeprefix("file:")).read() == "changed"


def read_text(data):
    """Texts of a PDF's pages, by their fonts' codes."""
    streams = [zlib.decompress(m) for m in re.findall(rb"stream\n(.*?)\nendstream", data, re.S)]
    wide = any(b"beginbfrange" in x for x in streams)
    out = []
    for x in streams:
        for font, plain, coded in re.findall(rb"BT 3 Tr /(F\d) [^(<]*Td (?:\((.*?)(?<!\\)\)|<([0-9a-f]*)>) Tj ET", x, re.S):
            assert font == b"F1" or wide
            out.append(re.sub(rb"\\(.)", rb"\1", plain).decode("cp1252") if font == b"F1" else bytes.fromhex(coded.decode()).decode("utf-16-be"))
    return out


def test_texts_of_every_script_can_be_searched():
    texts = ["plain 50% (off)", "größe €", "漢字 and latin", "עברית", "emoji 🙂!", "Ωmega", ""]
    data = pdf.pdf_bytes([{"w": 100, "h": 50, "picture": None, "ops": [{"x": 1.0, "y": 2.0, "size": 3.0, "text": t} for t in texts]}])
    assert read_text(data) == texts and b"/ToUnicode" in data
    offsets = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data)]
    assert all(data[o:].startswith(b"%d 0 obj" % i) for i, o in enumerate(offsets, 1))
    assert b"/ToUnicode" not in pdf.pdf_bytes([{"w": 1, "h": 1, "picture": b"x", "ops": []}])


@pytest.mark.parametrize("shape", [(12, 16, 3), (1, 9), (40, 61)])
def test_denoising_takes_shifts_of_a_small_picture_together(shape, monkeypatch):
    import numpy as np

    from pagewright.operators import raster

    a = np.random.default_rng(6).integers(0, 256, shape).astype(float)
    wide = raster.padded(a, 13, 13)
    total, weights = np.zeros(shape), np.zeros(shape)
    for y in range(shape[0]):
        for x in range(shape[1]):
            own = wide[y + 10 : y + 17, x + 10 : x + 17]
            for dy in range(21):
                for dx in range(21):
                    weight = np.exp(-((own - wide[y + dy : y + dy + 7, x + dx : x + dx + 7]) ** 2).mean() / 36)
                    total[y, x] += weight * wide[y + dy + 3, x + dx + 3]
                    weights[y, x] += weight
            if shape == (40, 61) and x > 3:
                break
    calls, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda *k, **o: calls.append(1) or exp(*k, **o))
    got = raster.denoised(a)
    told = weights > 0
    assert len(calls) < 250 and (got[told] == np.rint(total[told] / weights[told])).all()


def test_all_picture_modes_take_one_python_process(spark, tmp_path):
    from pagewright.plans import raster_queries

    vectors = [[((i * 37 + k * k * (i + 1)) % 256 - 127.5) / 256 for k in range(64)] for i in range(4)] + [None, [0.5] * 63]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = raster_queries.enhanced_pictures(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.page_id: r for r in found.collect()}
    modes = {"original": raster.MODES["original"], "grey": raster.grey, "bw": raster.black_and_white, "light": raster.even_light, "contrast": raster.contrast, "sharp": raster.sharpened, "big": raster.upscaled, "flat": raster.flattened, "full": raster.enhanced}
    pictures = {r.page_id: r.picture for r in raster_queries._pictures(spark, str(tmp_path)).collect()}
    for i in range(6):
        if i < 4:
            a = np.array(pictures[i].data).reshape(12, 16, 3)
            assert all(abs(got[i][n] - f(a).mean()) < 1e-6 for n, f in modes.items())
        else:  # no picture, or one of too few numbers
            assert [got[i][n] for n in modes] == [None] * 9


def test_pictures_go_through_arrow_in_parts(spark):
    rng = np.random.default_rng(3)
    shapes = [(300, 300), (300, 310), (7, 9, 3), (1, 1), (300, 290), (5, 6)]
    made = [rng.integers(0, 256, s).astype(float) for s in shapes]
    rows = [(i, {"h": a.shape[0], "w": a.shape[1], "channels": 1 if a.ndim == 2 else 3, "data": a.ravel().tolist()}) for i, a in enumerate(made)]
    rows += [(6, None), (7, {"h": 2, "w": 2, "channels": 1, "data": None}), (8, {"h": 2, "w": 2, "channels": 1, "data": [1.0] * 5}), (9, {"h": None, "w": 2, "channels": 1, "data": [1.0] * 4}), (10, {"h": 1, "w": 2, "channels": 1, "data": [1.0, None]})]

    def halved(a):
        a /= 2  # each function has a copy of its own
        return raster.resized(a, 2 * a.shape[0], 2 * a.shape[1])

    def tall(a):
        if a.shape[0] < 100:
            raise ValueError("small")
        return a.sum()

    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    got = pages.select("page_id", raster.applied(F.col("picture"), halved).alias("p"), raster.measured(F.col("picture"), {"half": lambda a: halved(a).sum(), "sum": lambda a: a.sum(), "tall": tall}).alias("m")).orderBy("page_id").collect()
    for r, a in zip(got, made):
        want = halved(a.copy())
        assert (r.p.h, r.p.w, r.p.channels) == (*want.shape, 1)[:3] and r.p.data == want.ravel().tolist()
        assert (r.m.half, r.m.sum, r.m.tall) == (want.sum(), a.sum(), a.sum() if len(a) >= 100 else None)
    assert [r.p for r in got[6:10]] == [None] * 4 and {tuple(r.m) for r in got[6:10]} == {(None, None, None)}
    assert got[10].p.w == 4 and np.isnan(got[10].m.sum)


def test_equalisation_counts_all_tiles_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    for h, w in [(12, 16), (1, 9), (33, 20)]:
        a, calls, count = rng.integers(0, 256, (h, w)).astype(float), [], np.bincount
        monkeypatch.setattr(np, "bincount", lambda *k, **o: calls.append(1) or count(*k, **o))
        got = raster.clahe(a, 2.5)
        assert len(calls) == 1 and got.shape == (h, w) and got.min() >= 0 and got.max() <= 255
        monkeypatch.undo()
    for odd in (-1.0, 256.0, np.nan):  # as before, no picture of bytes is an error and not another picture
        with pytest.raises(ValueError):
            raster.clahe(np.full((20, 20), odd), 2.5)
