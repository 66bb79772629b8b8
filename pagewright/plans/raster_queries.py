"""Pixels, scan quality, corners, quads and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import DEVIATION, MEAN
from ..operators import intervals, models, quality, raster, shapes
from ..sinks import pdf
from ..sources import adapters, files
from .common import widened


def scan_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur, brightness, clipping, score and message of pictures."""
    rows = quality.judged(adapters.rasters(spark, sf_dir))
    return widened(rows.select("page_id", *[F.round(c, 6).alias(c) for c in ("blur_variance", "mean_brightness", "clipped_fraction")], "score", "message"))


MIRROR = {"up": "abs(y - 1)", "down": "CASE WHEN y = 7 THEN 6 ELSE y + 1 END", "left": "abs(x - 1)", "right": "CASE WHEN x = 7 THEN 6 ELSE x + 1 END"}
MESSAGE_SQL = f"""CASE WHEN score >= 80 THEN '{quality.EXCELLENT}' WHEN blur < 50 OR m < 130 OR m > 245 THEN '{quality.BETTER}' || concat_ws('; ', CASE WHEN blur < 50 THEN '{quality.BLURRY}' END, CASE WHEN m < 130 THEN '{quality.DARK}' END, CASE WHEN m > 245 THEN '{quality.BRIGHT}' END) ELSE '{quality.GOOD}' END"""
SCORE_SQL = """scored AS (SELECT *, greatest(0.0, least(100.0, var / 150.0::DOUBLE * 100.0))::DOUBLE AS blur, CASE WHEN m BETWEEN 170 AND 245 THEN 100.0 WHEN m < 170 THEN greatest(0.0, least(100.0, m / 170.0::DOUBLE * 100.0)) ELSE greatest(0.0, least(100.0, (255.0 - m) / 10.0::DOUBLE * 100.0)) END::DOUBLE AS light FROM stats),
total AS (SELECT *, trunc(greatest(0.0, least(100.0, blur * 0.6::DOUBLE + light * 0.4::DOUBLE - greatest(0.0, least(40.0, clip * 200.0)))))::BIGINT AS score FROM scored)"""
SCAN_QUALITY = f"""WITH {adapters.RASTERS_SQL}, lap AS (SELECT page_id, v, data[(({MIRROR["up"]}) * 8 + x + 1)::INT] + data[(({MIRROR["down"]}) * 8 + x + 1)::INT] + data[(y * 8 + {MIRROR["left"]} + 1)::INT] + data[(y * 8 + ({MIRROR["right"]}) + 1)::INT] - 4 * v AS l
  FROM pixels JOIN rasters USING (page_id)), stats AS (SELECT page_id, var_pop(l)::DOUBLE AS var, avg(v)::DOUBLE AS m, count(*) FILTER (v <= 15 OR v > 240) / count(*)::DOUBLE AS clip FROM lap GROUP BY page_id), {SCORE_SQL}
SELECT page_id, round(var, 6) AS blur_variance, round(m, 6) AS mean_brightness, round(clip, 6) AS clipped_fraction, score, {MESSAGE_SQL} AS message FROM total"""


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and messages over the whole range of measures."""
    p = adapters.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 311).cast("double").alias("v"), (F.col("p_partkey") * 13 % 256).cast("double").alias("m"), (F.col("p_partkey") % 23 / 40.0).alias("c"))
    rows = p.withColumn("score", quality.score(F.col("v"), F.col("m"), F.col("c")))
    return widened(rows.select("p_partkey", "score", quality.message(F.col("score"), F.col("v"), F.col("m")).alias("message")))


QUALITY_SCORES = f"""WITH stats AS (SELECT p_partkey, (p_partkey * 7 % 311)::DOUBLE AS var, (p_partkey * 13 % 256)::DOUBLE AS m, (p_partkey % 23)::DOUBLE / 40.0::DOUBLE AS clip FROM part), {SCORE_SQL}
SELECT p_partkey, score, {MESSAGE_SQL} AS message FROM total"""


def turned_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures turned by right angles, thumbnails, grey values of colours, and rows without their padding."""
    r = adapters.rasters(spark, sf_dir).withColumn("degrees", (F.col("page_id") % 4 * 90).cast("int"))
    h, w, d = F.col("h"), F.col("w"), F.col("data")
    colour = lambda i: F.get(d, F.lit(i)).cast("double")
    return widened(r.select(
        "page_id", F.md5(F.array_join(files.turned(d, h, w, F.col("degrees")), ",")).alias("turned"), F.array_join(files.thumbnail(d, h, w), ",").alias("thumbnail"),
        F.array_join(files.packed_rows(d, F.lit(8), F.lit(6), F.lit(8)), ",").alias("packed"), F.round(colour(0) * 0.299 + colour(1) * 0.587 + colour(2) * 0.114, 6).alias("grey"),
    ))


TURNED_PICTURES = f"""WITH {adapters.RASTERS_SQL}, moved AS (SELECT page_id, v, x, y, CASE page_id % 4 WHEN 0 THEN y * 8 + x WHEN 1 THEN x * 8 + 7 - y WHEN 2 THEN (7 - y) * 8 + 7 - x ELSE (7 - x) * 8 + y END AS place FROM pixels)
SELECT page_id, md5(string_agg(v::VARCHAR, ',' ORDER BY place)) AS turned, string_agg(v::VARCHAR, ',' ORDER BY y, x) FILTER (y % 4 = 0 AND x % 4 = 0) AS thumbnail, string_agg(v::VARCHAR, ',' ORDER BY y, x) FILTER (x < 6) AS packed,
  round((max(v) FILTER (y = 0 AND x = 0) * 0.299::DOUBLE + max(v) FILTER (y = 0 AND x = 1) * 0.587::DOUBLE + max(v) FILTER (y = 0 AND x = 2) * 0.114::DOUBLE), 6) AS grey FROM moved GROUP BY page_id"""


def ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening of rows by a kernel of three pixels (erode, then dilate), lit pixels by row, and the lines they give."""
    p = adapters.rasters(spark, sf_dir).select("page_id", F.posexplode("data").alias("i", "v")).select("page_id", F.expr("i div 8").alias("y"), (F.col("i") % 8).alias("x"), F.when(F.col("v") >= 110, 255).otherwise(0).alias("b"))
    around = Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(-1, 1)
    opened = p.withColumn("b", F.min("b").over(around)).withColumn("b", F.max("b").over(around))
    lit = opened.groupBy("page_id", "y").agg(F.count_if(F.col("b") != 0).alias("lit"))
    return widened(intervals.runs(lit.where("lit >= 8 * 0.5"), ["page_id"], "y"))


RULED_LINES = f"""WITH {adapters.RASTERS_SQL}, b AS (SELECT page_id, y, x, CASE WHEN v >= 110 THEN 255 ELSE 0 END AS b FROM pixels),
e AS (SELECT page_id, y, x, min(b) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM b),
o AS (SELECT page_id, y, x, max(b) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM e),
hits AS (SELECT page_id, y FROM o GROUP BY page_id, y HAVING count(*) FILTER (b <> 0) >= 4),
runs AS (SELECT page_id, (min(y) + max(y)) // 2 AS pos FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS run FROM hits) GROUP BY page_id, run)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS boundary_no, pos FROM runs"""


def edge_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic fits of contours' upper and lower edges, and the source row of a middle pixel of the flattened page."""
    pts = adapters.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("page_id"), (F.col("l_partkey") % 43 - 1).alias("x"), ((F.col("l_suppkey") % 30) + F.col("l_quantity")).cast("double").alias("y"))
    curves = shapes.edge_curves(pts, ["page_id"], 40)
    top, bottom = shapes.quadratic_fit(curves, ["page_id"], "x", "top_y"), shapes.quadratic_fit(curves, ["page_id"], "x", "bottom_y")
    mapped = shapes.dewarp_map(top, bottom, ["page_id"], 40)
    at20 = mapped.select("page_id", "x", F.round(F.col("offset") + 20 * F.col("slope"), 4).alias("source_y"))
    return widened(at20.join(top.select("page_id", *[F.round(c, 6).alias(c) for c in "abc"]), "page_id"))


def _fit_sql(y: str, name: str) -> str:
    det = lambda a, b, c, d, e, f, g, h, i: f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"
    whole = det("s4", "s3", "s2", "s3", "s2", "s1", "s2", "s1", "s0")
    a, b, c = det("t2", "s3", "s2", "t1", "s2", "s1", "t0", "s1", "s0"), det("s4", "t2", "s2", "s3", "t1", "s1", "s2", "t0", "s0"), det("s4", "s3", "t2", "s3", "s2", "t1", "s2", "s1", "t0")
    return f"""{name}_s AS (SELECT page_id, count(*)::DOUBLE AS s0, sum(x)::DOUBLE AS s1, sum(x * x)::DOUBLE AS s2, sum(x * x * x)::DOUBLE AS s3, sum(x * x * x * x)::DOUBLE AS s4, sum({y})::DOUBLE AS t0, sum(x * {y})::DOUBLE AS t1, sum(x * x * {y})::DOUBLE AS t2 FROM curves GROUP BY page_id),
{name} AS (SELECT page_id, {a} / {whole} AS a, {b} / {whole} AS b, {c} / {whole} AS c FROM {name}_s WHERE s0 >= 10 AND abs({whole}) > 1e-9)"""


EDGE_FITS = f"""WITH curves AS (SELECT l_orderkey % 97 AS page_id, least(greatest(l_partkey % 43 - 1, 0), 39) AS x, min((l_suppkey % 30 + l_quantity)::DOUBLE) AS ty, max((l_suppkey % 30 + l_quantity)::DOUBLE) AS bym FROM lineitem GROUP BY 1, 2),
{_fit_sql("ty", "tf")}, {_fit_sql("bym", "bf")},
pts AS (SELECT tf.page_id, x, tf.a, tf.b, tf.c, tf.a * x * x + tf.b * x + tf.c AS t, bf.a * x * x + bf.b * x + bf.c AS bt FROM tf JOIN bf USING (page_id), range(40) r(x)),
lim AS (SELECT *, min(t) OVER (PARTITION BY page_id) AS tt, max(bt) OVER (PARTITION BY page_id) AS tb FROM pts)
SELECT page_id, x, round(t - tt * (greatest(bt - t, 1.0) / greatest(tb - tt, 1.0)) + 20 * (greatest(bt - t, 1.0) / greatest(tb - tt, 1.0)), 4) AS source_y, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c  FROM lim"""


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda m, n: (F.col("o_orderkey") * m % n).cast("double")
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((k(3, 40), k(5, 30)), (k(7, 40) + 200, k(11, 30)), (k(13, 40) + 210, k(17, 30) + 150), (k(19, 40), k(23, 30) + 160))])
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", points.alias("points"))


QUADS_SQL = """quads AS (SELECT o_orderkey, o_custkey, [(o_orderkey * 3 % 40)::DOUBLE, o_orderkey * 7 % 40 + 200, o_orderkey * 13 % 40 + 210, o_orderkey * 19 % 40] AS xs, [(o_orderkey * 5 % 30)::DOUBLE, o_orderkey * 11 % 30, o_orderkey * 17 % 30 + 150, o_orderkey * 23 % 30 + 160] AS ys FROM orders),
corners AS (SELECT *, abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2.0 AS area FROM quads)"""


def quad_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, corners in order, size of the flat picture, and view coordinates of quads."""
    q = _quads(spark, sf_dir).withColumn("c", shapes.ordered_corners(F.col("points")))
    size = shapes.warp_size(F.col("c"))
    fit = shapes.fit_centre(F.lit(500.0), F.lit(300.0), F.lit(250.0), F.lit(200.0))
    vx = fit["left"] + F.col("c")[0]["x"] * fit["scale"]
    return widened(q.select(
        "o_orderkey", shapes.area(F.col("points")).alias("area"), *[F.col("c")[i][a].alias(f"{a}{i}") for i in range(4) for a in "xy"], *[F.round(v, 6).alias(n) for n, v in size.items()],
        F.round(vx, 6).alias("view_x"), F.round((vx - fit["left"]) / fit["scale"], 6).alias("back_x"), shapes.touched_corner(F.col("c"), F.lit(205.0), F.lit(40.0)).alias("touched"),
        shapes.inset_quad(F.lit(250), F.lit(200))[2]["x"].alias("inset_x"),
    ))


def _pick(key: str, sign: int) -> str:
    ks = f"list_transform(range(1, 5), lambda i: {key})"
    return f"list_position({ks}, list_min({ks}))" if sign > 0 else f"5 - list_position(list_reverse({ks}), list_max({ks}))"


QUAD_CORNERS = f"""WITH {QUADS_SQL}, picked AS (SELECT *, [{_pick("xs[i] + ys[i]", 1)}, {_pick("ys[i] - xs[i]", 1)}, {_pick("xs[i] + ys[i]", -1)}, {_pick("ys[i] - xs[i]", -1)}] AS p FROM corners),
c AS (SELECT o_orderkey, area, {", ".join(f"xs[p[{i + 1}]] AS x{i}, ys[p[{i + 1}]] AS y{i}" for i in range(4))} FROM picked)
SELECT *, round(greatest(sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2), sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)), 6) AS out_w, round(greatest(sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2), sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)), 6) AS out_h,
  round((500.0 - 250.0 * 1.5) / 2.0 + x0 * 1.5, 6)::DOUBLE AS view_x, round(x0, 6) AS back_x, CASE {" ".join(f"WHEN sqrt((x{i} - 205) ** 2 + (y{i} - 40) ** 2) < 60 THEN {i}" for i in range(4))} ELSE -1 END::BIGINT AS touched, 230.0::DOUBLE AS inset_x FROM c"""


def largest_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest contour of four corners of each customer's orders, of at least 15 per cent of the picture; else the inset quad."""
    q = _quads(spark, sf_dir)
    contours = q.select("o_custkey", F.col("o_orderkey").alias("ord"), F.round(shapes.area(F.col("points")) / 500).alias("area"), (3 + F.col("o_orderkey") % 3).alias("vertices"), "points", F.lit(400.0).alias("image_area"))
    best = shapes.largest_quad(contours, ["o_custkey"], shapes.PHOTO_AREA)
    all_pages = q.select("o_custkey").distinct().join(best, "o_custkey", "left")
    corners = F.when(F.col("ord").isNull(), shapes.inset_quad(F.lit(250), F.lit(200))).otherwise(F.col("points"))
    return widened(all_pages.select("o_custkey", F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("area", F.lit(-1.0)).alias("area"), corners[0]["x"].alias("x0")))


LARGEST_QUADS = f"""WITH {QUADS_SQL}, k AS (SELECT o_custkey, o_orderkey AS ord, round(area / 500) AS area, xs[1] AS x0 FROM corners WHERE 3 + o_orderkey % 3 = 4), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY area DESC, ord) AS n FROM k WHERE area >= 60)
SELECT o_custkey, coalesce(ord, -1) AS ord, coalesce(area, -1.0) AS area, coalesce(x0, 20.0) AS x0 FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (o_custkey)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pictures of 16 by 12 pixels from three successive vectors' numbers, dealt out by page: what follows takes long
    for each, so few files or row groups would leave cores idle. A few tasks a core are enough for any size, as rows stream."""
    data = F.flatten(F.array(*[F.transform("data", lambda v, k=k: ((v * (3 + k)) % 256).cast("double")) for k in range(9)]))
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = adapters.rasters(spark, sf_dir).repartition(n, "page_id")
    return rows.select("page_id", F.struct(F.lit(12).alias("h"), F.lit(16).alias("w"), F.lit(3).alias("channels"), data.alias("data")).alias("picture"))


def enhanced_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All picture modes: what each of them gives, as a mean. No SQL: the filters work on neighbourhoods."""
    ops = {"original": raster.MODES["original"], "grey": raster.grey, "bw": raster.black_and_white, "light": raster.even_light, "contrast": raster.contrast, "sharp": raster.sharpened, "big": raster.upscaled, "flat": raster.flattened, "full": raster.enhanced}
    means = raster.measured(F.col("picture"), {n: lambda a, f=f: f(a).mean() for n, f in ops.items()})
    rows = _pictures(spark, sf_dir).select("page_id", means.alias("m"))
    return widened(rows.select("page_id", *[F.round(F.col("m")[n], 6).alias(n) for n in ops]))


def page_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners found in drawn pages: a bright quad on dark ground, a different one for each nation."""
    x0, y0 = F.col("n_nationkey") % 7 + 4, F.col("n_nationkey") % 5 + 4
    inside = lambda i: (F.floor(i / 64) >= y0) & (F.floor(i / 64) < 44 - y0) & (i % 64 >= x0) & (i % 64 < 60 - x0)
    data = F.transform(F.sequence(F.lit(0), F.lit(64 * 48 - 1)), lambda i: F.when(inside(i), 230.0).otherwise(20.0))
    rows = adapters.table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.lit(48).alias("h"), F.lit(64).alias("w"), F.lit(1).alias("channels"), data.alias("data")).alias("picture"))
    c = rows.select("n_nationkey", raster.corners(F.col("picture")).alias("c"))
    return widened(c.select("n_nationkey", F.size("c").alias("n"), *[F.get(F.get("c", F.lit(i)), F.lit(k)).alias(f"{a}{i}") for i in range(4) for k, a in enumerate("xy")]))


class BrightInk:
    """A stand-in for trained weights: bright pixels are text, and each picture column says its brightest row."""

    def probabilities(self, picture):
        return picture / 255.0

    def detect(self, picture):
        return [[2.0, 0.9, 0.0, 0.0, float(picture.shape[1]), float(picture.shape[0])]]


def model_text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a text detector on pictures, holes included, and the layout detector's rows: the model boundary. The
    SQL grows areas pixel by pixel."""
    one = F.struct("h", "w", F.lit(1).alias("channels"), F.transform("data", lambda v: v.cast("double")).alias("data"))
    rows = adapters.rasters(spark, sf_dir).select("page_id", one.alias("picture"))
    found = rows.select("page_id", models.detect_text(BrightInk, 0.52)(F.col("picture")).alias("boxes"), models.detect_layout(BrightInk)(F.col("picture")).alias("layout"))
    each = found.select("page_id", F.size("layout").alias("n_layout"), F.posexplode("boxes").alias("box_no", "b"))
    return widened(each.select("page_id", "n_layout", "box_no", "b.x", "b.y", "b.w", "b.h", F.round("b.score", 6).alias("score")))


MODEL_TEXT_BOXES = f"""WITH RECURSIVE {adapters.RASTERS_SQL}, side AS (SELECT page_id, y, x, y * 8 + x AS p, v / 255.0::DOUBLE AS v, v / 255.0::DOUBLE > 0.52::DOUBLE AS lit FROM pixels),
near AS (SELECT a.page_id, a.lit, a.p, b.p AS q FROM side a JOIN side b ON a.page_id = b.page_id AND a.lit = b.lit AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(page_id, lit, p, q) AS (SELECT page_id, lit, p, q FROM near UNION SELECT r.page_id, r.lit, r.p, n.q FROM reach r JOIN near n ON n.page_id = r.page_id AND n.p = r.q),
own AS (SELECT page_id, lit, p, min(q) AS area FROM reach GROUP BY ALL),
areas AS (SELECT o.page_id, o.lit, area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM own o JOIN side s ON s.page_id = o.page_id AND s.p = o.p GROUP BY ALL),
boxes AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lit DESC, area) - 1 AS box_no FROM areas WHERE lit OR (x0 > 0 AND y0 > 0 AND x1 < 7 AND y1 < 7))
SELECT b.page_id, 1::BIGINT AS n_layout, box_no, x0 AS x, y0 AS y, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, round(avg(s.v), 6) AS score FROM boxes b JOIN side s ON s.page_id = b.page_id AND s.x BETWEEN x0 AND x1 AND s.y BETWEEN y0 AND y1 GROUP BY ALL"""


def input_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the planes of model inputs made of pictures. No SQL: resizing interpolates."""
    rows = _pictures(spark, sf_dir)
    detector = raster.applied(F.col("picture"), lambda a: raster.tensor(a, 32, 32, MEAN, DEVIATION).transpose(1, 2, 0))
    table = raster.applied(F.col("picture"), lambda a: raster.tensor(a, 18, 24, MEAN, DEVIATION, 24).transpose(1, 2, 0))
    total = lambda p: F.round(F.aggregate(p["data"], F.lit(0.0), lambda a, v: a + v), 4)
    return widened(rows.select("page_id", total(detector).alias("detector"), total(table).alias("table"), (F.size(table["data"])).alias("numbers")))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable PDFs of five pictures each with their text, plain and compressed: their sizes and pages. No SQL: the
    result is a file."""
    pages = adapters.rasters(spark, sf_dir).select(
        F.expr("page_id div 5").alias("doc_id"), (F.col("page_id") % 5).cast("int").alias("page_no"), "w", "h",
        F.unhex(F.array_join(F.transform("data", lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("picture"),
        F.array(F.struct(F.lit(1.0).alias("x"), F.lit(7.0).alias("y"), F.lit(6.0).alias("size"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("text"))).alias("ops"),
    )
    both = pdf.documents(pages, ["doc_id"]).withColumnRenamed("pdf", "plain").join(pdf.documents(pages, ["doc_id"], compress=True), "doc_id")
    return widened(both.select("doc_id", F.length("plain").alias("plain_bytes"), F.length("pdf").alias("compressed_bytes"), F.regexp_extract(F.decode("plain", "ISO-8859-1"), r"/Count (\d+)", 1).cast("int").alias("pages")))


QUERIES = {f.__name__: f for f in (scan_quality, quality_scores, turned_pictures, ruled_lines, edge_fits, quad_corners, largest_quads, enhanced_pictures, page_corners, model_text_boxes, input_tensors, pdf_files)}
ORACLE_SQL = {
    "scan_quality": SCAN_QUALITY, "quality_scores": QUALITY_SCORES, "turned_pictures": TURNED_PICTURES, "ruled_lines": RULED_LINES, "edge_fits": EDGE_FITS, "quad_corners": QUAD_CORNERS,
    "largest_quads": LARGEST_QUADS, "model_text_boxes": MODEL_TEXT_BOXES,
}
