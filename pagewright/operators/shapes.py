"""Corners, quads and curves of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance

PHOTO_AREA, FRAME_AREA = 0.15, 0.10
INSET = 0.08
TOUCH = 60.0
LEAST_POINTS = 10


def area(points: Column) -> Column:
    """Area of a polygon given as an array of points (x, y)."""
    nxt = lambda i: F.get(points, ((i + 1) % F.size(points)).cast("int"))
    parts = F.transform(points, lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2.0


def ordered_corners(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left. The first point of least x + y or y - x counts, the last of greatest."""
    ranked = lambda f, sign: F.array_sort(F.transform(points, lambda p, i: F.struct((f(p) * sign).alias("k"), (i * sign).alias("i"), p.alias("p"))))
    add, sub = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(*[F.get(ranked(f, s), F.lit(0))["p"] for f, s in ((add, 1), (sub, 1), (add, -1), (sub, -1))])


def largest_quad(contours: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """The contour of four corners with the greatest area (area, vertices, ord, points, image_area), the first of equals;
    contours under a share of the image don't count."""
    fit = contours.where((F.col("vertices") == 4) & (F.col("area") >= F.col("image_area") * least))
    return fit.groupBy(*keys).agg(F.max_by(F.struct("ord", "area", "points"), F.struct("area", (-F.col("ord")).alias("first"))).alias("best")).select(*keys, "best.*")


def inset_quad(w: Column, h: Column) -> Column:
    """The corners that stand in for a quad that wasn't found."""
    x, y = (w.cast("double") * INSET), (h.cast("double") * INSET)
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (w - x, y), (w - x, h - y), (x, h - y))])


def fit_centre(view_w: Column, view_h: Column, w: Column, h: Column) -> dict[str, Column]:
    """Scale and offset of a picture that is shown whole and centred in a view."""
    scale = F.least(view_w / w, view_h / h)
    return {"scale": scale, "left": (view_w - w * scale) / 2.0, "top": (view_h - h * scale) / 2.0}


def touched_corner(corners: Column, x: Column, y: Column) -> Column:
    """Number of the first corner within 60 pixels, else -1."""
    near = F.transform(corners, lambda p: distance(p["x"], p["y"], x, y) < TOUCH)
    return (F.coalesce(F.array_position(near, True), F.lit(0)) - 1).cast("int")


def warp_size(c: Column) -> dict[str, Column]:
    """Width and height of a quad's flat picture: the longer of opposite sides."""
    d = lambda i, j: distance(c[i]["x"], c[i]["y"], c[j]["x"], c[j]["y"])
    return {"out_w": F.greatest(d(0, 1), d(3, 2)), "out_h": F.greatest(d(0, 3), d(1, 2))}


def edge_curves(points: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys, x, top_y, bottom_y: a contour's least and greatest y in each column; x is held to the picture."""
    x = F.least(F.greatest(F.col("x").cast("int"), F.lit(0)), F.lit(width - 1))
    return points.select(*keys, x.alias("x"), "y").groupBy(*keys, "x").agg(F.min("y").alias("top_y"), F.max("y").alias("bottom_y"))


def quadratic_fit(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, a, b, c: least squares by power sums and Cramer's rule; null with fewer than ten points or a singular system."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    sums = points.where(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").cast("double").alias("s0"), F.sum(vx).alias("s1"), F.sum(vx * vx).alias("s2"), F.sum(vx * vx * vx).alias("s3"), F.sum(vx * vx * vx * vx).alias("s4"),
        F.sum(vy).alias("t0"), F.sum(vx * vy).alias("t1"), F.sum(vx * vx * vy).alias("t2"),
    )
    s = {n: F.col(n) for n in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    base = [[s["s4"], s["s3"], s["s2"]], [s["s3"], s["s2"], s["s1"]], [s["s2"], s["s1"], s["s0"]]]
    right = [s["t2"], s["t1"], s["t0"]]
    whole = det(base)
    fits = (s["s0"] >= LEAST_POINTS) & (F.abs(whole) > 1e-9)
    solved = [F.when(fits, det([[right[r] if k == j else base[r][k] for k in range(3)] for r in range(3)]) / whole).alias(n) for j, n in enumerate("abc")]
    return sums.select(*keys, *solved)


def dewarp_map(top: DataFrame, bottom: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """keys, x, offset, slope: an output pixel (x, y) of a flattened page reads the source at offset + slope * y. top and
    bottom are the fitted edges; pages without both fits have no rows, and stay as they are."""
    curves = top.where("a is not null").select(*keys, *[F.col(n).alias(f"t{n}") for n in "abc"]).join(bottom.where("a is not null").select(*keys, *[F.col(n).alias(f"b{n}") for n in "abc"]), [*keys])
    xs = F.sequence(F.lit(0), F.lit(width - 1))
    at = lambda e, x: F.col(f"{e}a") * x * x + F.col(f"{e}b") * x + F.col(f"{e}c")
    limits = curves.withColumns({"_t": F.array_min(F.transform(xs, lambda x: at("t", x))), "_b": F.array_max(F.transform(xs, lambda x: at("b", x)))})
    each = limits.withColumn("x", F.explode(xs))
    span, target = F.greatest(at("b", F.col("x")) - at("t", F.col("x")), F.lit(1.0)), F.greatest(F.col("_b") - F.col("_t"), F.lit(1.0))
    slope = span / target
    return each.select(*keys, "x", (at("t", F.col("x")) - F.col("_t") * slope).alias("offset"), slope.alias("slope"))
