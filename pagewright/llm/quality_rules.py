"""Quality rules whose thresholds come from quantile sketches per language and source. DataFrame functions only.

Fixed cutoffs suit one language or site and not the next. Here each measure has a sketch for each (language, source): how
many documents fall into each logarithmic bucket of a hundredth. Such sketches merge by adding counts, whatever the order or
the partitioning, so reruns agree; a group's sketch is added up map-side, a language's is merged from its groups' and the
overall one from those. A document fails if a measure lies further from its group's quartiles, on the logarithmic scale,
than ``reach`` times their distance. Thresholds are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, written

SYMBOLS = "#*$%&|<>"
#: Buckets of a sketch for each factor of e.
BUCKETS = 100
#: Measure, how many times the distance of the quartiles a document may lie beyond them, and the least distance, in buckets,
#: for groups that are uniform: for shares a factor of 2, which is one occurrence beside none, for lengths of words two buckets.
MEASURES = {"symbols": (2.5, 69), "dup_lines": (1.5, 69), "repeats": (3.5, 69), "chars_per_word": (5.0, 2)}
#: Measures of which too little is no fault.
ONE_SIDED = {"symbols", "dup_lines", "repeats"}
#: A group of so many documents goes half by its own quartiles and half by its language's; and a language likewise.
HALF_WEIGHT = 100
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent
WINDOW = 3
#: Repeated windows of a text up to which positions are looked up one by one; beyond it they are sorted.
FEW_REPEATED = 32


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """row (struct of docs' columns) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows are told apart by 64-bit hashes. Hashes that occur twice are found on a sorted array; the places where they
    occur then come from a search if they are few, else from a sort by hash and place.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    step = docs.select(F.struct("*").alias("row")).select(
        "row", words.alias("words"), lines.alias("lines"), (F.length(text) - count_chars(text, SPACES)).alias("word_chars"), count_chars(text, SYMBOLS).alias("n_symbols")
    )
    n = F.size("words")
    # sequence() runs downwards if there is no window, so that case is set apart
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    step = step.select("row", "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"))
    step = step.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array("hashes")))
    step = step.withColumn("again", F.array_distinct(F.filter("sorted", lambda x, i: F.coalesce(x == F.get("sorted", i + 1), F.lit(False))))).drop("sorted")
    searched = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("again", h), i)), lambda x: x.isNotNull())
    step = step.withColumn("placed", F.when(F.size("again") > FEW_REPEATED, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get("placed", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("placed", k + 1)["h"], F.lit(False))

    step = step.withColumn("at", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(F.filter("placed", twice), lambda x: x["i"]))).when(F.size("again") > 0, searched))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def bucket(x: Column) -> Column:
    return F.floor(F.log(x.cast("double")) * BUCKETS).cast("long")


def buckets_of() -> dict[str, Column]:
    """The bucket of each measure of a row of measured(). Shares have one occurrence added, so that none is a value, too."""

    def share(part: str, whole: str) -> Column:
        return bucket((F.col(part) + 1) / (F.col(whole) + 1))

    return {
        "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "chars_per_word": bucket(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))),
    }


def quartiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, measure, n_<name>, q1_<name>, q3_<name> from a sketch (keys, measure, bucket, n), merged over what is not a key.
    A window holds one sketch, whose size depends on the resolution alone."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(of.orderBy("bucket"))).withColumn("total", F.sum("n").over(of))
    return upto.groupBy(*keys, "measure").agg(
        F.max("total").alias(f"n_{name}"), F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias(f"q1_{name}"), F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias(f"q3_{name}")
    )


def thresholds(rows: DataFrame, scale: float = 1.0, half_weight: int = HALF_WEIGHT) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure>: buckets) for each group of rows (lang, source and the measures' buckets).
    Null languages and sources are groups like others. No rows give no thresholds. scale widens or narrows all of them."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in MEASURES]))
    sketch = written(rows.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n")), "sketches")
    g, la, o = quartiles(sketch, ["lang", "source"], "g"), quartiles(sketch, ["lang"], "l").withColumnsRenamed({"lang": "of_lang", "measure": "of_l"}), quartiles(sketch, [], "o").withColumnRenamed("measure", "of_o")
    joined = g.join(la, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("measure") == F.col("of_l"))).join(F.broadcast(o), F.col("measure") == F.col("of_o"))

    def blended(q: str) -> Column:
        """The group's quartile, drawn to its language's, and that to the overall one, the more the fewer documents there are."""
        of_lang = (F.col("n_l") * F.col(f"{q}_l") + F.lit(half_weight) * F.col(f"{q}_o")) / (F.col("n_l") + half_weight)
        return (F.col("n_g") * F.col(f"{q}_g") + F.lit(half_weight) * of_lang) / (F.col("n_g") + half_weight)

    q1, q3 = blended("q1"), blended("q3")
    by_measure = {i: F.element_at(F.create_map(*[F.lit(v) for m, x in MEASURES.items() for v in (m, float(x[i]))]), F.col("measure")) for i in (0, 1)}
    width = F.greatest(q3 - q1, by_measure[1]) * by_measure[0] * scale
    limits = joined.select("lang", "source", "measure", (q1 - width).alias("low"), (q3 + width).alias("high"))
    return written(limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")]), "thresholds")


def quality_rules(docs: DataFrame, keep: list[str] | None = None, scale: float = 1.0, half_weight: int = HALF_WEIGHT) -> DataFrame:
    """A row per row of docs (text, lang, source needed): row (struct of its columns, or of those in keep), the counts of
    measured(), base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows; null and empty texts have no
    word and fail. kept: not base_failed, and every measure within its group's thresholds, ends included. The sketches take
    what base rules pass, of the whole table; repeated rows count as often as they occur. Texts of any length are counted
    whole. An empty table gives none; extra columns of any name stay inside row.
    """
    kept_columns = docs.columns if keep is None else keep
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    own = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in kept_columns]).alias("row")
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rows = written(measured(docs).select(own, F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *[F.col(c).cast("long").alias(c) for c in counts], failed.alias("base_failed")), "measured")
    rows = rows.select("*", *[x.alias(m) for m, x in buckets_of().items()])
    limits = thresholds(rows.where("not base_failed"), scale, half_weight)
    limits = broadcast_if_small(limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), limits.count())
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"high_{m}"))
        if m not in ONE_SIDED:
            within = within & (F.col(m) >= F.col(f"low_{m}"))
    return rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left").select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept")
    )
