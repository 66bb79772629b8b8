"""Mixing sources to target weights with hash-random order, distributed prefix sums and exact cuts.

The key of a row is the MD5 of a seed and its doc_id, so the order is random and the same in every run. The key
space is cut into 4,096 ranges; sums per source and range (added up before the shuffle) give each range's prefix,
which finds the one range of a source in which its budget ends. Only that range is sorted row by row. No task ever
sees more of a source than one range, and no window runs over a whole source's rows. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, words_in, written

RANGE_DIGITS = 3  # hexadecimal digits of the key that name its range


def row_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most_epochs: int) -> DataFrame:
    """(source, source_size, target) for (source, source_size): sources by code point, null last, weigh ``weights`` in
    turn and share ``share`` of all sizes; a target stops at most_epochs times its source's size and the excess goes to
    the others by weight. As all that are not stopped hold the same target per weight, sources sorted by size per
    weight stop in that order, which running sums settle in one pass. The windows run over one row per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("stop", "place")
    ahead = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    placed = (
        sources.withColumn("place", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * float(most_epochs))
        .withColumn("stop", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * float(share))
    )
    level = (F.col("budget") - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(behind)
    levelled = placed.withColumn("level", level)
    lowest = F.min(F.when(F.col("level") < F.col("stop"), F.struct("stop", "place", "level"))).over(every)
    return levelled.withColumn("level", lowest["level"]).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level"))).alias("target")
    )


def plan_cuts(keyed: DataFrame, weights: Sequence[float], share: float, most_epochs: int) -> DataFrame:
    """One row per source of keyed (source, size, key): source, source_size, target, epochs (whole passes), cut_key,
    cut_words and cut_size. Rows before cut_key are taken once more than ``epochs``, those after it not; those at
    it share cut_words of their cut_size."""
    ranges = written(
        keyed.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("range_size")), "ranges"
    )
    of_source = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    budgets = targets(of_source, weights, share, most_epochs).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    budgets = written(budgets.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "budgets")
    n = budgets.count()
    small = broadcast_if_small(budgets.select(F.col("source").alias("s"), "rest"), n)
    upto = F.sum("range_size").over(Window.partitionBy("source").orderBy("range"))
    cut_ranges = (
        ranges.withColumn("upto", upto)
        .join(small, F.col("source").eqNullSafe(F.col("s")))
        .where("upto > rest and upto - range_size <= rest and range_size > 0")
        .select(F.col("s"), F.col("range").alias("cut_range"), F.expr("rest - (upto - range_size)").alias("left"))
    )
    inside = (
        keyed.join(broadcast_if_small(cut_ranges, n), F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, RANGE_DIGITS) == F.col("cut_range")))
        .groupBy("source", "key", "left")
        .agg(F.sum("size").alias("cut_size"))
    )
    upto = F.sum("cut_size").over(Window.partitionBy("source").orderBy("key"))
    cuts = (
        inside.withColumn("upto", upto)
        .where("upto > left and upto - cut_size <= left and cut_size > 0")
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.expr("left - (upto - cut_size)").alias("cut_words"), "cut_size")
    )
    return written(budgets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest"), "cuts")


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most_epochs: int = 2, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text, source needed): row (struct of its columns, or of those in keep), size, source_size, target, taken.

    size: words of the text, none for null. A source's rows are taken whole for target // source_size epochs and then
    in the order of their keys until the rest of the budget is used up; the row at the cut gives the words that are
    left. Rows of one doc_id share a key; at the cut they give the same part of their words, so that each differs
    from its exact part by less than a word. Null sources form one source; a source without words has target 0.
    """
    whole = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), docs["source"].alias("source"), words_in(docs["text"]).alias("size"), row_key(docs["doc_id"], seed).alias("key"))
    if keep is None:
        keyed = written(whole.drop("row"), "keyed")
    else:
        whole = keyed = written(whole, "keyed")
    cuts = plan_cuts(keyed, weights, share, most_epochs)
    small = broadcast_if_small(cuts.withColumnRenamed("source", "s"), cuts.count())
    more = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.floor(F.col("size") * F.col("cut_words") / F.col("cut_size")))
        .otherwise(F.lit(0))
    )
    return whole.join(small, F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long").alias("taken")
    )


def epochs(mixed: DataFrame) -> DataFrame:
    """The mix as rows to read: a row of mix() once for each epoch that takes words of it, as its own columns with
    mix_epoch (from 0) and mix_words (words to read in this epoch: all, or what is left at the cut)."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    each = mixed.where("taken > 0").select("row", "size", "taken", F.explode(F.sequence(F.lit(0), times - 1)).alias("mix_epoch"))
    names = [c for c in mixed.schema["row"].dataType.names if c not in ("mix_epoch", "mix_words")]
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "mix_epoch", F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("mix_epoch")).alias("mix_words"))
