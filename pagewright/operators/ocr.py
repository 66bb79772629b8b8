"""Line-based recognition around its models: text boxes, reading flow, words of lines, paragraphs, greedy decoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_up
from ..functions.text import blank, in_order, words
from .tables import argmax

LINE_BUCKET, PARAGRAPH_GAP = 20, 0.6
MIN_SIDE, MIN_SCORE, UNCLIP = 4, 0.6, 1.5


def text_boxes(boxes: DataFrame) -> DataFrame:
    """Final boxes of raw ones (x, y, w, h, score; resized_w, resized_h, orig_w, orig_h): small and unsure ones go, the rest
    grows by area * 1.5 / perimeter on each side, is held to the input, scaled back and rounded half up."""
    area, around = (F.col("w") * F.col("h")).cast("double"), 2.0 * (F.col("w") + F.col("h"))
    offset = F.when(around > 0, area * UNCLIP / around).otherwise(0.0)
    sx, sy = F.col("resized_w").cast("double") / F.col("orig_w"), F.col("resized_h").cast("double") / F.col("orig_h")
    grown = boxes.where((F.col("w") >= MIN_SIDE) & (F.col("h") >= MIN_SIDE) & (F.col("score") >= MIN_SCORE)).withColumns({
        "left": half_up(F.greatest(F.col("x") - offset, F.lit(0.0)) / sx).cast("int"),
        "top": half_up(F.greatest(F.col("y") - offset, F.lit(0.0)) / sy).cast("int"),
        "right": F.least(half_up(F.least(F.col("x") + F.col("w") + offset, F.col("resized_w").cast("double")) / sx), F.col("orig_w")).cast("int"),
        "bottom": F.least(half_up(F.least(F.col("y") + F.col("h") + offset, F.col("resized_h").cast("double")) / sy), F.col("orig_h")).cast("int"),
    })
    return grown.where("right > left and bottom > top")


def line_order(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds line_no in reading flow: by 20-pixel buckets of the top, then by left. Blank lines go first."""
    flow = Window.partitionBy(*keys).orderBy(F.expr(f"top div {LINE_BUCKET}"), "left", *order)
    return lines.where(~blank(F.col("text"))).withColumn("line_no", (F.row_number().over(flow) - 1).cast("int"))


def _edges(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Left and right edges of the words of each line (lengths, left, right). The running edge is a 32-bit float that is
    rounded at every word, which a window sum of doubles would not give."""
    for lengths, lefts, rights in columns:
        out = []
        for n, left, right in zip(lengths.to_pylist(), lefts.to_pylist(), rights.to_pylist()):
            size = np.array(n, np.float32)
            widths = np.float32(right - left) * (size / np.float32(max(1, sum(n))))
            out.append(np.cumsum(np.concatenate([[np.float32(left)], widths]), dtype=np.float32).astype(np.int64))
        yield pa.array(out, pa.list_(pa.int64()))


def word_boxes(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, line_no, word_no, text, left, top, right, bottom, confidence (0): each word gets a share of its line's box by
    its length."""
    ws = lines.withColumn("_w", words(F.col("text")))
    edges = F.arrow_udf(_edges, "array<long>")(F.transform("_w", lambda w: F.length(w)), F.col("left"), F.col("right"))
    made = ws.select(*keys, "line_no", "top", "bottom", "_w", edges.alias("_e"))
    each = made.select(*keys, "line_no", "top", "bottom", "_e", F.posexplode("_w").alias("word_no", "text"))
    edge = lambda i: F.get("_e", i).cast("int")
    return each.select(*keys, "line_no", "word_no", "text", edge(F.col("word_no")).alias("left"), "top", edge(F.col("word_no") + 1).alias("right"), "bottom", F.lit(0.0).cast("float").alias("confidence"))


def numbered_paragraphs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds par_no to lines in order of line_no: a gap to the line before of over 0.6 of that line's height begins a new one."""
    flow = Window.partitionBy(*keys).orderBy("line_no")
    height = F.greatest(F.lit(1), F.lag("bottom").over(flow) - F.lag("top").over(flow))
    new = F.when(F.col("top") - F.lag("bottom").over(flow) > height * PARAGRAPH_GAP, 1).otherwise(0)
    return lines.withColumn("_new", new).withColumn("par_no", F.sum("_new").over(flow.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def paragraphs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, par_no, text."""
    return numbered_paragraphs(lines, keys).groupBy(*keys, "par_no").agg(in_order(("line_no",), "text", " ").alias("text"))


def greedy_text(steps: DataFrame, keys: Sequence[str], vocabulary: Sequence[str]) -> DataFrame:
    """keys, text of steps (keys, step, logits): the most likely index of each step, without blanks (0), repeats of the step
    before and indices beyond the vocabulary. Every sequence has a row, if only with an empty text."""
    flow = Window.partitionBy(*keys).orderBy("step")
    best = steps.select(*keys, "step", argmax(F.col("logits")).alias("idx")).withColumn("_last", F.lag("idx", 1, -1).over(flow))
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    said = F.when((F.col("idx") != 0) & (F.col("idx") != F.col("_last")), F.get(vocab, F.col("idx")))
    return best.withColumn("_said", said).groupBy(*keys).agg(in_order(("step",), "_said", "").alias("text"))


def line_page(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, full_text, n_words, paragraphs: a page of recognised lines (text, box) put together."""
    numbered = numbered_paragraphs(line_order(lines, keys, order), keys)
    pars = numbered.groupBy(*keys, "par_no").agg(in_order(("line_no",), "text", " ").alias("text"), in_order(("line_no",), "text", "\n").alias("_lines"), F.sum(F.size(words(F.col("text")))).alias("_n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("par_no", "text"))), lambda x: x["text"])
    return pars.groupBy(*keys).agg(in_order(("par_no",), "_lines", "\n").alias("full_text"), F.sum("_n").alias("n_words"), texts.alias("paragraphs"))


def recogniser_vocabulary(lines: Sequence[str]) -> list[str]:
    """Blank first, then a dictionary's lines without line ends and empty ones."""
    return ["", *[t for t in (x.rstrip("\r\n") for x in lines) if t]]
