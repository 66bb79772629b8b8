"""Language identification by compression.

Each language has a raw-content Zstandard dictionary of its own text. A text is cut into pieces, each piece is compressed
with each dictionary, and the language whose dictionary makes it smallest wins. If the next one is nearly as small,
the result is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A language's dictionary has so many excerpts of so many characters; this bounds what reaches the driver.
EXCERPTS = 96
EXCERPT_CHARS = 1_000
#: Below 6 the matches that Zstandard finds in a dictionary are too poor to tell close languages apart.
LEVEL = 6
#: Bytes compressed at a time: a piece is short beside the dictionary, so the dictionary decides at any length.
PIECE = 2_048
MIN_MARGIN = 0.01
LETTER = re.compile(r"[^\W\d_]")
RESULT = "lang_pred string, score double, rejected boolean"
RESULT_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def excerpts(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language among the labelled rows that are not held out.

    Rows are dealt to EXCERPTS slots per language by a hash of their id, and each slot keeps the row of least hash: a
    sum that is formed before the shuffle, whatever share of the rows a language has. An excerpt starts at a place in
    the text that the hash names.
    """
    mark = F.xxhash64(F.lit("langid"), "doc_id", F.xxhash64("text"))
    room = F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(0)) + 1
    rows = (
        docs.where("lang is not null and length(text) > 0").where(~held_out(F.col("doc_id")))
        .select("lang", F.pmod(mark, F.lit(EXCERPTS)).alias("slot"), mark.alias("mark"), F.substring("text", F.pmod(F.shiftrightunsigned(mark, 8), room).cast("int") + 1, EXCERPT_CHARS).alias("excerpt"))
    )
    picked = rows.groupBy("lang", "slot").agg(F.min(F.struct("mark", "excerpt")).alias("x")).select("lang", "slot", "x.excerpt").collect()
    out: dict[str, bytes] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.slot)):
        out[r.lang] = out.get(r.lang, b"") + r.excerpt.lower().encode() + b"\n"
    return out


def compressors(contents: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang in sorted(contents):
        d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def predict(text: str | None, models: list[tuple[str, zstandard.ZstdCompressor]]) -> dict:
    if not text or not models or not (LETTER.search(text) and any(map(str.isalpha, text))):
        return {"lang_pred": "und", "score": 0.0, "rejected": True}
    data = text.lower().encode()
    sizes = [0] * len(models)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        for i, (_, model) in enumerate(models):
            sizes[i] += len(model.compress(piece))
    best = min(range(len(models)), key=sizes.__getitem__)
    if len(models) == 1:
        return {"lang_pred": models[0][0], "score": 1.0, "rejected": False}
    second = min(s for i, s in enumerate(sizes) if i != best)
    margin = 1 - sizes[best] / second
    return {"lang_pred": models[best][0], "score": margin / (margin + MIN_MARGIN), "rejected": margin < MIN_MARGIN}


def _predict(contents: Broadcast):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        models = compressors(contents.value)
        for batch in texts:
            yield pa.array([predict(t, models) for t in batch.to_pylist()], RESULT_TYPE)

    return run


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """A row per row of docs (text needed): row (struct of its columns), found (lang_pred, score, rejected).

    Learns from learn_from (doc_id, text, lang; by default docs), without held-out ids and null languages. score is the
    margin m of the smallest size over the next as m / (m + MIN_MARGIN), so 0.5 is the point of rejection; a rejected
    row keeps its best guess. Null texts and texts without a letter are und, with score 0; so is everything if there is
    nothing to learn from. Ties go to the first language by name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(excerpts(docs if learn_from is None else learn_from))
    return docs.select(F.struct("*").alias("row"), F.arrow_udf(_predict(shared), RESULT)(F.col("text")).alias("found"))
