"""Benchmark decontamination as a prefix-filtered join with exact verification.

Each window of an item must occur whole, so its necessary prefix is a single token: the rarest of its words by the counts
of the whole corpus. Windows are a table keyed by that token. Occurrences of such tokens in documents, with the words
around them, are joined with it by equality; a window's place must then fit between the ends of the document (positional
and length bounds), and all its words are compared. A window with a word that the corpus lacks is left out before.
Bitmaps of fixed size say early which words, and which pairs of a token and its neighbour, can't meet any window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, small_batches, written

WINDOW = 10
#: Slots of a bitmap; each of its pieces is a row on the way to the driver.
SLOTS = 1 << 24
PIECE = 1 << 13
#: Counted words that one task holds at a time.
MOST_COUNTED = 500_000
#: Characters of windows that may be broadcast.
BROADCAST_CHARS = 16_000_000
#: ASCII letters to lower case, other ASCII than letters and digits to blanks; bytes of other characters stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
KEY = ["key", "other", "size"]
FOUND = "key long, other int, size int, at int, word string, before int, around array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Bitmap:
    """Slots of the hashes of some strings: tells for sure what is not among them."""

    def __init__(self, pieces: dict[int, list[int]]) -> None:
        self.bits = np.zeros(SLOTS, bool)
        for piece, slots in pieces.items():
            self.bits[piece * PIECE + np.array(slots, np.int64)] = True
        self.bits = np.packbits(self.bits)

    def __contains__(self, value: bytes) -> bool:
        slot = xxhash.xxh64_intdigest(value, 42) % SLOTS
        return bool(self.bits[slot >> 3] >> (7 - (slot & 7)) & 1)

    def among(self, values: list[bytes]) -> list[bytes]:
        """Those of values that may be in it."""
        digest = xxhash.xxh64_digest
        slots = (np.frombuffer(b"".join([digest(v, 42) for v in values]), ">u8") % SLOTS).astype(np.int64)
        return [values[i] for i in np.flatnonzero(self.bits[slots >> 3] >> (7 - (slots & 7)) & 1).tolist()]


def bitmap(values: DataFrame) -> Broadcast:
    """The bitmap of values (value: string), which takes 2 MB whatever their number."""
    slots = values.select(F.pmod(F.xxhash64("value"), F.lit(SLOTS)).alias("slot"))
    pieces = slots.groupBy(F.expr(f"slot div {PIECE}").alias("piece")).agg(F.collect_set((F.col("slot") % PIECE).cast("int")).alias("slots"))
    return values.sparkSession.sparkContext.broadcast(Bitmap({r.piece: r.slots for r in pieces.collect()}))


def _counts(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted = vocabulary.value, Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counted], pa.string()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])
            counted.clear()
            return out

        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(words_of(text))
            for word in known.among(list(words)):
                counted[word] += words[word]
            if len(counted) > MOST_COUNTED:
                yield told()
        yield told()

    return run


def window_table(items: DataFrame, docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(id, word, place, words) of the distinct windows of items (item_id, text), word being the one at place that is rarest
    in docs (then the least, then the first); and (id, item_id): whose they are. Windows lie within one item's words, which
    are sorted by position, so a long item streams through a task."""
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), APART), "")
    each = items.distinct().select("item_id", F.xxhash64("text").alias("text_key"), words.alias("words"))
    each = written(each.select("item_id", "text_key", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word")), "items")
    vocabulary = each.select("word").distinct()
    counts = docs.select("text").mapInArrow(_counts(bitmap(vocabulary.withColumnRenamed("word", "value"))), "word string, n long").groupBy("word").agg(F.sum("n").alias("seen"))
    rated = each.join(counts, "word", "left")
    ahead = Window.partitionBy("item_id", "text_key").orderBy("pos").rowsBetween(0, window - 1)
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "pos")).over(ahead)
    made = rated.select("item_id", "n", "pos", rarest.alias("rarest"), F.collect_list("word").over(ahead).alias("words"))
    made = made.where((F.col("pos") <= F.col("n") - F.least(F.col("n"), F.lit(window))) & (F.col("rarest.seen") > 0))
    made = written(made.select("item_id", F.md5(F.array_join("words", " ")).alias("id"), F.col("rarest.word").alias("word"), (F.col("rarest.pos") - F.col("pos")).alias("place"), "words"), "windows")
    return made.groupBy("id", "word", "place", "words").agg(F.lit(1).alias("one")).drop("one"), made.select("id", "item_id").distinct()


def neighbour(words: Column, place: Column) -> Column:
    """What the second bitmap holds of a window: its token with the word after it, or before it at the end, or alone."""
    at = lambda i: F.get(words, i)
    return F.when(place + 1 < F.size(words), F.concat_ws(" ", at(place), at(place + 1))).when(place > 0, F.concat(F.lit("<"), at(place - 1), F.lit(" "), at(place))).otherwise(F.concat(F.lit("="), at(place)))


def _occurrences(tokens: Broadcast, pairs: Broadcast, window: int):
    """(key, other, size, text) to the places of tokens that may meet a window, each with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, near = tokens.value, pairs.value
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())]
        names = ["key", "other", "size", "at", "word", "before", "around"]
        for batch in batches:
            rows = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, text in zip(keys, batch.column(3).to_pylist()):
                words = words_of(text)
                wanted = set(known.among(list(set(words))))
                if not wanted:
                    continue
                last = len(words) - 1
                for i in [i for i, w in enumerate(words) if w in wanted]:
                    w = words[i]
                    if (i < last and w + b" " + words[i + 1] in near) or (i and b"<" + words[i - 1] + b" " + w in near) or b"=" + w in near:
                        first = max(0, i - window + 1)
                        rows.append((*key, i, w.decode(), i - first, [x.decode() for x in words[first : i + window]]))
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def text_key() -> list[Column]:
    """What tells texts apart: 96 bits of hashes and the length. Copies of a text are one."""
    return [F.xxhash64("text").alias("key"), F.hash("text").alias("other"), F.length("text").alias("size")]


def occurrences(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(key, other, size, start, length) of the places of windows in texts, and (id, item_id) with (key, other, size, id)."""
    made, owners = window_table(items, docs, window)
    made = written(made.withColumn("near", neighbour(F.col("words"), F.col("place"))), "keyed")
    tokens, pairs = bitmap(made.select(F.col("word").alias("value"))), bitmap(made.select(F.col("near").alias("value")))
    n, chars = made.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0))).first()
    own = made.select("id", "word", "place", "words")
    own = F.broadcast(own) if n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else own
    found = docs.where("length(text) > 0").select(*text_key(), "text").mapInArrow(_occurrences(tokens, pairs, window), FOUND)
    fits = (F.col("before") >= F.col("place")) & (F.size("around") - F.col("before") >= F.size("words") - F.col("place"))
    same = F.slice("around", F.greatest(F.col("before") - F.col("place"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    hits = found.join(own, "word").where(fits & same).select(*KEY, (F.col("at") - F.col("place")).alias("start"), F.size("words").alias("length"), "id")
    return written(hits.distinct(), "hits"), owners


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of docs (text needed): row (struct of its columns), n_words, n_hit, items (array of item ids as
    strings, sorted), contaminated.

    Words: A-Z in lower case, then runs of ASCII letters, digits and other than ASCII characters. A window is ``window``
    successive words of an item, or all of a shorter one. n_hit: words inside any occurrence of a window. Null and
    empty texts have no words and are clean; items without words or id are ignored; items of one id are one item. Texts
    and items of any length are taken whole. Repeated rows are looked up once for each and share their result; empty
    tables give no rows, or only clean ones; extra columns of any name stay inside row. The corpus is read once for the
    counts and once for the join, whatever the size of the benchmark; documents are shuffled only if more texts than
    may be broadcast hold a window.
    """
    small_batches(docs.sparkSession)
    usable = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    hits, owners = occurrences(docs, usable, window)
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*KEY, "start", (F.col("start") + F.col("length")).alias("end")).distinct().withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy(*KEY).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "seen"), F.lit(0))).cast("long").alias("n_hit"))
    ids = hits.select(*KEY, "id").distinct().join(owners, "id").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = written(n_hit.join(ids, KEY).select(*[F.col(k).alias(f"of_{k}") for k in KEY], "n_hit", "items"), "found")
    rows = docs.select(F.struct("*").alias("row"), *text_key(), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.join(broadcast_if_small(found, found.count()), (F.col("key") == F.col("of_key")) & (F.col("other") == F.col("of_other")) & (F.col("size") == F.col("of_size")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items_of.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
