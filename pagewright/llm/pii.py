"""Personal data: patterns, and contextual extraction bootstrapped from what they find.

Addresses, card and phone numbers that the base patterns find are seeds. Tokens that look like identifiers (five
digits or an @) are instances; the words beside them, with the instance's shape, are lexical patterns. A pattern's
confidence is the trust in its instances, or the geometric mean of that in its word's instances of all shapes and that in
the words beside its shape if this is more, times how often its word has an identifier beside it at all (counted over all words of all
documents); an instance is trusted as its patterns are, so trust passes from shape to shape. Spark iterates over this graph, and the
patterns it ends up sure of find further identifiers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_batches, written
from .spans import Span, Taken, in_order, private_spans

KINDS = ["email", "ip", "card", "phone", "context"]
#: Tokens with a digit or an @; matched from their start only, so that a long one costs linear time.
TOKEN = re.compile(r"(?<!\S)[^\s\d@]*+[\d@]\S*+")
MARK = re.compile(r"[\d@]")
#: Identifiers without the punctuation around them.
CORE = re.compile(r"[\w+(](?:\S*\w)?")
CUE = re.compile(r"[^\W\d_]{2,20}[:=#.]?\Z")
ROUNDS = 3
LEAST_SEEDS = 5
LEAST_CONFIDENCE = 0.5
#: Patterns that are broadcast; more of them are joined.
MOST_SHARED = 10_000
MOST_COUNTED = 200_000
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
RESULT_TYPE = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base", pa.string()), ("spans", pa.string())])


def shape(token: str) -> str:
    """Digits as 9, letters as a; runs shortened."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token)))


def looks_like_identifier(token: str) -> bool:
    return 6 <= len(token) <= 64 and ("@" in token[1:-1] or sum(map(str.isdigit, token)) >= 5)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The words to the left and right of a span if they can be cues; at most 40 characters away."""
    before = text[max(0, start - 40) : start].split()
    after = text[end : end + 40].split()
    out = []
    if before and CUE.match(before[-1]):
        out.append("L " + before[-1].lower())
    if after and CUE.match(after[0]):
        out.append("R " + after[0].lower())
    return out


def identifiers(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Spans of tokens that look like identifiers and meet no base span."""
    taken = Taken(base)
    for m in TOKEN.finditer(text) if MARK.search(text) else ():
        core = CORE.search(m[0])
        if core and looks_like_identifier(core[0]):
            span = (m.start() + core.start(), m.start() + core.end())
            if not taken.meets(*span):
                yield span


def tuples(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(pattern, word, instance, is_seed) for each identifier of a text and each cue beside it."""
    base = private_spans(text)
    for start, end, seed in [*((s, e, True) for _, s, e in base), *((*x, False) for x in identifiers(text, base))]:
        instance = text[start:end]
        for word in contexts(text, start, end):
            yield f"{word} {shape(instance)}", word, instance, seed


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the graph, added up as far as a task can hold them."""
    edges: Counter = Counter()

    def told() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in edges.items()]
        edges.clear()
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["pattern", "word", "instance", "seed", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            edges.update(tuples(text))
        if len(edges) > MOST_COUNTED:
            yield told()
    yield told()


def _seen(cues: Broadcast | None):
    """How often each cue occurs; without a set of cues, each word that could be one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        wanted = None if cues is None else cues.value

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["cue", "n"])
            counted.clear()
            return out

        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(text.split())
            for word, n in words.items():
                cue = word.lower()
                if cue in wanted if wanted is not None else CUE.match(word):
                    counted[cue] += n
            if len(counted) > MOST_COUNTED:
                yield told()
        yield told()

    return run


def cue_counts(docs: DataFrame, cues: DataFrame) -> DataFrame:
    """(cue, seen): how often each of cues (cue: distinct) occurs in all documents. A set of at most BROADCAST_ROWS cues
    is broadcast, and only they are counted; beside more of them all words that could be cues are counted and joined."""
    few = cues.count() <= BROADCAST_ROWS
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.cue for r in cues.collect())) if few else None
    counted = docs.where("length(text) > 0").select("text").mapInArrow(_seen(wanted), "cue string, n long").groupBy("cue").agg(F.sum("n").alias("seen"))
    return counted if few else counted.join(cues, "cue", "left_semi")


def learn_patterns(docs: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(pattern, confidence) of the patterns that the graph of all documents makes sure.

    A pattern needs least_seeds different instances that are seeds or trusted. All sums are formed before they are shuffled; instances stay in the graph
    by their hash. Null and empty texts tell nothing; repeated rows count as often as they occur, but an instance is one.
    """
    small_batches(docs.sparkSession)
    edges = docs.where("length(text) > 0").select("text").mapInArrow(_graph, "pattern string, word string, instance string, seed boolean, n long")
    edges = edges.groupBy("pattern", "word", F.xxhash64("instance").alias("instance")).agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    edges = written(edges, "edges")
    # a cue's own occurrences give the share that has an identifier beside it
    beside = written(edges.groupBy("word").agg(F.sum("n").alias("beside")).withColumn("cue", F.substring_index("word", " ", -1)), "beside")
    seen = cue_counts(docs, beside.select("cue").distinct())
    share = beside.join(seen, "cue", "left").select("word", F.least(F.lit(1.0), F.col("beside") / F.coalesce("seen", "beside")).alias("share"))
    rated = written(edges.join(share, "word"), "rated")
    trust = rated.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    seeds = trust.where("trust = 1").select("instance")
    for _ in range(rounds):
        sums = rated.join(trust, "instance").groupBy("pattern", "word").agg(
            F.sum("trust").alias("sum"), F.count("*").alias("n"), F.max("share").alias("share"), F.count_if(F.col("trust") >= least_confidence).alias("seeds")
        )
        sums = written(sums.withColumn("shape", F.expr("substring(pattern, length(word) + 2)")), "sums")
        both = sums.join(sums.groupBy("word").agg((F.sum("sum") / F.sum("n")).alias("of_word")), "word")
        by_shape = both.groupBy("shape").agg((F.sum(F.col("of_word") * F.col("n")) / F.sum("n")).alias("of_shape"))
        confidence = F.greatest(F.col("sum") / F.col("n"), F.sqrt(F.col("of_word") * F.col("of_shape"))) * F.col("share")
        patterns = written(both.join(by_shape, "shape").select("pattern", confidence.alias("confidence"), "seeds"), "patterns")
        trust = rated.join(patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("trust"))
        trust = written(trust.join(seeds.withColumn("seed", F.lit(1.0)), "instance", "left").select("instance", F.coalesce("seed", "trust").alias("trust")), "trust")
    return patterns.where((F.col("seeds") >= least_seeds) & (F.col("confidence") >= least_confidence)).select("pattern", "confidence")


def extract(text: str | None, patterns: Collection[str]) -> dict:
    text = text or ""
    base = private_spans(text)
    more: list[Span] = []
    if patterns:
        for start, end in identifiers(text, base):
            if any(f"{word} {shape(text[start:end])}" in patterns for word in contexts(text, start, end)):
                more.append(("context", start, end))
    out = {f"n_{kind}": sum(k == kind for k, _, _ in base) for kind in KINDS[:4]}
    return out | {"base": in_order(base, KINDS), "spans": in_order(base + more, KINDS)}


def _extract(patterns: Broadcast):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = patterns.value
        for batch in texts:
            yield pa.array([extract(t, known) for t in batch.to_pylist()], RESULT_TYPE)

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to the patterns that stand beside identifiers of the text."""
    for batch in batches:
        found = [(i, p) for i, text in zip(*(batch.column(c).to_pylist() for c in (0, 1))) for p in sorted({p for p, _, _, seed in tuples(text or "") if not seed})]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["id", "pattern"])


def _extract_own(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, patterns in columns:
        yield pa.array([extract(t, frozenset(own or ())) for t, own in zip(texts.to_pylist(), patterns.to_pylist())], RESULT_TYPE)


def find_private(docs: DataFrame, patterns: DataFrame | None = None, most_shared: int = MOST_SHARED) -> DataFrame:
    """A row per row of docs (text needed): row (struct of its columns), found (struct of the counts, base and spans:
    kind:start:end, comma-joined). Base spans stay; a span of kind context is added where a sure pattern stands beside
    an identifier that no base span meets. Null and empty texts have no spans; texts are read whole in linear time at any
    length; repeated rows each get their spans, an empty table none, and extra columns of any name stay inside row.
    patterns: as from learn_patterns(), by default learnt from docs; at most most_shared are broadcast, more are joined
    with those that the texts hold. Spans that start at one place are listed in the order of KINDS.
    """
    small_batches(docs.sparkSession)
    known = written((learn_patterns(docs) if patterns is None else patterns).select("pattern").distinct(), "known")
    if known.count() <= most_shared:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r.pattern for r in known.collect()))
        return docs.select(F.struct("*").alias("row"), F.arrow_udf(_extract(shared), RESULT)(F.col("text")).alias("found"))
    keyed = written(docs.select(F.struct("*").alias("row"), F.expr("uuid()").alias("id")), "keyed")
    held = keyed.select("id", "row.text").mapInArrow(_candidates, "id string, pattern string")
    own = held.join(known, "pattern").groupBy("id").agg(F.collect_list("pattern").alias("own"))
    return keyed.join(own, "id", "left").select("row", F.arrow_udf(_extract_own, RESULT)(F.col("row.text"), F.col("own")).alias("found"))
