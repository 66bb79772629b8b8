"""Language-model scores of documents: a causal self-attention model (attention.py) and a smoothed unigram base.

All counts cover every training document: words by one distributed count, subword ids by encoding each distinct word once.
They give the base its probabilities and the model its vocabulary, biases and the shares of rare ids. The model's other
weights are trained where the data are, on the windows of every training document: each task runs Adam over its share of
them and the tasks' weights are averaged, round after round. Scoring reads each text once; words repeat, so their ids are looked up and not encoded again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .attention import HEAD, TAIL, Scorer, Weights
from .chat import default_path, tokenizer
from .common import small_batches, written

END = b""  # no word is empty
VOCABULARY = 50_257
END_ID = VOCABULARY - 1
#: Frequent words whose counts go to all executors; the counts of other words are joined.
MOST_SHARED = 200_000
MOST_COUNTED = 400_000
MOST_KEPT = 400_000
#: A task trains on about so many subword ids in a round.
TASK_TOKENS = 1_000_000
RATES = (0.01, 0.007, 0.005, 0.003)
SUMMERS = 8
WORDS_AT_ONCE = 1 << 15
LOG10 = 1 / math.log(10)
TUNED = "task int, n long, w binary"
#: Steps of counts for each factor of e, by which a bound for frequent words is found.
STEPS = 16
SCORED = "doc_id {}, n_tokens long, n_known long, base_score double, score double, rare array<binary>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted: Counter = Counter()

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])
        counted.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counted.update(words_of(text))
            counted[END] += 1
        if len(counted) > MOST_COUNTED:
            yield told()
    yield told()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each word occurs in all rows of docs; the end of a text is the empty word."""
    return written(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


class Encoder:
    """Subword ids of many words at a time. Words hold no blanks, and every blank begins an id, so words that are encoded
    together with a blank before each can be told apart again."""

    def __init__(self, path: str) -> None:
        self.encoder = tokenizer(path)
        self.first = np.array([self.encoder.decode_single_token_bytes(i)[:1] == b" " for i in range(END_ID)] + [False])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        ids = np.array(self.encoder.encode_ordinary((b" " + b" ".join(words)).decode()), np.int64) if words else np.empty(0, np.int64)
        starts = np.flatnonzero(self.first[ids])
        if len(starts) == len(words):
            return ids, np.diff(np.append(starts, len(ids)))
        each = [self.encoder.encode_ordinary(" " + w.decode()) for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array(list(map(len, each)))


def _count_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = Encoder(path), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            rows = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            counts[END_ID] += rows.pop(END, 0)
            ids, sizes = encode(list(rows))
            counts += np.bincount(ids, np.repeat(np.array(list(rows.values()), np.float64), sizes), VOCABULARY).astype(np.int64)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["id", "n"])

    return run


def id_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often each subword id occurs; at most VOCABULARY numbers reach the driver."""
    rows = words.mapInArrow(_count_ids(path), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(VOCABULARY, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def code_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input code of each id, log-probability of each id within the tail). The most frequent ids are the head; the end is one of them."""
    order = np.lexsort((np.arange(VOCABULARY), -counts))
    order = np.concatenate([[END_ID], order[order != END_ID]])[:HEAD]
    codes = np.full(VOCABULARY, TAIL, np.int32)
    codes[order] = np.arange(len(order))
    tail = np.where(codes == TAIL, counts + 1.0, 0.0)
    with np.errstate(divide="ignore"):
        return codes, np.log(tail / tail.sum())


def _codes(path: str, code_of: Broadcast):
    """Texts to their codes, two bytes each."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(path, code_of.value, np.zeros(VOCABULARY), {}, 0.0)

        def told(texts: list[np.ndarray]) -> list[bytes]:
            lexicon.update()
            return [lexicon.codes_of(words)[0].astype(np.int16).tobytes() for words in texts]

        for batch in texts:
            out, held, waiting = [], [], 0
            for text in batch.to_pylist():
                words = words_of(text)
                words.append(END)
                held.append(np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words)))
                waiting += len(words)
                if waiting >= WORDS_AT_ONCE:
                    out += told(held)
                    held, waiting = [], 0
                    if len(lexicon) > MOST_KEPT:
                        lexicon.empty()
            yield pa.array(out + told(held), pa.binary())

    return run


def _train(weights: Broadcast, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = attention.unflat(weights.value.copy()), 0
        for batch in batches:  # a batch is bounded, so a partition of any size streams through
            x, t, _ = attention.windows([np.frombuffer(c, np.int16).astype(np.int32) for c in batch.column(0).to_pylist()])
            if len(x):
                w = attention.train(w, x, t, rate, seed)
                n += int((t >= 0).sum())
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([(attention.flat(w) * np.float32(n)).tobytes()], pa.binary())], ["task", "n", "w"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights in order of their tasks, so that reruns give the same digits."""
    total, n, first = None, 0, None
    for batch in batches:
        for task, k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            part = np.frombuffer(raw.as_buffer(), np.float32)
            total, first = (part.astype(np.float64), task) if total is None else (total + part, first)
            n += k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "n", "w"])


def train_model(docs: DataFrame, counts: np.ndarray, path: str, rates: tuple[float, ...] = RATES) -> Weights:
    """Weights trained on all rows of docs. Each round takes its own part of them, by hash, so every window is learnt from once.

    Averages are formed in SUMMERS tasks, which stream through the tasks' weights, so the driver gets a fixed amount.
    """
    spark = docs.sparkSession
    codes, _ = code_table(counts)
    by_code = np.bincount(codes, counts, minlength=HEAD + 1)
    now = attention.flat(attention.first_weights(by_code[:HEAD], by_code[TAIL]))
    n_tasks = max(1, round(int(counts.sum()) / len(rates) / TASK_TOKENS))
    mark = F.xxhash64(F.lit("lm"), "doc_id", F.xxhash64("text"))
    marked = docs.where("length(text) > 0").select("text", mark.alias("mark"))
    encoded = F.arrow_udf(_codes(path, spark.sparkContext.broadcast(codes)), "binary")(F.col("text"))
    for r, rate in enumerate(rates):
        shared = spark.sparkContext.broadcast(now)
        part = marked.where(F.pmod(F.xxhash64("mark"), F.lit(len(rates))) == r).select("mark", encoded.alias("codes"))
        tuned = part.repartition(n_tasks, "mark").sortWithinPartitions("mark").select("codes").mapInArrow(_train(shared, rate, r), TUNED)
        sums = sorted(tuned.repartition(SUMMERS, "task").sortWithinPartitions("task").mapInArrow(_sum, TUNED).collect(), key=lambda s: s.task)
        if sums:
            now = (sum(np.frombuffer(s.w, np.float64) for s in sums) / sum(s.n for s in sums)).astype(np.float32)
    return attention.unflat(now)


class Lexicon(dict):
    """Numbers of words, and by number what scoring needs of each word, in arrays; END is number 0. New words only get their
    number at first, the rest follows for many of them at a time. It is emptied when it grows too large."""

    def __init__(self, path: str, code_of: np.ndarray, tail: np.ndarray, log10: dict[bytes, float], unseen: float) -> None:
        self.encode, self.code_of, self.log10, self.unseen = Encoder(path), code_of, log10, unseen
        self.tail = np.where(np.isfinite(tail), tail, 0.0)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.words: list[bytes] = []
        self.base, self.known, self.rest = np.empty(0), np.empty(0, bool), np.empty(0)
        self.start, self.codes = np.zeros(1, np.int64), np.empty(0, np.int32)
        self[END]  # noqa: B018

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def update(self) -> None:
        new = self.words[len(self.base) :]
        if not new:
            return
        ids, sizes = self.encode(new[1:] if new[0] == END else new)
        if new[0] == END:
            ids, sizes = np.concatenate([[END_ID], ids]), np.concatenate([[1], sizes])
        found = [self.log10.get(w) for w in new]
        ends = np.cumsum(sizes)
        self.known = np.concatenate([self.known, np.array([p is not None for p in found])])
        self.base = np.concatenate([self.base, np.array([self.unseen if p is None else p for p in found])])
        self.rest = np.concatenate([self.rest, np.add.reduceat(self.tail[ids], ends - sizes)])
        self.codes = np.concatenate([self.codes, self.code_of[ids].astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + ends])

    def codes_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words one after another, and how many each word has."""
        first = self.start[words]
        sizes = self.start[words + 1] - first
        ends = np.cumsum(sizes)
        return self.codes[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])], sizes


def _score(path: str, model: Broadcast, known: Broadcast, unseen: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, code_of, tail = model.value
        scorer = Scorer(weights)
        lexicon = Lexicon(path, code_of, tail, known.value, unseen)

        def scored(texts: list[np.ndarray]) -> tuple:
            """tokens, known, base, score by text, and the words without a known count with the number of their text."""
            lexicon.update()
            words, sizes = np.concatenate(texts), np.array(list(map(len, texts)))
            first = np.cumsum(sizes) - sizes
            codes, per_word = lexicon.codes_of(words)
            ends = np.cumsum(np.add.reduceat(per_word, first))
            x, t, own = attention.windows(np.split(codes, ends[:-1]))
            score = np.bincount(own, scorer.log_probs(x, t).sum(1, dtype=np.float64), minlength=len(texts))
            is_known = lexicon.known[words]
            rare = words[~is_known]
            owners = np.repeat(np.arange(len(texts)), sizes)[~is_known]
            found = (sizes, np.add.reduceat(is_known, first, dtype=np.int64), np.add.reduceat(lexicon.base[words], first), (score + np.add.reduceat(lexicon.rest[words], first)) * LOG10)
            return *found, [lexicon.words[i] for i in rare.tolist()], np.bincount(owners, minlength=len(texts))

        for batch in batches:
            parts, held, waiting = [], [], 0
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                words.append(END)
                held.append(np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words)))
                waiting += len(words)
                if waiting >= WORDS_AT_ONCE:
                    parts.append(scored(held))
                    held, waiting = [], 0
                    if len(lexicon) > MOST_KEPT:
                        lexicon.empty()
            if held:
                parts.append(scored(held))
            if parts:
                tokens, in_base, base, score, _, n_rare = (np.concatenate(p) if not isinstance(p[0], list) else None for p in zip(*parts))
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.array([w for p in parts for w in p[4]], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in (tokens, in_base, base, score)), rare], ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def least_shared(words: DataFrame, most: int) -> int:
    """The step from which on there are at most ``most`` words. Words are counted by the logarithm of their count, in STEPS
    steps for each factor of e, so at most 700 numbers reach the driver."""
    step = F.floor(F.log("n") * STEPS)
    steps = sorted(((r.step, r.k) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, steps[0][0] + 1 if steps else 1
    for at, k in steps:
        total += k
        if total > most:
            break
        least = at
    return least


def score_documents(docs: DataFrame, path: str | None = None, rates: tuple[float, ...] = RATES, most_shared: int = MOST_SHARED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text needed).

    Rows with crc32(doc_id) mod 7 = 2 are held out; all others are learnt from, repeated rows as often as they occur. A
    null or empty text has one token, its end; a text of any length is scored whole, in windows; an empty table gives
    none, and other columns are not read. base_score: add-one unigram over words; score: the model's log10 probability of the words' subword ids and the
    end. Counts of at most most_shared frequent words are broadcast; those of further words are joined by word. Without
    training rows every probability of the base is 1 and the model is untrained.
    """
    small_batches(docs.sparkSession)
    spark, path = docs.sparkSession, path or default_path()
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id")))
    words = word_counts(training)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    denominator = total + distinct + 1
    frequent = words.where(F.floor(F.log("n") * STEPS) >= least_shared(words, most_shared)).collect()
    known = {bytes(r.word): math.log10((r.n + 1) / denominator) for r in frequent}
    counts = id_counts(words, path)
    weights = train_model(training, counts, path, rates)
    codes, tail = code_table(counts)
    model = spark.sparkContext.broadcast((weights, codes, tail))
    unseen = math.log10(1 / denominator)
    scored = docs.mapInArrow(_score(path, model, spark.sparkContext.broadcast(known), unseen), SCORED.format(docs.schema["doc_id"].dataType.simpleString()))
    if distinct > most_shared:
        scored = written(scored.withColumn("row", F.expr("uuid()")), "scored")
        others = scored.select("row", F.explode("rare").alias("word"))
        more = others.join(words, "word").groupBy("row").agg(F.sum(F.log10((F.col("n") + 1).cast("double"))).alias("gain"), F.count("*").alias("more"))
        scored = scored.join(more, "row", "left").select(
            "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score"
        )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
