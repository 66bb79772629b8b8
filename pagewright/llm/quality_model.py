"""Quality classifier by co-training.

Two views of a document: the content of its text, and its metadata (source, language, length). A logistic model of each
view starts from labelled rows. Round after round each scores all documents and labels those that it is surest of, for
the other view to learn from. Both are calibrated on labelled rows that neither has seen, together with the weights that
combine them; the combination scores every document. The models are fitted on the driver, on a bounded sample of labelled
rows and on what the rounds hand over; both bounds are parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, least_marks, small_batches, written

#: Rows of labels that the models are fitted on, by least hash within each class; a class of few rows has a share at least.
LABELLED = 4_000
LEAST_SHARE = 0.1
TEXT_SLOTS = 2_048
META_SLOTS = 512
ROUNDS = 4
#: Documents that a view hands over in a round, and how sure it must be of each.
HANDED = 400
SURE = 0.95
STEPS = 150
SYMBOLS = b"#*$%&|<>{}[]@^~\\/_=+"
DIGITS = b"0123456789"
CAPITALS = bytes(range(65, 91))
STATS = 8
VIEWS = ["text", "source", "lang", "n_chars"]
FEATURES = "mark long, y double, slots array<int>, shares array<float>, stats array<float>, meta array<int>"
RESULT = "score_text double, score_meta double, score double, kept boolean"
RESULT_TYPE = pa.struct([("score_text", pa.float64()), ("score_meta", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each word, statistics). Each statistic is a share or a bounded logarithm."""
    data = (text or "").encode()
    words = data.lower().split()
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    slots = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % TEXT_SLOTS
    stats = [
        min(np.log1p(len(words)) / 10, 1.5), min(size / n / 20, 2.0), (size - len(data.translate(None, SYMBOLS))) / size * 5, (size - len(data.translate(None, DIGITS))) / size * 5,
        (size - len(data.translate(None, CAPITALS))) / size * 5, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), min(size / max(1, len(lines)) / 1000, 2.0),
    ]
    return slots, np.array(stats, np.float32)


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Slots of the metadata and of their pairs."""
    length = "none" if n_chars is None else str(int(n_chars).bit_length())
    names = [f"s={source}", f"l={lang}", f"n={length}", f"sl={source}|{lang}", f"ln={lang}|{length}"]
    return [zlib.crc32(x.encode()) % META_SLOTS for x in names]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, y, text, source, lang, n_chars) to FEATURES."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for text, source, lang, n_chars in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            slots, stats = text_view(text)
            kinds, counts = np.unique(slots, return_counts=True)
            for column, x in zip(rows, (kinds.astype(np.int32), (counts / max(1, len(slots))).astype(np.float32), stats, meta_view(source, lang, n_chars))):
                column.append(x)
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(rows, kinds))], ["mark", "y", "slots", "shares", "stats", "meta"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, decay: float = 1e-4, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic model (the last is the constant), by Adam over all rows; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1], np.float32) if start is None else start.copy()
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        d = x.T @ ((sigmoid(x @ w) - y) * weight).astype(np.float32) + decay * w
        mean += 0.1 * (d - mean)
        square += 0.01 * (d * d - square)
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Rows:
    """Rows of both views on the driver: matrices, and the label of each (nan where it has none yet)."""

    text: np.ndarray
    meta: np.ndarray
    y: np.ndarray
    mark: np.ndarray


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    joint: tuple[float, float, float] = field(default=(0.0, 0.0, 0.0))


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's scaling of one or more logits, as weights with the constant last. Classes count as often as they occur.
    Steps use the bound of the curvature at its greatest, so they descend even where the classes are apart."""
    x = np.hstack([np.clip(z, -20, 20), np.ones((len(z), 1))])
    start = np.append(np.full(z.shape[1], 1 / z.shape[1]), 0.0)
    w, bound = start.copy(), np.linalg.inv(x.T @ x / 4 + 0.1 * np.eye(len(start)))
    for _ in range(300):
        w -= bound @ (x.T @ (sigmoid(x @ w) - y) + 0.1 * (w - start))
    return w


#: The views' lists of a round, in order: what text takes for good, what for bad, and the same of the metadata.
LISTS = 4


def sizes(handed: int, share: float) -> list[int]:
    good = int(handed * share)
    return [good, handed - good] * 2


def co_train(known: Rows, pick: Callable[[Model, list[int], set[int]], list[Rows]], rounds: int = ROUNDS, handed: int = HANDED) -> Model:
    """known: labelled rows, of which every fourth is kept for calibration. pick(model, sizes, taken) gives the LISTS of rows
    that the views are surest of, none with a mark in taken."""
    held = np.arange(len(known.y)) % 4 == 0
    views, y = [known.text, known.meta], known.y
    learnt = [[v[~held]] for v in views]
    aims = [[y[~held]] for _ in views]
    weights = [fit(v[~held], y[~held]) for v in views]
    taken = set(known.mark.tolist())
    # how sure a view is counts by its calibrated probabilities, so a view that tells little hands over nothing
    scaled = lambda: [tuple(calibrate(logits(v[held], w)[:, None], y[held])) for v, w in zip(views, weights)]
    for _ in range(rounds):
        found = pick(Model(*weights, *scaled()), sizes(handed, float(y[~held].mean())), taken)
        for i in (0, 1):
            for k, rows in enumerate(found[2 * (1 - i) : 2 * (1 - i) + 2]):
                learnt[i].append(rows.text if i == 0 else rows.meta)
                aims[i].append(np.full(len(rows.mark), 1.0 - k))
            weights[i] = fit(np.concatenate(learnt[i]), np.concatenate(aims[i]), weights[i])
        taken |= {m for rows in found for m in rows.mark.tolist()}
    scales = scaled()
    z = [a * logits(v[held], w) + b for v, w, (a, b) in zip(views, weights, scales)]
    return Model(*weights, *scales, tuple(calibrate(np.stack(z, 1), y[held])))


def view_logits(text: str | None, source: str | None, lang: str | None, n_chars: int | None, m: Model) -> tuple[float, float]:
    """Calibrated logits of both views."""
    slots, stats = text_view(text)
    z_text = (float(m.text[slots].sum() / len(slots)) if len(slots) else 0.0) + float(stats @ m.text[TEXT_SLOTS:-1]) + float(m.text[-1])
    z_meta = float(m.meta[sorted(set(meta_view(source, lang, n_chars)))].sum() + m.meta[-1])
    return m.text_scale[0] * z_text + m.text_scale[1], m.meta_scale[0] * z_meta + m.meta_scale[1]


def surest(found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
    """The most greatest (sureness, mark) of different marks; ties go to the least mark."""
    return sorted(set(found), key=lambda x: (-x[0], x[1]))[:most]


def _surest(model: Broadcast, most: list[int], taken: Broadcast):
    """(mark, text, source, lang, n_chars) to (list, sure, mark): of each list what a task is surest of."""
    edge = float(np.log(SURE / (1 - SURE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bar = model.value, taken.value
        lists: list[list[tuple[float, int]]] = [[] for _ in range(LISTS)]
        for batch in batches:
            for mark, *views in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if mark in bar:
                    continue
                a, b = view_logits(*views, m)
                for k, sure in enumerate((a, -a, b, -b)):
                    if sure >= edge:
                        lists[k].append((sure, mark))
            lists = [surest(x, n) for x, n in zip(lists, most)]
        out = [(k, *x) for k, own in enumerate(lists) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["list", "sure", "mark"])

    return run


def view_mark() -> Column:
    """What a document is to the views: copies with the same metadata are one."""
    return F.xxhash64(F.lit("co-training"), *VIEWS).alias("mark")


def on_driver(rows: DataFrame) -> Rows:
    """rows (mark, y and VIEWS; few) as matrices, each mark once, in the order of marks."""
    found = {r.mark: r for r in rows.select("mark", "y", *VIEWS).mapInArrow(_features, FEATURES).collect()}
    text, meta = np.zeros((len(found), TEXT_SLOTS + STATS), np.float32), np.zeros((len(found), META_SLOTS), np.float32)
    for i, (_, r) in enumerate(sorted(found.items())):
        text[i, r.slots] = r.shares
        text[i, TEXT_SLOTS:] = r.stats
        meta[i, r.meta] = 1
    return Rows(text, meta, np.array([found[k].y for k in sorted(found)], np.float64), np.array(sorted(found), np.int64))


def marked_rows(docs: DataFrame, marks: list[int]) -> DataFrame:
    """The rows of docs whose views have one of the marks (few)."""
    wanted = docs.sparkSession.createDataFrame([(m,) for m in marks], "wanted long")
    return docs.select(view_mark(), F.lit(None).cast("double").alias("y"), *VIEWS).join(F.broadcast(wanted), F.col("mark") == F.col("wanted"))


def pick_from(docs: DataFrame) -> Callable[[Model, list[int], set[int]], list[Rows]]:
    """pick() over all rows of docs: tasks keep what they are surest of, and of that each list's surest come to the driver."""

    def pick(model: Model, most: list[int], taken: set[int]) -> list[Rows]:
        sc = docs.sparkSession.sparkContext
        run = _surest(sc.broadcast(model), most, sc.broadcast(frozenset(taken)))
        found = written(docs.select(view_mark(), *VIEWS).mapInArrow(run, "list int, sure double, mark long"), "surest")
        marks = [[r.mark for r in found.where(F.col("list") == k).groupBy("mark").agg(F.max("sure").alias("sure")).orderBy(F.desc("sure"), "mark").limit(n).collect()] for k, n in enumerate(most)]
        rows = on_driver(marked_rows(docs, sorted({m for own in marks for m in own})))
        at = {m: i for i, m in enumerate(rows.mark.tolist())}
        index = [np.array([at[m] for m in own], np.int64) for own in marks]
        return [Rows(rows.text[i], rows.meta[i], rows.y[i], rows.mark[i]) for i in index]

    return pick


def labelled_sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Rows, int, int]:
    """Labelled rows of docs on the driver, and how many documents are good and bad. Of an id with several labels the worst
    counts; null labels and ids, and labels of absent documents, are left out. Within each class the ids of least hash
    are taken, in proportion to its size but LEAST_SHARE of the sample if it has as many."""
    if labelled > BROADCAST_ROWS:
        raise ValueError(f"the sample must have at most {BROADCAST_ROWS} rows")
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    told = written(docs.where("doc_id is not null").select("doc_id").distinct().join(told, "doc_id").select("doc_id", "y", F.xxhash64(F.lit("co-training"), "doc_id").alias("mark")), "labelled")
    count = {r.y: r.n for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    known: dict = {}
    for y, n in count.items():
        most = max(1, int(labelled * max(LEAST_SHARE, min(1 - LEAST_SHARE, n / sum(count.values())))))
        of_class = told.where(F.col("y") == y)
        cut = max(least_marks(of_class.select("mark"), most), default=-(2**63))
        known |= {r.doc_id: float(y) for r in of_class.where(F.col("mark") <= cut).select("doc_id").collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(sorted(known.items()), f"doc_id {kind}, y double")
    rows = docs.select("doc_id", view_mark(), *VIEWS).join(F.broadcast(wanted), "doc_id")
    return on_driver(rows), count.get(1, 0), count.get(0, 0)


def judge(text: str | None, source: str | None, lang: str | None, n_chars: int | None, m: Model) -> dict:
    a, b = view_logits(text, source, lang, n_chars, m)
    score = float(sigmoid(m.joint[0] * np.clip(a, -20, 20) + m.joint[1] * np.clip(b, -20, 20) + m.joint[2]))
    return {"score_text": float(sigmoid(a)), "score_meta": float(sigmoid(b)), "score": score, "kept": score >= 0.5}


def _judge(model: Broadcast):
    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = model.value
        for parts in columns:
            yield pa.array([judge(*row, m) for row in zip(*(p.to_pylist() for p in parts))], RESULT_TYPE)

    return run


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> DataFrame:
    """A row per row of docs (doc_id, text, source, lang, n_chars needed): row (struct of its columns), found (score_text and
    score_meta: calibrated probabilities of quality by each view; score: of both; kept: score of at least 0.5).

    Learns from labels (doc_id, quality 0 or 1). Null and empty texts have no words; null metadata are values like others;
    texts of any length are read whole. Rows that are alike to both views are learnt from once and all get the same score.
    Where labels of both classes for documents that exist are lacking, nothing can be learnt: every score is the share of
    good ones among the labels, (good + 1) / (all + 2). An empty table gives none; extra columns stay inside row.
    """
    small_batches(docs.sparkSession)
    views = docs.select("doc_id", *VIEWS)
    known, good, bad = labelled_sample(views, labels, labelled)
    if good and bad and len(set(known.y.tolist())) == 2:
        model = co_train(known, pick_from(views), rounds, handed)
    else:
        prior = float(np.log((good + 1) / (bad + 1)))
        model = Model(np.zeros(TEXT_SLOTS + STATS + 1), np.zeros(META_SLOTS + 1), (0.0, prior), (0.0, prior), (0.5, 0.5, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = F.arrow_udf(_judge(shared), RESULT)(*[F.col(c) for c in VIEWS])
    return docs.select(F.struct("*").alias("row"), found.alias("found"))
