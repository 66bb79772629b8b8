"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers; both are first-order over the characters of keys, with
ends. They are trained from labelled samples: a value is a secret or it is not. A candidate is a run of key characters
of at least 16; it is a secret if its mean log-likelihood ratio per character is over the threshold, which is set on
held-out samples.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_marks, small_batches
from .spans import Span, Taken, in_order, secret_spans

KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?![\w+/=-])")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ENDS = len(LETTERS)
CODES = np.full(128, ENDS, np.int64)
CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(ENDS)
#: Random and ordinary values that the models learn from; documents whose words make ordinary identifiers.
SAMPLES = 20_000
SAMPLE_DOCS = 512
SAMPLE_WORDS = 64
#: The threshold is half-way between what so many of the ordinary samples exceed and so many of the secrets stay under.
FALSE_RATE = 0.0005
MISS_RATE = 0.02
SEED = 7
#: Words of identifiers in code, besides those of the documents.
COMMON = (
    "get set is has add remove create update delete find load save read write open close start stop begin end first last next previous from with for each by all any none default new old "
    "user name file path index value item list map data type text string number count size time date key id config option request response error message page table column row view node "
    "client server service handler manager factory builder helper util test result status state event input output source target content image document account address session query"
).split()
RESULT = "n_assign long, n_access long, n_hex long, base string, spans string"
RESULT_TYPE = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])


def codes(value: str) -> np.ndarray:
    inner = CODES[np.frombuffer(value.encode("ascii", "replace"), np.uint8)]
    return np.concatenate([[ENDS], inner, [ENDS]])


def transitions(values: Iterable[str]) -> np.ndarray:
    """Log-probabilities of the next character after each, smoothed by half a count."""
    counts = np.full((ENDS + 1, ENDS + 1), 0.5)
    for value in values:
        c = codes(value)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def ratio(table: np.ndarray, value: str) -> float:
    """Mean log-likelihood ratio per character, over 0 if the value is more like a random string."""
    c = codes(value)
    return float(table[c[:-1], c[1:]].mean())


def train(samples: list[tuple[str, bool]]) -> tuple[np.ndarray, float]:
    """(table of log-ratios, threshold) from (value, is_secret) rows; every fifth row is held out for the threshold."""
    fit = [x for i, x in enumerate(samples) if i % 5]
    table = transitions(v for v, secret in fit if secret) - transitions(v for v, secret in fit if not secret)
    held = [x for i, x in enumerate(samples) if not i % 5]
    ordinary = sorted((ratio(table, v) for v, secret in held if not secret), reverse=True)
    secret = sorted(ratio(table, v) for v, s in held if s)
    least = ordinary[int(len(ordinary) * FALSE_RATE)] if ordinary else 0.0
    return table, max(0.0, least, (least + secret[int(len(secret) * MISS_RATE)]) / 2 if secret else 0.0)


def random_values(n: int, rng: random.Random) -> list[str]:
    kinds = ["0123456789abcdef", LETTERS[:62], LETTERS[:64], LETTERS[:62] + "_-", LETTERS[26:62], LETTERS[:26] + "0123456789", LETTERS[26:52]]
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 64))) for _ in range(n)]


def ordinary_values(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Identifiers as people write them: words and numbers joined as in paths, snake case, kebab case and camel case;
    numbers, dates and rulers, too."""
    out = []
    while len(out) < n:
        if rng.random() < 0.25:
            number = "".join(rng.choices("0123456789", k=rng.randint(16, 24)))
            out.append(rng.choice([number, number, f"{number[:4]}-{number[4:6]}-{number[6:8]}-{number[8:]}", rng.choice("-=_") * rng.randint(16, 60)]))
            continue
        parts = rng.choices(words if words and rng.random() < 0.6 else COMMON, k=rng.randint(2, 6))
        if rng.random() < 0.3:
            parts.append(str(rng.randint(0, 10 ** rng.randint(1, 6))))
        joined = rng.choice(["_", "-", "/", "", "+", "="])
        parts = rng.choice([parts, [p.lower() for p in parts], [p.upper() for p in parts], [p.title() for p in parts]])
        value = joined.join(parts)
        out += [value] if len(value) >= 16 else []
    return out


def labelled_samples(docs: DataFrame, n: int = SAMPLES, n_docs: int = SAMPLE_DOCS) -> list[tuple[str, bool]]:
    """n random and n ordinary values. Words come from n_docs documents, those with the least hash of their ids, and
    from each SAMPLE_WORDS of its ASCII words by hash; both bounds are parameters, so the driver's share is bounded."""
    mark = F.xxhash64(F.lit("secrets"), "doc_id")
    marks = least_marks(docs.select(mark.alias("mark")), n_docs)
    picked = docs.select("text", mark.alias("mark")).where(F.col("mark") <= max(marks, default=-(2**63)))
    ascii_words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("\\b[A-Za-z]{2,12}\\b"), F.lit(0)))
    by_hash = F.slice(F.array_sort(F.transform(ascii_words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, SAMPLE_WORDS)
    lists = picked.select("mark", by_hash.alias("x")).groupBy("mark").agg(F.min("x").alias("x"))
    words = sorted({w.w for r in lists.collect() for w in r.x})
    rng = random.Random(SEED)
    samples = [(v, True) for v in random_values(n, rng)] + [(v, False) for v in ordinary_values(words, n, rng)]
    rng.shuffle(samples)
    return samples


def random_spans(text: str, base: list[Span], table: np.ndarray, threshold: float) -> list[Span]:
    taken, out = Taken(base), []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if ratio(table, value) > threshold and not taken.meets(*m.span()):
            out.append(("random", *m.span()))
    return out


def scan(text: str | None, table: np.ndarray, threshold: float) -> dict:
    base = secret_spans(text or "")
    more = random_spans(text or "", base, table, threshold)
    count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return {"n_assign": count[0], "n_access": count[1], "n_hex": count[2], "base": in_order(base, KINDS), "spans": in_order(base + more, KINDS)}


def _scan(model: Broadcast):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, threshold = model.value
        for batch in texts:
            yield pa.array([scan(t, table, threshold) for t in batch.to_pylist()], RESULT_TYPE)

    return run


def find_secrets(docs: DataFrame, samples: list[tuple[str, bool]] | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text needed): row (struct of its columns), found (struct of the counts, base and
    spans: kind:start:end, comma-joined).

    Base spans stay as they are; a span of kind random is added where the models say so and no base span lies; every run
    of at least 16 key characters is scored. Null and empty texts have no spans; texts are read whole in linear time at
    any length; repeated rows each get their spans, an empty table none, and extra columns of any name stay inside row.
    Spans that start at one place are listed in the order of KINDS. samples: (value, is_secret) rows; by default labelled_samples(docs).
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(samples or labelled_samples(docs)))
    return docs.select(F.struct("*").alias("row"), F.arrow_udf(_scan(model), RESULT)(F.col("text")).alias("found"))


def masked(found: DataFrame) -> DataFrame:
    """The documents of find_secrets() with each span of their texts replaced by <SECRET>; others as they are.
    Spans that overlap are replaced together."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in columns:
            out = []
            for text, listed in zip(texts.to_pylist(), spans.to_pylist()):
                if text is not None and listed:
                    taken = Taken((k, int(s), int(e)) for k, s, e in (x.split(":") for x in listed.split(",")))
                    for start, end in zip(taken.starts[::-1], taken.ends[::-1]):
                        text = f"{text[:start]}<SECRET>{text[end:]}"
                out.append(text)
            yield pa.array(out, pa.string())

    clean = F.arrow_udf(run, "string")(F.col("row.text"), F.col("found.spans"))
    return found.select(*[(clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in found.schema["row"].dataType.names])


def digests(found: DataFrame) -> DataFrame:
    return found.select("row.doc_id", "found.n_assign", "found.n_access", "found.n_hex", F.sha2("found.base", 256).alias("base_sha256"), "found.spans")
