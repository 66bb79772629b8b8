"""The corpus pipeline: documents in, the rows of the training mix out.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents, and so has what all stages but the last return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, mixing, quality_rules, secrets, similar
from pagewright.llm.common import kept, removed, table


def _own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's thresholds go: so do null and empty texts, which have no word.
    Repeated rows share their verdict; an empty table stays one; columns of any name are kept as they are."""
    return _own(quality_rules.quality_rules(docs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) one document stays: the
    one of least id. Null, empty and blank texts are one group; rows without an id, or that share one, go only for rows of
    their own group. An empty table stays one; columns of any name are kept as they are."""
    return similar.without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts hold none; repeated rows share their verdict; an
    empty table, or benchmark, takes nothing away; columns of any name are kept as they are."""
    return _own(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay. n_chars follows the text, and is null for
    a null one. Null and empty texts stay as they are; repeated rows are masked alike; an empty table stays one."""
    out = secrets.masked(secrets.find_secrets(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows to train on: each document once for each epoch that takes words of it, with mix_epoch and mix_words,
    which take the place of columns of the same names. Texts without words are in no epoch; repeated rows are mixed each
    for itself; null sources are one source; an empty table gives none."""
    return mixing.epochs(mixing.mix(docs))


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mix),
]

#: SimHash components and Markov models are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's own tables go when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = kept(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, name)
        if i:
            removed(docs)
        docs = done
    return docs
