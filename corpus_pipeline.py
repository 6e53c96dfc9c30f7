"""A corpus pipeline over `documents`: toxicity filter, near-duplicate removal, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept; run() writes each stage's rows as Parquet into
the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontamination, neardup, pieces, toxicity
from foliant.llm.common import fresh, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that a model fitted on the labelled rows of these documents scores 0.5 or more. The scores travel beside the
    rows, so repeated rows and clashing columns stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "_toxicity")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group at five-word shingle similarity 0.8 or more."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row whose text has a passage that holds question and answer of a benchmark item. Each row is decided by its own text,
    so null or repeated ids drop no other row."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens and round_trip of every document."""
    return pieces.encode(docs.select("doc_id", "text", "lang", "source", "n_chars")).drop("text")


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("tokenise", tokenise),
]

#: Boosted trees, fingerprints and Viterbi paths aren't SQL: tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
