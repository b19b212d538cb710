"""The corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last keep the columns of docs,
whatever they are; a stage works on all that the one before it kept, written as Parquet and read again.
Null and empty texts pass every stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, decontam, ngram_join, pii, toxicity
from eventloom.llm.common import Scratch, table, third, unused
from eventloom.llm.queries import TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC, by a classifier learnt from the training rows of labels."""
    learn = third(F.col("doc_id")) != 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learn), may_learn=learn)
    (score,) = unused(docs.columns, "__score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return ngram_join.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each span in its place; n_chars changes by as much as the text."""
    if "n_chars" not in docs.columns:
        return pii.redacted(docs)
    (before,) = unused(docs.columns, "__chars")
    done = pii.redacted(docs.withColumn(before, F.char_length("text")))
    change = F.char_length("text") - F.col(before)
    return done.withColumn("n_chars", F.coalesce(F.col("n_chars") + change, F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("bpe", encode),
]

#: Learning, near copies and encoding are beyond SQL; tests/llm/test_joins.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        made = Scratch(spark)
        docs = made.cut(stage(spark, docs, sf_dir))
        before.clear()  # what a stage has read isn't needed once its result is written
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
