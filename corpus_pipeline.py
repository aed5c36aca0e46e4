"""A cleaning pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import exact_dedup, langid, near_dedup, packing, secrets
from readloom.llm.common import documents, fresh, stored
from readloom.llm.queries import PIECES, WORD_BPE

#: Posterior probability from which the predicted language replaces another one that is given.
SURE = 0.999


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or without a letter go, whatever is known of languages.

    lang becomes the predicted language where it is null or where the model is sure (SURE) of another one.
    """
    model = langid.train(docs, PIECES)
    pred, score = fresh(docs, "lang_pred", "score")
    found = langid.predict(docs, PIECES, model, (pred, score), lettered=True)
    known = F.when(F.col(pred) != "und", F.col(pred))
    lang = F.when(F.col("lang").isNull() | (F.col(score) >= SURE), F.coalesce(known, "lang")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays."""
    return near_dedup.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Near-duplicate groups come from minima of random arrivals, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
