"""Corpus pipeline: five stages over ``documents``, each written and read again.

1. quality classifier: documents that it rejects go;
2. SimHash near-dedup: one document of each class of near copies stays;
3. benchmark decontamination: documents with a benchmark window go;
4. secret scans: secrets in the texts are masked (n_chars follows);
5. byte-level BPE: the texts as token ids.

All stages but the last return the columns of ``documents``.

Edge cases: a null text counts as empty in every stage and stays null; a null
doc_id is a value like any other, and of near copies the row with an id stays;
repeated rows are near copies of each other; very long texts are whole; empty
tables give empty results; further columns of ``documents``, whatever their
names, stay with their rows; without ``labels`` of both kinds every text scores
alike, and stays if the share of good labels (half, without any) is the threshold
or more; without ``benchmark`` items none goes; n_chars follows a text's length
where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import bpe, decontam, near, quality, secrets
from fathomline.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_report(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("bpe", tokenize),
]

#: A learned classifier and token merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
