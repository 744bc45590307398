"""The corpus pipeline: documents through five operators of millrace.llm, one stage after another.

Each stage takes all documents that the one before kept, and its decisions take effect: the classifier and the two
deduplications drop rows, the mixture drops and repeats rows. The last stage returns doc_id and the tokens of each text
that is in the mix.
"""

from __future__ import annotations

import uuid

from millrace.llm import exact_dedup, mixing, quality, sentencepiece_bpe, simhash
from millrace.llm.common import shared_dir, table
from millrace.llm.queries import piece_model
from millrace.session import remove
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; every one where there are too few labels to train it.

    Nulls in any column are values of their own, repeated rows go together, an empty table stays empty, and further
    columns, whatever their names, are kept.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the document with the largest doc_id, a null doc_id above all others.

    Of rows that repeat a doc_id and a text one stays. Empty tables and further columns as in the first stage.
    """
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id (null last); texts without words are one component.

    Of rows that repeat a doc_id and a text one stays. Empty tables and further columns as in the first stage.
    """
    return simhash.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, at most twice; a null source is a source, a null text has no words.

    Repeated rows are taken equally often. Empty tables and further columns as in the first stage.
    """
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of each row in the mix; a null or empty text has no ids, an empty table gives no rows."""
    ids = sentencepiece_bpe.encode(docs.select("doc_id", "source", "text"), piece_model())
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: Newton iterations, trained models and BPE can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder as Parquet and read again.

    A stage's folder is removed when the next one has been written; the last one holds the rows that are returned.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            remove(spark, f"{at}/{i - 1}")
    return docs
