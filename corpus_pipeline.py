"""Corpus pipeline: documents in, token ids out, in five stages.

Every stage works on all rows that the one before kept, and hands on the columns of
``documents``; the last one returns the encoded mix.  Rows with nulls, empty texts and
repeated rows pass every stage as the operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseweave.llm import bpe, mixing, near_dedup, quality, secrets
from clauseweave.llm.common import small_batches
from clauseweave.llm.queries import ratings, tokenizer_path
from clauseweave.session import number_ordered, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones, does not reject."""
    model = quality.fit(docs, ratings(spark, sf_dir))
    return docs.filter(quality.selected(quality.graded(docs, model)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, rows without an id last.

    Each row is compared and dropped under a number of its own, so a repeated id or none is no matter.
    """
    keyed = mixing._keyed(docs).select("key", "doc_id", "row")
    numbers = number_ordered(keyed.select("key", "doc_id").orderBy(F.col("doc_id").asc_nulls_last(), "key"), "number").select("key", "number")
    rows = keyed.join(numbers, "key").select(F.col("number").alias("doc_id"), F.col("row")["text"].alias("text"))
    dropped = near_dedup.near_duplicates(rows).filter(~F.col("kept")).select(F.col("doc_id").alias("number"))
    dropped = numbers.join(dropped, "number").select("key")
    return keyed.join(dropped, "key", "left_anti").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each round in which their source's target takes them."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, and whether they decode to it."""
    content = bpe.read_tokenizer(tokenizer_path())
    out = bpe.encoded(docs, content, decoded=True, keep=False)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("secret scan", secrets_stage),
    ("source mix", mixing_stage),
    ("bpe", encoding_stage),
]

# The classifier and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with small_batches(spark, 256):  # texts go to Python a few hundred at a time
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
