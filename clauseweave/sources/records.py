"""Smaller record sources: questions, alignments, manifest, stored vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALIGNMENT, ARTIFACT, QUESTION
from .ordinal import with_ordinal

TRUSTED_LABELS = ("verified", "high")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from a JSON list; an empty list is an error."""
    questions = spark.read.schema(QUESTION).option("multiLine", "true").json(path)
    questions = questions.filter(F.col("question").isNotNull())
    if questions.isEmpty():
        raise ValueError("the evaluation file must contain a non-empty JSON list")
    return questions


def read_alignments(spark: SparkSession, path: str, trusted_only: bool = False, ordinal: str | None = None) -> DataFrame:
    """Stored alignments; with ``ordinal``, also each one's place in the file order, from 1.

    A line that is no JSON object keeps its place and has nulls in all columns.
    """
    rows = spark.read.schema(ALIGNMENT).json(path)
    if ordinal:
        rows = with_ordinal(rows, ordinal, ALIGNMENT.fieldNames()).drop("_path")
    return rows.filter(F.col("confidence_label").isin(*TRUSTED_LABELS)) if trusted_only else rows


def write_alignments(alignments: DataFrame, path: str) -> None:
    """JSON lines: nodes before edges in graph order, ranked within an item."""
    ordered = alignments.orderBy("item_seq", "rank").select(*ALIGNMENT.fieldNames())
    ordered.write.option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Source artifacts listed under the ``artifacts`` key of a JSON document."""
    document = spark.read.schema(f"artifacts array<{ARTIFACT.simpleString()}>")
    listed = document.option("multiLine", "true").json(path)
    return listed.select(F.explode("artifacts").alias("a")).select("a.*")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_seq, embedding) rows of ``.npy`` matrices, never unpickled."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                matrix = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                if matrix.ndim != 2:
                    raise ValueError("an embedding matrix needs one row per chunk")
                for at in range(0, len(matrix), 4096):
                    block = matrix[at : at + 4096]
                    yield pd.DataFrame(
                        {"chunk_seq": np.arange(at, at + len(block)), "embedding": list(block)}
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(load, "chunk_seq long, embedding array<float>")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with an explicit chunk key, as Parquet."""
    vectors.write.parquet(path)
