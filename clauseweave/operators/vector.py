"""Exact dense-vector search over an embedding column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, l2_normalize

# Anything that turns texts into a 2-d float array can act as an embedder.
Embedder = Callable[[Sequence[str]], np.ndarray]


def embed_chunks(chunks: DataFrame, make_embedder: Callable[[], Embedder]) -> DataFrame:
    """Unit vectors of "title, newline, text" per chunk.

    ``make_embedder`` runs once per Python worker, so a model is loaded per
    worker and fed whole Arrow batches.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for texts in batches:
            matrix = np.asarray(embedder(list(texts)), dtype=np.float32)
            yield pd.Series(list(matrix))

    text = F.concat_ws("\n", F.col("section_title"), F.col("text"))
    return normalize(chunks.withColumn("embedding", encode(text)))


def normalize(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, l2_normalize(F.col(column)))


def cosine_scores(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Score of every row; a wrong query dimension fails the job."""
    length = max(float(np.linalg.norm(np.asarray(query, dtype=np.float64))), 1e-12)
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    size = F.size("embedding")
    checked = F.when(
        size != len(query),
        F.raise_error(F.lit("query embedding dimension does not match the index")),
    ).otherwise(F.col("embedding"))
    norm = F.greatest(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.lit(1e-12))
    return vectors.withColumn("score", dot(checked, unit) / norm)


def vector_search(
    vectors: DataFrame,
    query: Sequence[float],
    *,
    top_k: int = 10,
    id_column: str = "chunk_id",
    position: Column | str = "chunk_seq",
) -> DataFrame:
    """(rank, id, score) by descending score, ties by row position.

    One narrow pass and a bounded top-k; negative and zero scores are kept.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    position = F.col(position) if isinstance(position, str) else position
    top = (
        cosine_scores(vectors, query)
        .select(id_column, position.alias("_at"), "score")
        .orderBy(F.col("score").desc(), "_at")
        .limit(top_k)
    )
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "_at"))
    return top.withColumn("rank", rank).drop("_at")
