"""Reciprocal-rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import top_k_per_group


def _ranks(hits: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per id the last rank and the summed weight, should an id occur twice."""
    return hits.groupBy(*keys).agg(
        F.max("rank").alias(f"{name}_rank"), F.sum("_weight").alias(f"{name}_weight")
    )


def reciprocal_rank_fusion(
    lexical: DataFrame,
    vector: DataFrame,
    *,
    top_k: int = 10,
    rank_constant: int = 60,
    query_column: str | None = None,
) -> DataFrame:
    """Fuse ``(chunk_id, rank)`` lists, per query when ``query_column`` is given.

    Returns rank, chunk_id, score and both source ranks (null when absent).
    """
    groups = [query_column] if query_column else []
    keys = [*groups, "chunk_id"]
    weight = F.lit(1.0) / (F.lit(rank_constant) + F.col("rank"))
    left = _ranks(lexical.withColumn("_weight", weight), keys, "lexical")
    right = _ranks(vector.withColumn("_weight", weight), keys, "vector")
    zero = F.lit(0.0)
    fused = left.join(right, keys, "full_outer").select(
        *keys,
        (F.coalesce("lexical_weight", zero) + F.coalesce("vector_weight", zero)).alias("score"),
        "lexical_rank",
        "vector_rank",
    )
    order = [F.col("score").desc(), F.col("chunk_id")]
    if groups:
        return top_k_per_group(fused, groups, order, top_k)
    best = fused.orderBy(*order).limit(top_k).withColumn("_all", F.lit(0))
    return top_k_per_group(best, ["_all"], order, top_k).drop("_all")
