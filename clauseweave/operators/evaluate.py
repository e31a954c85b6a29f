"""Section-level retrieval evaluation: hit rate at k and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import py_round
from ..functions.sections import under_prefix
from .bm25 import Bm25Index


def judge_hits(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question the retrieved sections and the first relevant rank.

    ``hits(query_id, rank, section)`` holds at most top_k rows per question, so
    every group here is bounded by k.
    """
    per_question = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "section"))).alias("found")
    )
    relevant = F.filter(
        F.coalesce("found", F.array().cast("array<struct<rank:int,section:string>>")),
        lambda hit: F.exists(
            "required_sections", lambda wanted: under_prefix(hit["section"], wanted)
        ),
    )
    judged = questions.join(per_question, questions["id"] == per_question["query_id"], "left")
    return judged.select(
        "id",
        "question",
        "required_sections",
        F.transform(
            F.coalesce("found", F.array().cast("array<struct<rank:int,section:string>>")),
            lambda hit: hit["section"],
        ).alias("retrieved_sections"),
        F.get(relevant, F.lit(0))["rank"].alias("first_relevant_rank"),
    ).withColumn("passed", F.col("first_relevant_rank").isNotNull())


def summarize(results: DataFrame, top_k: int) -> DataFrame:
    """One row: questions, top_k, recall_at_k, mean_reciprocal_rank."""
    reciprocal = F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0))
    return results.agg(
        F.count(F.lit(1)).alias("questions"),
        F.lit(top_k).alias("top_k"),
        py_round(F.avg(F.col("passed").cast("double")), 6).alias("recall_at_k"),
        py_round(F.avg(reciprocal), 6).alias("mean_reciprocal_rank"),
    )


def evaluate_bm25(index: Bm25Index, questions: DataFrame, *, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary, per-question results) for questions(id, question, required_sections)."""
    if questions.isEmpty():
        raise ValueError("the evaluation needs at least one question")
    queries = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    hits = index.search_many(queries, top_k=top_k).select("query_id", "rank", "section")
    results = judge_hits(hits, questions)
    return summarize(results, top_k), results
