"""Alignment of graph items with the chunks that support them.

Items that ask the same question (equal label, description and provenance
sections) are scored once and joined back, so a relation repeated on a third of
all edges costs one scoring.  Provenance sections are matched in blocks of a
section's items and chunks (:mod:`section_match`), which hand on ids and counts
of the best pairs only; items without any go through one batched BM25 search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import py_round
from ..functions.sections import DEFAULT_SOURCE_TOKEN, provenance_sections
from ..functions.text import normalize_entity, token_overlap, tokenize
from ..session import broadcast_within, materialize, top_k_per_group
from . import section_match
from .bm25 import Bm25Index
from .graph_query import attribute, edge_relations, node_label

# Component weights and thresholds.
SECTION_WEIGHT = 0.45
NAME_WEIGHT = 0.4
OVERLAP_WEIGHT = 0.15
OVERLAP_SATURATION = 0.3
VERIFIED_SCORE = 0.88
HIGH_SCORE = 0.68


def graph_items(nodes: DataFrame, edges: DataFrame, source_token: str = DEFAULT_SOURCE_TOKEN) -> DataFrame:
    """Nodes then edges as (item_seq, graph_item_id, graph_item_type, label, description, sections)."""
    sections = provenance_sections(attribute("file_path"), source_token)
    joined = F.array_join(edge_relations(), " ")
    ends = F.concat_ws(" ", "source", "target")
    as_nodes = nodes.select(
        F.struct(F.lit(0).alias("kind"), F.col("node_seq").alias("seq")).alias("item_seq"),
        F.col("node_id").alias("graph_item_id"),
        F.lit("node").alias("graph_item_type"),
        node_label().alias("label"),
        attribute("description").alias("description"),
        sections.alias("sections"),
    )
    as_edges = edges.select(
        F.struct(F.lit(1).alias("kind"), F.col("edge_seq").alias("seq")).alias("item_seq"),
        F.concat("source", F.lit("->"), "target", F.lit("#"), F.col("edge_seq").cast("string")).alias(
            "graph_item_id"
        ),
        F.lit("edge").alias("graph_item_type"),
        F.when(joined == "", ends).otherwise(joined).alias("label"),
        attribute("description").alias("description"),
        sections.alias("sections"),
    )
    return as_nodes.unionByName(as_edges)


_QUESTION = ("label", "description", "sections")


def _qid() -> Column:
    """Collision-safe key of a question (SHA-256 of its JSON rendering)."""
    return F.sha2(F.to_json(F.struct(*_QUESTION)), 256)


def fallback_candidates(
    questions: DataFrame, index: Bm25Index, max_per_item: int, description_chars: int | None = None
) -> DataFrame:
    """(qid, chunk_id) of the best lexical hits for ``questions``.

    The query is the label and the whole description, or its first
    ``description_chars`` characters where a caller asks for that.
    """
    described = F.col("description")
    if description_chars is not None:
        described = F.substring(described, 1, description_chars)
    text = F.trim(F.concat_ws(" ", "label", described))
    queries = questions.select(F.col("qid").alias("query_id"), text.alias("query"))
    hits = index.search_many(queries, top_k=2 * max_per_item)
    return hits.select(F.col("query_id").alias("qid"), "chunk_id")


def confidence_label(score: Column, name_match: Column, section_match: Column) -> Column:
    return (
        F.when((score >= VERIFIED_SCORE) & name_match & section_match, "verified")
        .when((score >= HIGH_SCORE) & section_match, "high")
        .otherwise("candidate")
    )


def overlap_component(overlap: Column) -> Column:
    return py_round(
        F.least(overlap / F.lit(OVERLAP_SATURATION), F.lit(1.0)) * F.lit(OVERLAP_WEIGHT), 6
    )


def item_tokens() -> Column:
    """Distinct tokens of an item's description, or of its label where it has none."""
    described = F.coalesce(F.nullif("description", F.lit("")), F.col("label"))
    return F.array_distinct(tokenize(described))


def compared(pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id, name_match, section_match, shared, n_item, n_chunk) of pairs of ids.

    Each text is folded and cut into tokens once, whatever the number of its pairs.
    """
    asked = questions.join(broadcast_within(pairs.select("qid").distinct()), "qid", "left_semi").select(
        "qid", "sections", normalize_entity(F.col("label")).alias("norm_label"), item_tokens().alias("item_tokens")
    )
    held = chunks.join(broadcast_within(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi").select(
        "chunk_id", "section", normalize_entity(F.col("text")).alias("norm_text"), F.array_distinct(tokenize(F.col("text"))).alias("chunk_tokens")
    )
    return pairs.join(asked, "qid").join(held, "chunk_id").select(
        "qid",
        "chunk_id",
        ((F.col("norm_label") != "") & F.contains("norm_text", F.col("norm_label"))).alias("name_match"),
        F.array_contains("sections", F.col("section")).alias("section_match"),
        F.size(F.array_intersect("chunk_tokens", "item_tokens")).alias("shared"),
        F.size("item_tokens").alias("n_item"),
        F.size("chunk_tokens").alias("n_chunk"),
    )


def score_pairs(signals: DataFrame) -> DataFrame:
    """Component scores and confidence of compared pairs."""
    overlap = token_overlap(F.col("shared"), F.col("n_item"), F.col("n_chunk"))
    part = lambda flag, weight: F.when(F.col(flag), F.lit(weight)).otherwise(F.lit(0.0))
    return signals.withColumn("overlap", overlap).select(
        "qid",
        "chunk_id",
        "name_match",
        "section_match",
        "overlap",
        part("section_match", SECTION_WEIGHT).alias("section_score"),
        part("name_match", NAME_WEIGHT).alias("name_score"),
        overlap_component(F.col("overlap")).alias("overlap_score"),
    ).withColumn(
        "confidence", py_round(F.col("section_score") + F.col("name_score") + F.col("overlap_score"), 6)
    )


def section_pairs(questions: DataFrame, chunks: DataFrame, max_per_item: int) -> DataFrame:
    """The best chunks of each question's sections as compared pairs: ``max_per_item`` from each block at most."""
    asked = questions.select(
        F.explode("sections").alias("section"), "qid", normalize_entity(F.col("label")).alias("label"), item_tokens().alias("tokens"),
        (F.octet_length("label") + F.octet_length("description")).alias("size"),
    )
    held = chunks.select(
        "section", "chunk_id", normalize_entity(F.col("text")).alias("text"), F.array_distinct(tokenize(F.col("text"))).alias("tokens"),
        (2 * F.octet_length("text")).alias("size"),
    )
    weights = section_match.Weights(NAME_WEIGHT, OVERLAP_WEIGHT, OVERLAP_SATURATION)
    return section_match.best_pairs(asked, held, weights, max_per_item).withColumn("section_match", F.lit(True))


def _best(scored: DataFrame, max_per_item: int) -> DataFrame:
    order = [F.col("confidence").desc(), F.col("chunk_id")]
    return top_k_per_group(scored, ["qid"], order, max_per_item)


def _describe(best: DataFrame) -> DataFrame:
    methods = F.filter(
        F.array(
            F.when(F.col("section_match"), "provenance_section"),
            F.when(F.col("name_match"), "entity_name"),
            F.when(F.col("overlap") > 0, "description_overlap"),
        ),
        lambda m: m.isNotNull(),
    )
    return best.filter(F.col("confidence") > 0).select(
        "qid",
        "rank",
        "chunk_id",
        "confidence",
        confidence_label(F.col("confidence"), F.col("name_match"), F.col("section_match")).alias(
            "confidence_label"
        ),
        methods.alias("match_methods"),
        F.create_map(
            F.lit("section"),
            F.col("section_score"),
            F.lit("entity_name"),
            F.col("name_score"),
            F.lit("description_overlap"),
            F.col("overlap_score"),
        ).alias("component_scores"),
    )


def align(
    nodes: DataFrame,
    edges: DataFrame,
    chunks: DataFrame,
    *,
    max_per_item: int = 3,
    source_token: str = DEFAULT_SOURCE_TOKEN,
) -> DataFrame:
    """Alignment rows with their item and rank order (item_seq, rank)."""
    items = materialize(graph_items(nodes, edges, source_token).withColumn("qid", _qid()))
    questions = items.select(*_QUESTION, "qid").dropDuplicates(["qid"])
    direct = materialize(_best(score_pairs(section_pairs(questions, chunks, max_per_item)), max_per_item))
    unmatched = materialize(questions.join(direct.select("qid").distinct(), "qid", "left_anti"))
    if not unmatched.isEmpty():
        # At most 2 * max_per_item ids per question; only their texts are compared.
        picked = materialize(fallback_candidates(unmatched, Bm25Index(chunks), max_per_item))
        fallback = _best(score_pairs(compared(picked, unmatched, chunks)), max_per_item)
        direct = direct.unionByName(fallback)
    described = _describe(direct)
    return items.select("item_seq", "graph_item_id", "graph_item_type", "qid").join(
        described, "qid"
    ).select(
        "item_seq",
        "rank",
        "graph_item_id",
        "graph_item_type",
        "chunk_id",
        "confidence",
        "confidence_label",
        "match_methods",
        "component_scores",
        F.lit("auto").alias("review_status"),
    )


def alignment_summary(alignments: DataFrame) -> DataFrame:
    """One row: alignments, aligned nodes and edges, rows per label."""
    is_type = lambda kind: F.when(F.col("graph_item_type") == kind, F.col("graph_item_id"))
    return alignments.agg(
        F.count(F.lit(1)).alias("alignments"),
        F.countDistinct(is_type("node")).alias("aligned_nodes"),
        F.countDistinct(is_type("edge")).alias("aligned_edges"),
        *[
            F.count_if(F.col("confidence_label") == label).alias(label)
            for label in ("verified", "high", "candidate")
        ],
    )


def best_evidence(alignments: DataFrame, k: int) -> DataFrame:
    """Of each item the ``k`` alignments with most confidence, in the order of ``ordinal`` where equal.

    Cut before any chunk is looked up, so a missing chunk is not replaced by the next one.
    """
    named = alignments.filter(F.col("graph_item_id").isNotNull())
    order = [F.col("confidence").desc(), F.col("ordinal")]
    return top_k_per_group(named, ["graph_item_id"], order, k, rank="evidence_rank")
