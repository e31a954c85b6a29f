"""Graph profiling in one pass over the nodes and one over the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sections as S
from .graph_query import attribute, edge_relations


def _seen(kind: int, seq: str, position: Column) -> Column:
    """Order of a first occurrence: nodes before edges, then the element, then the place in it."""
    return F.struct(
        F.lit(kind).alias("kind"),
        F.col(seq).cast("decimal(38,0)").alias("seq"),
        position.cast("long").alias("at"),
    )


def _entry(metric: str, key: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), key.alias("key"))


def _covered(metric: str) -> Column:
    """Keys of the non-empty attributes of an element."""
    filled = F.map_filter("attributes", lambda _, value: value != "")
    return F.transform(F.map_keys(filled), lambda key: _entry(metric, key))


def _spec_entries(kind: str, spec_token: str, source_token: str) -> Column:
    """What an element with the spec's provenance contributes to coverage."""
    sections = S.marked_sections(attribute("file_path"), source_token)
    token = F.when(
        F.contains(attribute("source_file"), F.lit(source_token)),
        F.array(_entry("source_token", F.lit(source_token))),
    ).otherwise(F.array().cast("array<struct<metric:string,key:string>>"))
    entries = F.concat(
        F.array(_entry(f"matching_spec_{kind}", F.lit(""))),
        F.transform(sections, lambda s: _entry("section", s)),
        token,
    )
    return F.when(S.names_spec(F.col("attributes"), spec_token), entries).otherwise(
        F.array().cast("array<struct<metric:string,key:string>>")
    )


def _count(elements: DataFrame, kind: int, seq: str, entries: list[Column]) -> DataFrame:
    # posexplode_outer: the plain form would evaluate the entries twice.
    flat = elements.select(seq, F.posexplode_outer(F.concat(*entries)).alias("at", "e"))
    return (
        flat.filter(F.col("at").isNotNull())
        .groupBy("e.metric", "e.key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(_seen(kind, seq, F.col("at"))).alias("first_seen"))
    )


def audit_counts(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    spec_token: str = S.DEFAULT_SPEC_TOKEN,
    source_token: str = S.DEFAULT_SOURCE_TOKEN,
) -> DataFrame:
    """Long form (metric, key, n, first_seen).

    Metrics: nodes, edges, self_loops, node_attribute, edge_attribute,
    entity_type, relation, matching_spec_nodes, matching_spec_edges, section and
    source_token.  Every metric is a few distinct keys, combined map-side.
    """
    entity_type = F.coalesce(F.nullif(attribute("entity_type"), F.lit("")), F.lit("UNKNOWN"))
    by_node = _count(
        nodes,
        0,
        "node_seq",
        [
            F.array(_entry("nodes", F.lit("")), _entry("entity_type", entity_type)),
            _covered("node_attribute"),
            _spec_entries("nodes", spec_token, source_token),
        ],
    )
    loop = F.when(F.col("source") == F.col("target"), F.lit("self_loops")).otherwise(F.lit(None))
    by_edge = _count(
        edges,
        1,
        "edge_seq",
        [
            F.array(_entry("edges", F.lit(""))),
            F.filter(
                F.array(F.struct(loop.alias("metric"), F.lit("").alias("key"))),
                lambda e: e["metric"].isNotNull(),
            ),
            _covered("edge_attribute"),
            F.transform(edge_relations(), lambda r: _entry("relation", r)),
            _spec_entries("edges", spec_token, source_token),
        ],
    )
    both = by_node.unionByName(by_edge)
    return both.groupBy("metric", "key").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen")
    )


def histogram(counts: DataFrame, metric: str) -> DataFrame:
    """(key, n) of one metric, most common first, ties first seen first."""
    chosen = counts.filter(F.col("metric") == metric)
    return chosen.orderBy(F.col("n").desc(), "first_seen").select("key", "n")


def covered_sections(counts: DataFrame) -> DataFrame:
    """Distinct sections in numeric order."""
    chosen = counts.filter(F.col("metric") == "section").select(F.col("key").alias("section"))
    return chosen.orderBy(S.numeric_sort_key(F.col("section")))


def audit_summary(counts: DataFrame) -> DataFrame:
    """One row of plain totals."""
    total = lambda name: F.coalesce(
        F.sum(F.when(F.col("metric") == name, F.col("n"))), F.lit(0)
    ).alias(name)
    names = ("nodes", "edges", "self_loops", "matching_spec_nodes", "matching_spec_edges")
    return counts.agg(*[total(name) for name in names])
