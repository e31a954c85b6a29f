"""Subgraph of the elements that carry one specification's provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sections import DEFAULT_SPEC_TOKEN, names_spec


@dataclass(frozen=True)
class SubgraphExport:
    nodes: DataFrame  # retained node rows
    edges: DataFrame  # retained edges with a boolean ``provenance``
    retained_ids: DataFrame  # (node_id, direct): includes dangling endpoints

    def counters(self) -> DataFrame:
        """One row; ``nodes`` counts retained ids, dangling endpoints included."""
        ids = self.retained_ids.agg(
            F.count(F.lit(1)).alias("nodes"),
            F.count_if("direct").alias("directly_matched_nodes"),
            F.count_if(~F.col("direct")).alias("endpoint_nodes"),
        )
        kept = self.edges.agg(
            F.count(F.lit(1)).alias("edges"),
            F.count_if("provenance").alias("provenance_edges"),
            F.count_if(~F.col("provenance")).alias("contextual_edges"),
        )
        one = F.lit(1)
        return ids.withColumn("_one", one).join(kept.withColumn("_one", one), "_one").drop("_one")


def export_subgraph(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    spec_token: str = DEFAULT_SPEC_TOKEN,
    include_contextual_edges: bool = True,
) -> SubgraphExport:
    """Keep matching elements, the endpoints of matching edges and, optionally,
    other edges between kept nodes.

    Endpoints are reduced to distinct ids map-side before any join.  The kept
    ids may be as many as the nodes, so those joins are left to AQE, which
    broadcasts a measured-small side and splits a hub node's partition.
    """
    matched = names_spec(F.col("attributes"), spec_token)
    direct = nodes.filter(matched).select("node_id", F.lit(True).alias("direct"))
    provenance = edges.withColumn("provenance", matched)
    ends = (
        provenance.filter("provenance")
        .select(F.explode(F.array("source", "target")).alias("node_id"))
        .filter(F.col("node_id") != "")
        .withColumn("direct", F.lit(False))
    )
    retained = direct.unionByName(ends).groupBy("node_id").agg(F.max("direct").alias("direct"))

    ids = retained.select("node_id")
    kept_nodes = nodes.join(ids, "node_id", "left_semi")
    if include_contextual_edges:
        # Endpoints of matching edges are retained by construction, so the two
        # semi-joins only have to look at the other edges.
        other = provenance.filter(~F.col("provenance"))
        for end in ("source", "target"):
            other = other.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
        kept_edges = provenance.filter("provenance").unionByName(other)
    else:
        kept_edges = provenance.filter("provenance")
    return SubgraphExport(kept_nodes, kept_edges, retained)
