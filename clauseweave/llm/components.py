"""Connected components of a link table: forests of bounded blocks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Hashable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, reliable


# links whose forest one task finds (some tens of MB); more are dealt over tasks
BLOCK = 1 << 18


def forest(links: Iterable[tuple[Hashable, Hashable]]) -> dict[Hashable, Hashable]:
    """The smallest node of its component for every node of ``links``."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _forests(links: DataFrame) -> DataFrame:
    """(node, component) within blocks of up to ``BLOCK`` links (u, v) of a task; every node of a block has a row."""
    kind = links.schema["u"].dataType
    schema = StructType([StructField("node", kind), StructField("component", kind)])
    # a struct of columns counts by its first, then by the next ones
    names = kind.names if isinstance(kind, StructType) else None
    plain = (lambda x: tuple(x[n] for n in names)) if names else (lambda x: x)
    value = (lambda x: dict(zip(names, x, strict=True))) if names else (lambda x: x)

    size = BLOCK

    def stars(block: list, arrow: pa.DataType) -> pa.RecordBatch:
        found = forest(block)
        columns = ([value(x) for x in found], [value(x) for x in found.values()])
        return pa.RecordBatch.from_arrays([pa.array(c, arrow) for c in columns], names=["node", "component"])

    def within(batches):
        block: list = []
        for batch in batches:
            u, v = (map(plain, batch.column(n).to_pylist()) for n in (0, 1))
            for link in zip(u, v, strict=True):
                block.append(link)
                if len(block) == size:
                    yield stars(block, batch.column(0).type)
                    block = []
        if block:
            yield stars(block, batch.column(0).type)

    return links.mapInArrow(within, schema)


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Up to ``BLOCK`` links are a forest that one task finds.  Of more, each task hands on the stars of
    its blocks, which steps of all tasks connect.  Each step is an aggregation and a join on a node; a node with very many links is
    pre-aggregated in the one and split by adaptive execution in the other.  Steps needed grow
    with the logarithm of the longest path; a set of stars is done after two.
    """
    rows = reliable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v"))
    tasks = -(-rows.count() // BLOCK)
    stars = _forests(rows.coalesce(max(1, tasks)))
    if tasks <= 1:
        return stars
    edges = reliable(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u > v").distinct())
    discard(rows)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # every node now points to smaller ones only
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        last, edges = edges, reliable(small.filter("u > v").distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
