"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The output is laid out as cells, equal slices of the shards that one task each can hold.
How many rows go from input partition p to cell c is drawn exactly (multivariate
hypergeometric), the rows of p are dealt to the cells in a random order, exchanged,
and permuted again inside their cell.  Every arrangement of the rows is equally likely
and every shard's size is exact.

No task or driver holds the whole matrix.  A task draws its own line of it by walking
down a seeded binary tree over the partitions: at each node the cells' open places are
split between the left and the right half of the partitions.  The same seed gives the
same split in every task and in every retry.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import row_of, unpacked

CELL_ROWS = 50_000
_DEALT = [
    StructField("cell", IntegerType()),
    StructField("place", LongType()),
    StructField("p", IntegerType()),
    StructField("at", LongType()),
]


def cell_sizes(rows: int, shards: int, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Places of each cell, shard by shard: shards differ by one row at most, and so do cells of a shard."""
    cells = max(1, -(-rows // (shards * cell_rows)))
    sizes = np.full(shards, rows // shards, dtype=np.int64)
    sizes[: rows % shards] += 1
    out = np.repeat((sizes // cells)[:, None], cells, axis=1)
    out += np.arange(cells)[None] < (sizes % cells)[:, None]
    return out.ravel()


def matrix_line(counts: np.ndarray, places: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """How many rows of ``partition`` go to each cell: one line of the matrix.

    ``counts`` are the rows of each partition, ``places`` the sizes of the cells; both
    have the same sum.  Costs O(cells * log partitions) draws.
    """
    sums = np.concatenate([[0], np.cumsum(counts)])
    low, high, open_ = 0, len(counts), places.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        left = _split(open_, int(sums[middle] - sums[low]), draw)
        low, high, open_ = (low, middle, left) if partition < middle else (middle, high, open_ - left)
    return open_


def _split(places: np.ndarray, rows: int, draw: np.random.Generator) -> np.ndarray:
    """Draws ``rows`` of the places without replacement, counted by cell."""
    out, rest = np.zeros_like(places), int(places.sum())
    for c, here in enumerate(places):
        if rows <= 0:
            break
        rest -= int(here)
        out[c] = _hypergeometric(int(here), rest, rows, draw)
        rows -= int(out[c])
    return out


def _hypergeometric(good: int, bad: int, draws: int, draw: np.random.Generator) -> int:
    """One hypergeometric draw; numpy's takes populations below 10**9 only, larger ones go by ratio of uniforms."""
    if good == 0 or bad == 0:
        return min(good, draws)
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, draws))
    few, many, everything = min(good, bad), max(good, bad), good + bad
    sample = min(draws, everything - draws)
    share = few / everything
    middle = sample * share + 0.5
    spread = math.sqrt((everything - sample) * sample * share * (1 - share) / (everything - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (sample + 1) * (few + 1) // (everything + 2)

    def log_ways(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, few - k, sample - k, many - sample + k))

    top = log_ways(mode)
    while True:
        u, v = 1.0 - draw.random(), draw.random()
        k = math.floor(middle + width * (v - 0.5) / u)
        if 0 <= k <= min(sample, few) and 2 * math.log(u) <= log_ways(k) - top:
            break
    if good > bad:
        k = sample - k
    return k if sample == draws else good - k


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All rows of ``docs`` in a uniformly random arrangement: its columns, ``shard`` and ``slot``.

    Shards 0 to ``shards - 1`` differ by one row at most; ``slot`` numbers a shard's rows
    from 0 without gaps.  The two passes over ``docs`` must see the same partitions (a scan
    of files, a checkpoint); a task that finds another number of rows fails rather than
    give a wrong shard.  Whole rows are exchanged once.

    Defined cases: rows are never looked into, so nulls, empty and very long texts, ties and
    repeated rows are rows like any other; an empty table gives an empty result; input columns
    named shard or slot are replaced, other names cannot clash.
    """
    spark = docs.sparkSession
    packed = docs.select(row_of(docs).alias("row"))
    found = packed.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one small row per partition
    counts = np.zeros(max([0, *(r.p + 1 for r in found)]), dtype=np.int64)
    for r in found:
        counts[r.p] = r["count"]
    places = cell_sizes(int(counts.sum()), shards, cell_rows)
    shared = spark.sparkContext.broadcast((counts, places))

    def dealt(batches):
        rows, open_ = shared.value
        here = TaskContext.get().partitionId()
        known = here < len(rows)
        line = matrix_line(rows, open_, here, seed) if known else np.zeros_like(open_)
        draw = np.random.default_rng([seed, here])
        to = draw.permutation(np.repeat(np.arange(len(line), dtype=np.int32), line))
        done = 0
        for batch in batches:
            part = to[done : done + batch.num_rows]
            if len(part) < batch.num_rows:
                raise RuntimeError("the input's partitions changed between the passes")
            place = draw.integers(0, 1 << 62, batch.num_rows)
            at = np.arange(done, done + batch.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(part), pa.array(place), pa.array(np.full(len(at), here, dtype=np.int32)), pa.array(at)],
                names=["row", "cell", "place", "p", "at"],
            )
            done += batch.num_rows
        if done != len(to):
            raise RuntimeError("the input's partitions changed between the passes")

    schema = StructType([packed.schema["row"], *_DEALT])
    per_shard = len(places) // shards
    before = spark.createDataFrame(
        [(c, int(places[c // per_shard * per_shard : c].sum())) for c in range(len(places))], "cell int, before long"
    )
    inside = Window.partitionBy("cell").orderBy("place", "p", "at")
    out = packed.mapInArrow(dealt, schema).withColumn("local", F.row_number().over(inside) - 1).join(F.broadcast(before), "cell")
    return out.select(
        *unpacked(docs, "row", ["shard", "slot"]),
        F.floor(F.col("cell") / per_shard).cast("int").alias("shard"),
        (F.col("before") + F.col("local")).cast("long").alias("slot"),
    )
