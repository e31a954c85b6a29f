"""Session defaults and the few physical-plan helpers the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bounds under which a side may be broadcast: rows, and bytes of their JSON form.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# A larger side is known by bits, so many a row and at most so many in all (16 MB), sent in pieces of so many words.
MEMBER_BITS = 16
MOST_BITS = 1 << 27
_WORDS = 1 << 12

# Spark inserts a map-side WindowGroupLimit only for ranks below this default.
_GROUP_LIMIT_THRESHOLD = 1000
_TOP_K_SALTS = 64


def build_session(app_name: str = "clauseweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with adaptive execution, skew handling and UTC time."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A session on one machine (unit tests, a laptop) that names none gets a
    temporary one; a cluster must name it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="clauseweave-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside free their shuffle files when they are done, for steps that materialize what they hand on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, *, name: str, codec: str = "snappy") -> DataFrame:
    """Keep a large relation that is read many times as Parquet in the shared folder: a fraction of a checkpoint's size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Measure (never guess) whether a relation is within both bounds, rows and bytes."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (total or 0) <= BROADCAST_BYTES


def number_ordered(ordered: DataFrame, name: str) -> DataFrame:
    """Number the rows of a sorted relation from 1, without gathering them.

    The sorted partitions are counted, and each row adds its place in its own
    to the rows of those before it.
    """
    placed = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(broadcast_within(offsets), part == F.col("_part"))
    return numbered.select(*ordered.columns, (F.col("_before") + place + 1).alias(name))


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a relation proven small; otherwise leave the shuffle join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def _maybe_among(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is one of ``members``, and a few others; no shuffle of ``df``.

    Of all members the bits at their hashes are broadcast, of two that share a bit one would do.
    """
    spark = members.sparkSession
    bits = 64 * _WORDS
    while bits < min(MOST_BITS, MEMBER_BITS * members.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    set_bits = members.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("word").agg(
        F.expr("bit_or(shiftleft(one, bit))").alias("bits")
    )
    found = set_bits.toArrow()  # at most MOST_BITS / 64 words
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    ends = pa.array(np.arange(0, len(words) + 1, _WORDS, dtype=np.int32))
    pieces = pa.table({"_piece": pa.array(np.arange(len(words) // _WORDS, dtype=np.int32)), "_words": pa.ListArray.from_arrays(ends, pa.array(words))})
    sent = F.broadcast(spark.createDataFrame(pieces))
    inside = F.getbit(F.get("_words", word % _WORDS), bit) == 1
    return df.join(sent, (F.floor(word / _WORDS).cast("int") == F.col("_piece")) & inside, "left_semi")


def among(df: DataFrame, *sides: DataFrame, roughly: bool = False) -> DataFrame:
    """The rows of ``df`` whose columns are in the one column of each of ``sides``, which have its name.

    Sides within the bounds are broadcast.  By larger ones ``df`` is first cut with their hash
    bits, so only rows that nearly all belong are shuffled; with ``roughly`` nothing is, and a few others stay.
    """
    large = []
    for side in sides:
        (column,) = side.columns
        if fits_broadcast(side):
            df = df.join(F.broadcast(side), column, "left_semi")
        else:
            df = _maybe_among(df, side, column)
            large.append(side)
    for side in [] if roughly else large:
        df = df.join(side, side.columns, "left_semi")
    return df


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows of every group and number them from 1.

    Small ``k`` compiles to a map-side group limit, so a group holding most of
    the rows ships at most ``k`` of them per task.  For large ``k`` the same
    pre-cut is made on a salt of the row; the global top-k is always contained
    in the union of the salted ones, so the result is exact either way.
    """
    if k >= _GROUP_LIMIT_THRESHOLD:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_TOP_K_SALTS))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_salt_rank", F.row_number().over(salted))
            .filter(F.col("_salt_rank") <= k)
            .drop("_salt", "_salt_rank")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
