"""Row ordinals in file order, computed without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_within, materialize


def with_ordinal(raw: DataFrame, name: str, columns: list[str], per_file: bool = False) -> DataFrame:
    """Number the rows of a file-source DataFrame from 1 in file order.

    A row's place is (file, split start, position in the split).  Splits are
    counted first; their running totals (one row per split) are joined back.
    """
    placed = raw.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = placed.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first")
    )
    keys = ["_file"] if per_file else []
    before = Window.partitionBy(*keys).orderBy("_file", "_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    offsets = materialize(offsets.drop("_rows"))  # one row per split, read twice below
    joined = placed.join(broadcast_within(offsets), ["_file", "_start"])
    ordinal = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return joined.select(*columns, ordinal.cast("long").alias(name), F.col("_file").alias("_path"))
