"""Vectors that can take part in a search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): non-zero finite vectors in double precision.

    Left out are vectors that are null or hold a null or non-finite component, zero and empty vectors and
    rows without an id; rows with the same id all stay.  Vectors whose largest component is far from 1
    are multiplied by a power of two, which leaves cosines as they are, so that squares stay finite.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.filter(F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & finite & F.exists(x, lambda c: c != 0)).select(
        F.col(vec_id).cast("long").alias("vec_id"), x.alias("v")
    )
    most = F.array_max(F.transform("v", F.abs))
    power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(most))))
    scaled = F.transform("v", lambda c: c * F.pow(F.lit(2.0), power))
    return rows.withColumn("v", F.when(most.between(1e-100, 1e100), F.col("v")).otherwise(scaled))


def of_each_length(vectors: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over the rows of each length of (row, vec_id, v), its results together.

    Vectors are compared with those of their own length; a table has one length or a few.
    """
    lengths = [r.n for r in vectors.select(F.size("v").alias("n")).groupBy("n").count().orderBy("n").collect()]
    return reduce(DataFrame.union, [search(vectors.filter(F.size("v") == n) if len(lengths) > 1 else vectors) for n in lengths or [0]])
