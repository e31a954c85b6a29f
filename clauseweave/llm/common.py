"""What the operators share: tables, reliable checkpoints, rows kept whole under one column."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words is the space and the bytes 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder that all executors share.

    The folder is the one the session names in ``spark.checkpoint.dir``; only a
    session on one machine without one (a unit test) gets its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return df.checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 32) -> AbstractContextManager[None]:
    """While rows that repeat long texts go to Python, an Arrow batch holds few of them.

    Only for work that is done inside, such as a checkpoint; the session gets its setting back.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs run inside free their shuffle files when they are done, for steps that checkpoint what they hand on."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(*frames: DataFrame) -> None:
    """Delete the checkpoints (of :func:`reliable`) that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_of(df: DataFrame) -> Column:
    """The whole input row as one struct, so that no helper column can clash with its names."""
    return F.struct(*[df[f"`{c.replace('`', '``')}`"] for c in df.columns])


def unpacked(schema_of: DataFrame, row: str, replaced: Iterable[str]) -> list[Column]:
    """The input columns out of ``row``, without those that the operator's own columns replace."""
    gone = {c.lower() for c in replaced}
    return [F.col(row)[c].alias(c) for c in schema_of.columns if c.lower() not in gone]


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    inner = F.trim(squeezed)
    return F.when(inner == "", F.lit(0)).otherwise(
        F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1
    ).cast("long")
