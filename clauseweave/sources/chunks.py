"""JSON-lines chunk corpus: validating reader and ordered writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schema import CHUNK, CHUNK_OPTIONAL, CHUNK_REQUIRED
from .ordinal import with_ordinal


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse ``lines(value, ...)`` into the chunk columns plus ``problem`` (or null)."""
    keys = F.json_object_keys("value")
    missing = F.filter(
        F.array(*[F.lit(k) for k in CHUNK_REQUIRED]), lambda k: ~F.array_contains(keys, k)
    )
    row = F.from_json("value", CHUNK, {"mode": "PERMISSIVE"})
    problem = (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing key: "), F.array_join(missing, ", ")))
        .when(F.col("row.heading_path").isNull(), "heading_path is not a list")
        .when(F.col("row.text").isNull(), "text is not a string")
        .when(F.col("row.chunk_id").isNull(), "chunk_id is not a string")
    )
    rest = [c for c in lines.columns if c != "value"]
    return (
        lines.withColumn("row", row)
        .withColumn("problem", problem)
        .select(*rest, "problem", *[f"row.{c}" for c in CHUNK.fieldNames()])
    )


def read_chunks(spark: SparkSession, path: str, *, validate: bool = True) -> DataFrame:
    """Chunks with ``chunk_seq`` in file order; blank texts are dropped.

    Malformed rows fail the read with ``path:line``.  Ids repeated after a
    non-blank row fail it too; that check is one aggregation over the ids.
    Without ``validate`` malformed rows are returned, too: what is wrong is in
    their column ``problem``, which is null for all others.
    """
    raw = spark.read.text(path)
    lines = with_ordinal(raw, "chunk_seq", ["value"]).filter(~is_blank(F.col("value")))
    parsed = parse_lines(lines)
    if validate:
        parsed = parsed.withColumn("chunk_id", _fail_if_problem())
        clash = duplicate_ids(parsed).first()
        if clash is not None:
            raise ValueError(f"duplicate chunk_id at {clash['at']}: {clash['chunk_id']}")
        return parsed.filter(~is_blank(F.col("text"))).select("chunk_seq", *CHUNK.fieldNames())
    sound = ~is_blank(F.coalesce("text", F.lit("")))
    return parsed.filter(F.col("problem").isNotNull() | sound).select("chunk_seq", *CHUNK.fieldNames(), "problem")


def _fail_if_problem() -> Column:
    place = F.concat_ws(":", "_path", F.col("chunk_seq").cast("string"))
    message = F.concat(F.lit("invalid chunk at "), place, F.lit(": "), F.col("problem"))
    return F.when(F.col("problem").isNotNull(), F.raise_error(message)).otherwise(F.col("chunk_id"))


def duplicate_ids(parsed: DataFrame) -> DataFrame:
    """(chunk_id, at) of ids that occur again after their first non-blank row."""
    first_kept = F.min(F.when(~is_blank(F.col("text")), F.col("chunk_seq")))
    last = F.max_by(F.concat_ws(":", "_path", F.col("chunk_seq").cast("string")), "chunk_seq")
    grouped = parsed.groupBy("chunk_id").agg(
        first_kept.alias("first_kept"), F.max("chunk_seq").alias("last"), last.alias("at")
    )
    return grouped.filter(F.col("last") > F.col("first_kept")).select("chunk_id", "at")


def write_chunks(chunks: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in corpus order, nulls and non-ASCII text kept.

    Rows are range-partitioned, so the part files read in name order are the
    corpus in order; no task sees more than its range.
    """
    columns = [c for c in (*CHUNK_REQUIRED, *CHUNK_OPTIONAL) if c in chunks.columns]
    ordered = chunks.orderBy(*order).select(*[c for c in CHUNK.fieldNames() if c in columns])
    ordered.write.option("ignoreNullFields", "false").json(path)
