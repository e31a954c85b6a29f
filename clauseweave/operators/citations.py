"""Citation validation: every cited chunk must have been returned by a tool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cited_chunk_ids
from ..session import materialize


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, position, chunk_id) in order of first citation."""
    cited = answers.select("answer_id", cited_chunk_ids(F.col("answer")).alias("ids"))
    return cited.select("answer_id", F.posexplode("ids").alias("position", "chunk_id"))


def unsupported_citations(answers: DataFrame, observed: DataFrame) -> DataFrame:
    """Citations without a matching row in ``observed(answer_id, chunk_id)``."""
    return citations(answers).join(observed, ["answer_id", "chunk_id"], "left_anti")


def harvested_ids(results: DataFrame, column: str = "result", name: str = "chunk_id") -> DataFrame:
    """(answer_id, chunk_id): every string under the key ``name`` in stored JSON results, at any depth.

    ``results`` is (answer_id, result), a JSON text each.  Each round opens one level of what
    is still nested, so there are as many rounds as the deepest result has levels.  Text that
    is no JSON holds none, and neither does a value that is no string; ids are distinct.
    """
    spark = results.sparkSession
    level = results.select("answer_id", F.try_parse_json(F.col(column)).alias("inner"))
    found = []
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("inner").outer())).select("answer_id", "key", "value")
        kind = F.schema_of_variant("value")
        opened = materialize(opened.filter(F.col("value").isNotNull()).withColumn("kind", F.regexp_extract(kind, "^[A-Z]+", 0)))
        named = opened.filter((F.col("key") == name) & (F.col("kind") == "STRING"))
        found.append(named.select("answer_id", F.variant_get("value", "$", "string").alias("chunk_id")))
        level = opened.filter(F.col("kind").isin("OBJECT", "ARRAY")).select("answer_id", F.col("value").alias("inner"))
        if level.isEmpty():
            return reduce(DataFrame.union, found).distinct()
