"""Record types shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

# Columns every chunk row must carry; the two page columns may be absent.
CHUNK_REQUIRED = (
    "chunk_id",
    "spec_id",
    "release",
    "version",
    "section",
    "section_title",
    "heading_path",
    "content_type",
    "text",
    "source_file",
)
CHUNK_OPTIONAL = ("page_start", "page_end")

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", _S),
        T.StructField("spec_id", _S),
        T.StructField("release", _S),
        T.StructField("version", _S),
        T.StructField("section", _S),
        T.StructField("section_title", _S),
        T.StructField("heading_path", T.ArrayType(_S)),
        T.StructField("page_start", T.IntegerType()),
        T.StructField("page_end", T.IntegerType()),
        T.StructField("content_type", _S),
        T.StructField("text", _S),
        T.StructField("source_file", _S),
    ]
)

ALIGNMENT = T.StructType(
    [
        T.StructField("graph_item_id", _S),
        T.StructField("graph_item_type", _S),
        T.StructField("chunk_id", _S),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("confidence_label", _S),
        T.StructField("match_methods", T.ArrayType(_S)),
        T.StructField("component_scores", T.MapType(_S, T.DoubleType())),
        T.StructField("review_status", _S),
    ]
)

QUESTION = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("question", _S),
        T.StructField("required_sections", T.ArrayType(_S)),
    ]
)

ARTIFACT = T.StructType(
    [
        T.StructField(name, _S)
        for name in (
            "artifact_id",
            "kind",
            "source_url",
            "local_path",
            "sha256",
            "retrieved_at",
            "publisher",
            "license",
            "spec_id",
            "release",
            "version",
        )
    ]
)

# One paragraph or table of a document; ``raw`` keeps the tabs of a contents line.
BLOCK = T.StructType(
    [
        T.StructField("kind", _S),
        T.StructField("text", _S),
        T.StructField("style", _S),
        T.StructField("raw", _S),
    ]
)

NODES = T.StructType(
    [
        T.StructField("node_id", _S),
        T.StructField("node_seq", T.LongType()),
        T.StructField("attributes", T.MapType(_S, _S)),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("edge_id", _S),
        T.StructField("source", _S),
        T.StructField("target", _S),
        T.StructField("edge_seq", T.LongType()),
        T.StructField("attributes", T.MapType(_S, _S)),
    ]
)
