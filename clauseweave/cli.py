"""Command line: each command is one DataFrame job with a JSON result."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .assistant.loop import ToolLoop
from .assistant.tools import SpecTools, labelled_paths
from .config import Settings, create_client
from .functions import sections as S
from .functions.text import excerpt
from .operators import align as A
from .operators import graph_audit, graph_query
from .operators import ingest as I
from .operators.bm25 import Bm25Index, attach_chunks
from .operators.evaluate import evaluate_bm25
from .operators.fusion import reciprocal_rank_fusion
from .operators.graph_build import SpecGraph
from .operators.graph_export import export_subgraph
from .operators.vector import embed_chunks, vector_search
from .session import build_session
from .sources import graphml
from .sources.chunks import read_chunks, write_chunks
from .sources.docx import read_docx
from .sources.records import read_alignments, read_questions, write_alignments, write_vectors

DEFAULT_EMBEDDER = "sentence-transformers/all-MiniLM-L6-v2"
Command = Callable[[SparkSession, argparse.Namespace], Any]
_COMMANDS: dict[str, tuple[Command, list[tuple[tuple[str, ...], dict]]]] = {}


def option(*names: str, **settings: Any) -> tuple[tuple[str, ...], dict]:
    return names, settings


def command(name: str, *options: tuple[tuple[str, ...], dict]) -> Callable[[Command], Command]:
    def register(function: Command) -> Command:
        _COMMANDS[name] = (function, list(options))
        return function

    return register


_GRAPH = option("--graph", required=True)
_CHUNKS = option("--chunks", required=True)
_INDEX = option("--index", help="folder of a stored index; written on first use")
_OUTPUT = option("--output", required=True)
_REPORT = option("--output")
_SHOWN = option("--max-text-chars", type=int, default=700)


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict(recursive=True)


def _report(value: Any, path: str | None) -> Any:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(_render(value) + "\n", encoding="utf-8")
    return value


def _render(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=str)


def _absolute(path: str) -> str:
    return path if "://" in path else str(Path(path).resolve())


@command(
    "audit-graph",
    _GRAPH,
    option("--spec-token", default=S.DEFAULT_SPEC_TOKEN),
    option("--source-token", default=S.DEFAULT_SOURCE_TOKEN),
    _REPORT,
)
def audit_graph(spark, args):
    """Profile a GraphML file and its coverage of one specification."""
    graph = graphml.read_graphml(spark, args.graph)
    counts = graph_audit.audit_counts(
        graph.nodes, graph.edges, spec_token=args.spec_token, source_token=args.source_token
    ).persist()
    listed = lambda metric: {
        r["key"]: r["n"] for r in graph_audit.histogram(counts, metric).collect()
    }
    totals = _one(graph_audit.audit_summary(counts))
    return _report(
        {
            "path": _absolute(args.graph),
            "file_size_bytes": graph.size_bytes,
            "directed": graph.directed,
            "nodes": totals["nodes"],
            "edges": totals["edges"],
            "self_loops": totals["self_loops"],
            "node_attribute_coverage": listed("node_attribute"),
            "edge_attribute_coverage": listed("edge_attribute"),
            "entity_types": listed("entity_type"),
            "relation_keywords": listed("relation"),
            "matching_spec_nodes": totals["matching_spec_nodes"],
            "matching_spec_edges": totals["matching_spec_edges"],
            "matching_spec_sections": [
                r["section"] for r in graph_audit.covered_sections(counts).collect()
            ],
            "matching_spec_source_tokens": sorted(listed("source_token")),
        },
        args.output,
    )


@command("export-subgraph", _GRAPH, option("--spec-token", default=S.DEFAULT_SPEC_TOKEN), _OUTPUT)
def export(spark, args):
    """Keep the elements with one specification's provenance."""
    graph = graphml.read_graphml(spark, args.graph)
    kept = export_subgraph(graph.nodes, graph.edges, spec_token=args.spec_token)
    keys = lambda df: tuple(
        sorted(r[0] for r in df.select(F.explode(F.map_keys("attributes"))).distinct().collect())
    )
    graphml.write_graphml(
        kept.nodes,
        kept.edges,
        args.output,
        graph_id=f"ts-{args.spec_token}-provenance-subgraph",
        node_keys=keys(graph.nodes),
        edge_keys=keys(graph.edges),
        node_order="node_seq",
        edge_order="edge_seq",
        edge_default=graph.edge_default,
    )
    return {
        "source_path": _absolute(args.graph),
        "output_path": _absolute(args.output),
        "spec_token": args.spec_token,
        **_one(kept.counters()),
    }


@command("build-graph", _CHUNKS, _OUTPUT)
def build_graph(spark, args):
    """Derive the property graph of a chunk corpus."""
    graph = SpecGraph(read_chunks(spark, args.chunks))
    nodes, edges = graph.as_property_graph()
    graphml.write_graphml(
        nodes, edges, args.output, graph_id="ts-24501-document-built-graph"
    )
    return {"output_path": _absolute(args.output), **_one(graph.counters())}


@command(
    "ingest-spec",
    option("--source", required=True),
    _OUTPUT,
    option("--spec-id", default="3GPP TS 24.501"),
    option("--release", default="Rel-19"),
    option("--version", default="19.2.0"),
    option("--max-chars", type=int, default=I.DEFAULT_MAX_CHARS),
)
def ingest_spec(spark, args):
    """Chunk a DOCX specification into JSON lines."""
    documents = read_docx(spark, args.source)
    chunks = I.chunk_documents(
        documents,
        spec_id=args.spec_id,
        release=args.release,
        version=args.version,
        max_chars=args.max_chars,
    )
    write_chunks(chunks, args.output, ["doc", "chunk_no"])
    return {
        "source_path": _absolute(args.source),
        "output_path": _absolute(args.output),
        "source_sha256": documents.first()["sha256"],
        **_one(I.ingestion_summary(documents, chunks)),
    }


def _index(args, chunks) -> Bm25Index:
    """The index of the chunks: a stored one where a folder is named, which a later search then reads."""
    return Bm25Index.stored(chunks, args.index) if args.index else Bm25Index(chunks)


@command(
    "search-spec", option("query"), _CHUNKS, _INDEX, option("--top-k", type=int, default=5), option("--section"), _SHOWN
)
def search_spec(spark, args):
    """Rank chunks with BM25."""
    chunks = read_chunks(spark, args.chunks)
    hits = _index(args, chunks).search(args.query, top_k=args.top_k, section_prefix=args.section)
    rows = attach_chunks(hits, chunks).select(
        "rank",
        "chunk_id",
        "score",
        "matched_terms",
        "spec_id",
        "version",
        "section",
        "section_title",
        "page_start",
        "content_type",
        excerpt(F.col("text"), args.max_text_chars, ellipsis=True).alias("text"),
        "source_file",
    )
    return _ranked(rows, score="score")


def _ranked(rows: DataFrame, **rounded: str) -> list[dict[str, Any]]:
    found = []
    for row in sorted(rows.collect(), key=lambda r: r["rank"]):
        value = {k: v for k, v in row.asDict(recursive=True).items() if k != "rank"}
        for name in rounded.values():
            value[name] = round(value[name], 6)
        found.append(value)
    return found


def _match(nodes: DataFrame, found: dict[str, Any]) -> dict[str, Any]:
    attributes = nodes.filter(F.col("node_id") == found["node_id"]).first()["attributes"]
    return {
        "node_id": found["node_id"],
        "label": found["label"],
        "attributes": attributes,
        "score": round(found["score"], 6),
        "method": found["method"],
    }


def _edge(edge: Any) -> dict[str, Any]:
    names = ("edge_id", "source", "target", "relations", "attributes", "source_label", "target_label")
    return {name: edge[name] for name in names}


@command("resolve", option("query"), _GRAPH, option("--limit", type=int, default=10))
def resolve(spark, args):
    """Resolve a term to graph entities."""
    nodes = graphml.read_graphml(spark, args.graph).nodes
    found = graph_query.resolve_entities(nodes, args.query, limit=args.limit)
    return [_match(nodes, r.asDict()) for r in found.collect()]


@command("inspect", option("entity"), _GRAPH)
def inspect(spark, args):
    """Show one entity with its degrees."""
    graph = graphml.read_graphml(spark, args.graph)
    best = graph_query.best_entity(graph.nodes, args.entity)
    view = _one(graph_query.node_view(graph.nodes, graph.edges, best["node_id"]))
    return {**view, "resolution": {"score": best["score"], "method": best["method"]}}


@command(
    "neighbors",
    option("entity"),
    _GRAPH,
    option("--direction", choices=("in", "out", "both"), default="both"),
    option("--relation"),
    option("--limit", type=int, default=20),
)
def neighbors(spark, args):
    """List the relations around an entity."""
    graph = graphml.read_graphml(spark, args.graph)
    best = graph_query.best_entity(graph.nodes, args.entity)
    edges = graph_query.neighbors(
        graph.edges, best["node_id"], direction=args.direction, relation=args.relation, limit=args.limit
    )
    rows = graph_query.label_endpoints(edges, graph.nodes).collect()
    rows.sort(key=lambda e: (e["source"].casefold(), e["target"].casefold(), e["edge_id"]))
    return {"resolved_entity": _match(graph.nodes, best), "edges": [_edge(e) for e in rows]}


@command(
    "path",
    option("source"),
    option("target"),
    _GRAPH,
    option("--max-hops", type=int, default=3),
    option("--limit", type=int, default=5),
)
def path(spark, args):
    """Find bounded paths between two entities."""
    graph = graphml.read_graphml(spark, args.graph)
    ends = [graph_query.best_entity(graph.nodes, term) for term in (args.source, args.target)]
    paths = graph_query.find_paths(
        graph.edges, ends[0]["node_id"], ends[1]["node_id"], max_hops=args.max_hops, limit=args.limit
    )
    return {
        "source": _match(graph.nodes, ends[0]),
        "target": _match(graph.nodes, ends[1]),
        "paths": labelled_paths(paths, graph.nodes, graph.edges, _edge),
    }


@command("align", _GRAPH, _CHUNKS, _OUTPUT, option("--max-per-item", type=int, default=3))
def align(spark, args):
    """Align graph items with supporting chunks."""
    graph = graphml.read_graphml(spark, args.graph)
    rows = A.align(
        graph.nodes, graph.edges, read_chunks(spark, args.chunks), max_per_item=args.max_per_item
    )
    write_alignments(rows, args.output)
    stored = read_alignments(spark, args.output)
    return {
        "output_path": _absolute(args.output),
        "graph_nodes": graph.nodes.count(),
        "graph_edges": graph.edges.count(),
        **_one(A.alignment_summary(stored)),
    }


@command(
    "eval-retrieval",
    _CHUNKS,
    _INDEX,
    option("--questions", required=True),
    option("--top-k", type=int, default=5),
    _REPORT,
)
def eval_retrieval(spark, args):
    """Measure recall and MRR on section-labelled questions."""
    index = _index(args, read_chunks(spark, args.chunks))
    summary, results = evaluate_bm25(index, read_questions(spark, args.questions), top_k=args.top_k)
    rows = [r.asDict(recursive=True) for r in results.collect()]
    return _report({**_one(summary), "results": rows}, args.output)


def _sentence_embedder(model: str):
    def make():
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as error:
            raise RuntimeError("the 'sentence-transformers' package is needed to embed text") from error
        encoder = SentenceTransformer(model)
        return lambda texts: encoder.encode(texts, normalize_embeddings=True, show_progress_bar=False)

    return make


@command("build-vector", _CHUNKS, _OUTPUT, option("--model", default=DEFAULT_EMBEDDER))
def build_vector(spark, args):
    """Embed the chunks and store the vectors."""
    embedded = embed_chunks(read_chunks(spark, args.chunks), _sentence_embedder(args.model))
    write_vectors(embedded.select("chunk_seq", "chunk_id", "embedding"), args.output)
    stored = spark.read.parquet(args.output)
    sizes = stored.agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size("embedding")).alias("dimensions"))
    return {"output": _absolute(args.output), "model": args.model, **_one(sizes)}


@command(
    "search-hybrid",
    option("query"),
    _CHUNKS,
    _INDEX,
    option("--vectors", required=True),
    option("--model", default=DEFAULT_EMBEDDER),
    option("--top-k", type=int, default=5),
    option("--candidate-k", type=int, default=20),
    _SHOWN,
)
def search_hybrid(spark, args):
    """Fuse lexical and dense rankings."""
    chunks = read_chunks(spark, args.chunks)
    vector = _sentence_embedder(args.model)()([args.query])[0]
    lexical = _index(args, chunks).search(args.query, top_k=args.candidate_k)
    dense = vector_search(spark.read.parquet(args.vectors), list(vector), top_k=args.candidate_k)
    fused = reciprocal_rank_fusion(lexical, dense, top_k=args.top_k)
    rows = chunks.join(F.broadcast(fused), "chunk_id").select(
        "rank",
        "chunk_id",
        F.col("score").alias("rrf_score"),
        "lexical_rank",
        "vector_rank",
        "section",
        "section_title",
        "page_start",
        excerpt(F.col("text"), args.max_text_chars, ellipsis=True).alias("text"),
    )
    return _ranked(rows, score="rrf_score")


@command(
    "ask",
    option("question"),
    _GRAPH,
    _CHUNKS,
    option("--alignments"),
    option("--json", action="store_true", dest="as_json"),
)
def ask(spark, args):
    """Answer a question with cited evidence."""
    settings = Settings.load()
    graph = graphml.read_graphml(spark, args.graph)
    known = args.alignments and (Path(args.alignments).exists() or "://" in args.alignments)
    tools = SpecTools(
        graph.nodes,
        graph.edges,
        read_chunks(spark, args.chunks),
        alignments=read_alignments(spark, args.alignments, ordinal="ordinal") if known else None,
    )
    loop = ToolLoop(
        create_client(settings), settings.model, tools, max_tool_calls=settings.max_tool_calls
    )
    result = loop.ask(args.question).to_dict()
    return result if args.as_json else f"{result['answer']}\n\nTool trace:\n{_render(result['trace'])}"


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="clauseweave", description=__doc__)
    parsers = parser.add_subparsers(dest="command", required=True)
    for name, (function, options) in _COMMANDS.items():
        sub = parsers.add_parser(name, help=function.__doc__)
        for names, settings in options:
            sub.add_argument(*names, **settings)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    result = _COMMANDS[args.command][0](spark or build_session(), args)
    print(result if isinstance(result, str) else _render(result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
