"""The registered queries: every operator over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sections as S
from ..functions.numeric import l2_normalize
from ..functions.text import excerpt
from ..operators import align as A
from ..operators import citations as C
from ..operators import evaluate as E
from ..operators import graph_audit, graph_query
from ..operators import ingest as I
from ..operators.bm25 import Bm25Index, attach_chunks
from ..operators.fusion import reciprocal_rank_fusion
from ..operators.graph_build import SpecGraph
from ..operators.graph_export import export_subgraph
from ..operators.vector import vector_search
from ..session import freed_shuffles, number_ordered, shared_folder, stored
from ..sources import graphml
from ..sources.chunks import duplicate_ids, parse_lines
from ..sources.records import read_alignments, write_alignments
from . import adapters

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SEARCH_TEXT = "Licensed under the Apache License with the and of schen"
ENTITY_TEXT = "red widget"
PATH_ENDS = ("customer:10", "supplier:5")
REGION_ENDS = ("region:0", "region:1")
HUB = "nation:3"
PACK_CHARS = 500


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _six(column: str | Column) -> Column:
    return F.round(column, 6)


def _joined(column: str | Column, by: str = "|") -> Column:
    return F.array_join(column, by)


# -- lexical retrieval --------------------------------------------------------


@query
def bm25_postings(spark, sf):
    return Bm25Index(adapters.chunks(spark, sf)).postings().select("chunk_id", "term", "tf")


@query
def bm25_doc_len(spark, sf):
    return Bm25Index(adapters.chunks(spark, sf)).doc_lengths().select("chunk_id", "doc_len")


@query
def bm25_stats(spark, sf):
    stats = Bm25Index(adapters.chunks(spark, sf)).stats()
    return stats.select("n", _six("avg_len").alias("avg_len"))


@query
def bm25_idf(spark, sf):
    idf = Bm25Index(adapters.chunks(spark, sf)).idf()
    return idf.select("term", "df", _six("idf").alias("idf"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("rank", "chunk_id", "section", _six("score").alias("score"))


@query
def bm25_topk(spark, sf):
    return _hits(Bm25Index(adapters.chunks(spark, sf)).search(SEARCH_TEXT, top_k=20))


@query
def bm25_stored_topk(spark, sf):
    """The same search over an index written to the shared folder in two parts and read by term."""
    path = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    chunks = adapters.chunks(spark, sf)
    odd = F.col("chunk_seq") % 2 == 1
    for part in (chunks.filter(odd), chunks.filter(~odd)):
        Bm25Index(part).save(path)
    return _hits(Bm25Index.load(spark, path).search(SEARCH_TEXT, top_k=20))


@query
def bm25_section_filter(spark, sf):
    index = Bm25Index(adapters.chunks(spark, sf))
    return _hits(index.search(SEARCH_TEXT, top_k=20, section_prefix="4"))


@query
def bm25_type_filter(spark, sf):
    index = Bm25Index(adapters.chunks(spark, sf))
    return _hits(index.search(SEARCH_TEXT, top_k=20, content_types=["de", "fr"]))


@query
def bm25_matched_terms(spark, sf):
    hits = Bm25Index(adapters.chunks(spark, sf)).search(SEARCH_TEXT, top_k=20)
    return hits.select("rank", "chunk_id", _joined("matched_terms").alias("matched_terms"))


@query
def bm25_search_many(spark, sf):
    queries = adapters.questions(spark, sf).select(
        F.col("id").alias("query_id"), F.col("question").alias("query")
    )
    hits = Bm25Index(adapters.chunks(spark, sf)).search_many(queries, top_k=10)
    return hits.select(
        "query_id",
        "rank",
        "chunk_id",
        "section",
        _six("score").alias("score"),
        _joined("matched_terms").alias("matched_terms"),
    )


@query
def excerpt_projection(spark, sf):
    chunks = adapters.chunks(spark, sf)
    hits = Bm25Index(chunks).search(SEARCH_TEXT, top_k=20)
    return attach_chunks(hits, chunks).select(
        "rank",
        "chunk_id",
        "section_title",
        excerpt(F.col("text"), 1600).alias("excerpt"),
        excerpt(F.col("text"), 700, ellipsis=True).alias("display"),
    )


# -- evaluation ---------------------------------------------------------------


@query
def eval_per_question(spark, sf):
    index = Bm25Index(adapters.chunks(spark, sf))
    _, results = E.evaluate_bm25(index, adapters.questions(spark, sf), top_k=5)
    return results.select(
        "id",
        _joined("required_sections").alias("required_sections"),
        _joined("retrieved_sections").alias("retrieved_sections"),
        "first_relevant_rank",
        "passed",
    )


@query
def eval_recall_mrr(spark, sf):
    index = Bm25Index(adapters.chunks(spark, sf))
    summary, _ = E.evaluate_bm25(index, adapters.questions(spark, sf), top_k=5)
    return summary


# -- dense retrieval and fusion -----------------------------------------------


@query
def vector_normalize(spark, sf):
    unit = adapters.vectors(spark, sf).select(
        "chunk_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "value")
    )
    return unit.select("chunk_id", "pos", F.round("value", 5).alias("value"))


@query
def vector_topk(spark, sf):
    hits = vector_search(adapters.vectors(spark, sf), adapters.query_vector(spark, sf), top_k=20)
    return hits.select("rank", "chunk_id", _six("score").alias("score"))


@query
def rrf_fusion(spark, sf):
    lexical = Bm25Index(adapters.chunks(spark, sf)).search(SEARCH_TEXT, top_k=20)
    vector = vector_search(adapters.vectors(spark, sf), adapters.query_vector(spark, sf), top_k=20)
    fused = reciprocal_rank_fusion(lexical, vector, top_k=10)
    return fused.select("rank", "chunk_id", _six("score").alias("score"), "lexical_rank", "vector_rank")


# -- graph construction -------------------------------------------------------


def _graph(spark, sf) -> SpecGraph:
    return SpecGraph(adapters.chunks(spark, sf), reference_pattern=adapters.LICENSE_PATTERN)


@query
def graph_nodes(spark, sf):
    return _graph(spark, sf).nodes().drop("seq")


@query
def graph_edges(spark, sf):
    return _graph(spark, sf).edges().drop("seq", "relation")


@query
def graph_round_trip(spark, sf):
    """The spec graph written as GraphML and read again: elements in file order with their attributes."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    graphml.write_graphml(*_graph(spark, sf).as_property_graph(), path, graph_id="documents")
    back = graphml.read_graphml(spark, path)
    value = lambda name: F.try_element_at("attributes", F.lit(name)).alias(name)
    none = F.lit(None).cast("string")
    nodes = back.nodes.select(
        F.lit("node").alias("kind"), F.col("node_seq").alias("seq"), F.col("node_id").alias("id"),
        none.alias("source"), none.alias("target"), value("entity_id"), none.alias("keywords"), value("section"), value("char_start"),
    )
    edges = back.edges.select(
        F.lit("edge").alias("kind"), F.col("edge_seq").alias("seq"), F.col("edge_id").alias("id"),
        "source", "target", none.alias("entity_id"), value("keywords"), value("section"), value("char_start"),
    )
    return nodes.unionByName(edges)


@query
def graph_whitelist(spark, sf):
    proposals = _graph(spark, sf).edge_proposals()
    kind = F.get(F.split("source", ":"), F.lit(0))
    return proposals.groupBy(kind.alias("source_kind"), F.col("keywords").alias("relation"), "legal").agg(
        F.count(F.lit(1)).alias("proposals")
    )


@query
def graph_build_counts(spark, sf):
    return _graph(spark, sf).counters()


# -- graph queries ------------------------------------------------------------


def _edge_rows(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("edge_id", "source", "target", _joined("relations").alias("relations"), *more)


@query
def neighbors_both(spark, sf):
    _, edges = adapters.trade_graph(spark, sf)
    return _edge_rows(graph_query.neighbors(edges, HUB, limit=50))


@query
def neighbors_relation(spark, sf):
    _, edges = adapters.trade_graph(spark, sf)
    return _edge_rows(
        graph_query.neighbors(edges, HUB, direction="in", relation="based_in", limit=50)
    )


@query
def edge_labels(spark, sf):
    nodes, edges = adapters.trade_graph(spark, sf)
    found = graph_query.neighbors(edges, HUB, limit=50)
    return _edge_rows(graph_query.label_endpoints(found, nodes), "source_label", "target_label")


@query
def node_degree(spark, sf):
    return graph_query.degrees(*adapters.trade_graph(spark, sf))


@query
def node_inspect(spark, sf):
    nodes, edges = adapters.trade_graph(spark, sf)
    return graph_query.node_view(nodes, edges, HUB).drop("attributes")


def _trade_edges(spark, sf) -> DataFrame:
    """The edges of the trade graph as paths need them: derived, and read once per hop."""
    edges = adapters.trade_graph(spark, sf)[1]
    with freed_shuffles(spark):
        return stored(edges.select("edge_id", "source", "target", "edge_seq"), name="edges", codec="zstd")


def _path_rows(paths: DataFrame) -> DataFrame:
    return paths.select(
        "rank", "hops", _joined(F.transform("path", lambda e: e["edge_id"])).alias("path")
    )


@query
def paths_undirected(spark, sf):
    edges = _trade_edges(spark, sf)
    return _path_rows(graph_query.find_paths(edges, *PATH_ENDS, max_hops=3, limit=5))


@query
def paths_directed(spark, sf):
    edges = _trade_edges(spark, sf)
    return _path_rows(
        graph_query.find_paths(edges, "customer:10", "region:1", max_hops=5, limit=5, directed=True)
    )


@query
def paths_six_hops(spark, sf):
    """Between two regions no path is shorter than six hops: nation, supplier, part, supplier, nation."""
    edges = _trade_edges(spark, sf)
    return _path_rows(graph_query.find_paths(edges, *REGION_ENDS, max_hops=6, limit=8))


@query
def resolve_exact_token_substring(spark, sf):
    nodes, _ = adapters.trade_graph(spark, sf)
    hits = graph_query.resolve_entities(nodes, ENTITY_TEXT, limit=100, fuzzy=False)
    return hits.select("node_id", "label", _six("score").alias("score"), "method")


@query
def resolve_terms(spark, sf):
    """Part names without their number, suppliers and pairs of places, each against all nodes."""
    nodes, _ = adapters.trade_graph(spark, sf)
    hits = graph_query.resolve_many(nodes, adapters.entity_terms(spark, sf), limit=6)
    return hits.select("term_id", "rank", "node_id", "label", _six("score").alias("score"), "method")


# -- graph profiling and export -----------------------------------------------


@query
def audit_counts(spark, sf):
    return graph_audit.audit_counts(*adapters.topic_graph(spark, sf)).drop("first_seen")


@query
def audit_summary(spark, sf):
    return graph_audit.audit_summary(graph_audit.audit_counts(*adapters.topic_graph(spark, sf)))


@query
def audit_trade_relations(spark, sf):
    counts = graph_audit.audit_counts(*adapters.trade_graph(spark, sf))
    return graph_audit.histogram(counts, "relation")


@query
def audit_histogram(spark, sf):
    """Sections by how often they occur; most tie, and ties are first seen first."""
    counts = graph_audit.audit_counts(*adapters.topic_graph(spark, sf))
    ranked = number_ordered(graph_audit.histogram(counts, "section"), "rank")
    return ranked.select(F.col("rank").cast("int").alias("rank"), "key", "n")


@query
def audit_section_sort(spark, sf):
    counts = graph_audit.audit_counts(*adapters.topic_graph(spark, sf))
    ordered = number_ordered(graph_audit.covered_sections(counts), "pos")
    return ordered.select((F.col("pos") - 1).cast("int").alias("pos"), "section")


@query
def export_nodes(spark, sf):
    return export_subgraph(*adapters.topic_graph(spark, sf)).nodes.select("node_id")


@query
def export_edges(spark, sf):
    return export_subgraph(*adapters.topic_graph(spark, sf)).edges.select(
        "edge_id", "source", "target", "provenance"
    )


@query
def export_counts(spark, sf):
    return export_subgraph(*adapters.topic_graph(spark, sf)).counters()


# -- alignment ----------------------------------------------------------------


def _aligned(spark, sf) -> DataFrame:
    nodes, edges = adapters.topic_graph(spark, sf)
    return A.align(nodes, edges, adapters.chunks(spark, sf))


@query
def align_items(spark, sf):
    score = lambda name: _six(F.try_element_at("component_scores", F.lit(name)))
    return _aligned(spark, sf).select(
        "graph_item_id",
        "graph_item_type",
        "rank",
        "chunk_id",
        _six("confidence").alias("confidence"),
        "confidence_label",
        _joined("match_methods").alias("match_methods"),
        score("section").alias("section_score"),
        score("entity_name").alias("name_score"),
        score("description_overlap").alias("overlap_score"),
    )


@query
def align_counts(spark, sf):
    return A.alignment_summary(_aligned(spark, sf))


@query
def align_provenance_sections(spark, sf):
    items = A.graph_items(*adapters.topic_graph(spark, sf))
    return items.select("graph_item_id", "label", _joined("sections").alias("sections"))


@query
def align_evidence(spark, sf):
    """Trusted alignments written as JSON lines, read in file order, the best two of each item with their chunk."""
    path = f"{shared_folder(spark)}/alignments-{uuid.uuid4().hex}"
    write_alignments(_aligned(spark, sf), path)
    best = A.best_evidence(read_alignments(spark, path, trusted_only=True, ordinal="ordinal"), 2)
    held = adapters.chunks(spark, sf).select("chunk_id", "section")
    return best.join(held, "chunk_id").select(
        "graph_item_id", "evidence_rank", "chunk_id", "section", _six("confidence").alias("confidence"), "confidence_label"
    )


# -- ingestion ----------------------------------------------------------------


def _ingested(spark, sf) -> tuple[DataFrame, DataFrame]:
    documents = adapters.block_documents(spark, sf)
    return documents, I.chunk_documents(
        documents, spec_id="3GPP TS 24.501", version="19.2.0", max_chars=PACK_CHARS
    )


@query
def chunk_packing(spark, sf):
    _, chunks = _ingested(spark, sf)
    return chunks.select(
        "doc",
        "chunk_no",
        "section",
        "content_type",
        F.char_length("text").alias("chars"),
        F.md5("text").alias("digest"),
    )


@query
def chunk_ids(spark, sf):
    _, chunks = _ingested(spark, sf)
    return chunks.select("doc", "chunk_no", "chunk_id")


@query
def heading_paths(spark, sf):
    _, chunks = _ingested(spark, sf)
    return chunks.select("doc", "chunk_no", _joined("heading_path").alias("heading_path"))


@query
def toc_pages(spark, sf):
    _, chunks = _ingested(spark, sf)
    return chunks.select("doc", "chunk_no", "section", "page_start", "page_end")


@query
def ingest_summary(spark, sf):
    return I.ingestion_summary(*_ingested(spark, sf))


@query
def corpus_validation(spark, sf):
    parsed = parse_lines(adapters.corpus_lines(spark, sf))
    return parsed.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def corpus_duplicates(spark, sf):
    """Ids that occur again, when exact copies are given the id of their text."""
    rows = adapters.chunks(spark, sf).select(
        F.md5("text").alias("chunk_id"), "text", "chunk_seq", F.lit("corpus").alias("_path")
    )
    return duplicate_ids(rows)


@query
def citation_antijoin(spark, sf):
    """Cited chunks that no stored tool result of the same answer holds."""
    answers = adapters.answers(spark, sf)
    observed = C.harvested_ids(adapters.tool_results(spark, sf))
    return C.unsupported_citations(answers, observed).select("answer_id", "position", "chunk_id")
