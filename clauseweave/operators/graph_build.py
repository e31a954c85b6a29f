"""Property graph from specification chunks.

Each chunk independently proposes section, parent, entity and external-spec
nodes and the edges between them; the first proposal in corpus order wins.
"First" is an ordered aggregate (``min_by``), combined map-side, so a node named
by a third of all chunks is reduced before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sections as S
from ..functions.text import REFERENCE_PATTERN, casefold, find_spans, reference_label, slug, span_at, strip
from ..session import materialize

# The (source type, relation, target type) triples an edge may have.
ALLOWED_TRIPLES = (
    ("SecurityConcept", "DEFINED_IN", "Section"),
    ("NASMessage", "DEFINED_IN", "Section"),
    ("InformationElement", "DEFINED_IN", "Section"),
    ("Procedure", "DEFINED_IN", "Section"),
    ("Term", "DEFINED_IN", "Section"),
    ("Section", "SUBCLAUSE_OF", "Section"),
    ("Section", "REFERENCES", "ExternalSpec"),
    ("SecurityConcept", "REFERENCES", "ExternalSpec"),
    ("NASMessage", "REFERENCES", "ExternalSpec"),
    ("Procedure", "REFERENCES", "ExternalSpec"),
    ("Term", "REFERENCES", "ExternalSpec"),
)

# Entity type by leading section number; anything else is a Term.
SECTION_TYPES = {
    "8.": "NASMessage",
    "9.": "InformationElement",
    "5.": "Procedure",
    "4.": "SecurityConcept",
}

NODE_COLUMNS = (
    "entity_id",
    "node_type",
    "section",
    "section_title",
    "chunk_id",
    "char_start",
    "char_end",
    "confidence_label",
)
EDGE_COLUMNS = (
    "keywords",
    "chunk_id",
    "section",
    "char_start",
    "char_end",
    "confidence_label",
    "extraction_method",
    "source_file",
)


def node_type(section: Column) -> Column:
    kind = F.lit("Term")
    for prefix, name in SECTION_TYPES.items():
        kind = F.when(F.startswith(section, F.lit(prefix)), F.lit(name)).otherwise(kind)
    return kind


def prepare(chunks: DataFrame, reference_pattern: str = REFERENCE_PATTERN) -> DataFrame:
    """The narrow facts every node and edge is made of; the text is dropped.

    Each text is folded once, and every position in it is its own column, so no
    later expression can pull a scan of the text back in.
    """
    texts = chunks.select(
        "chunk_seq",
        "chunk_id",
        "section",
        "section_title",
        "source_file",
        F.char_length("text").alias("text_len"),
        casefold(F.col("text")).alias("folded"),
        F.coalesce(strip(F.col("section_title")), F.lit("")).alias("name"),
        find_spans(F.col("text"), reference_pattern).alias("refs"),
    )
    title_at = F.instr("folded", casefold(F.col("section_title")))
    return (
        texts.withColumn("title_at", F.when(F.col("section_title") == "", 0).otherwise(title_at))
        .withColumn(
            "name_at",
            F.when(F.col("name") == F.col("section_title"), F.col("title_at"))
            .when(F.col("name") == "", 0)
            .otherwise(F.instr("folded", casefold(F.col("name")))),
        )
        .select(
            "chunk_seq",
            "chunk_id",
            "section",
            "section_title",
            "source_file",
            "text_len",
            S.parent(F.col("section")).alias("parent"),
            F.nullif("name", F.lit("")).alias("label"),
            node_type(F.col("section")).alias("kind"),
            span_at(F.col("title_at"), F.col("section_title"), F.col("text_len")).alias("title_span"),
            span_at(F.col("name_at"), F.col("name"), F.col("text_len")).alias("label_span"),
            "refs",
        )
    )


def _string(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("string")


def _node(step: Column, node_id: Column, **values: Column | str) -> Column:
    """One node proposal as a struct; unnamed fields come from the chunk."""
    fields = {
        "entity_id": values.get("entity_id"),
        "node_type": values.get("node_type"),
        "section": values.get("section", F.col("section")),
        "section_title": values.get("section_title", F.col("section_title")),
        "char_start": values.get("char_start"),
        "char_end": values.get("char_end"),
        "confidence_label": values.get("confidence_label", "verified"),
    }
    return F.struct(
        step.cast("long").alias("step"),
        node_id.alias("node_id"),
        *[_string(value).alias(name) for name, value in fields.items()],
    )


def section_id() -> Column:
    return F.concat(F.lit("section:"), F.col("section"))


def entity_id() -> Column:
    """Node id of the chunk's titled entity, null without a title."""
    return F.concat(F.lower("kind"), F.lit(":"), slug(F.col("label")))


def external_id(ref: Column) -> Column:
    return F.concat(F.lit("external_spec:"), slug(reference_label(ref["match"])))


def section_node() -> Column:
    return _node(
        F.lit(0),
        section_id(),
        entity_id=strip(F.concat_ws(" ", "section", "section_title")),
        node_type="Section",
        char_start=F.col("title_span.start"),
        char_end=F.col("title_span.end"),
    )


def parent_node() -> Column:
    """Placeholder for the section one level up; never replaces an earlier node."""
    parent = F.col("parent")
    node = _node(
        F.lit(1),
        F.concat(F.lit("section:"), parent),
        entity_id=parent,
        node_type="Section",
        section=parent,
        section_title="",
        char_start="0",
        char_end=F.least(F.col("text_len"), F.char_length(parent)),
        confidence_label="candidate",
    )
    return F.when(parent.isNotNull(), node)


def entity_node() -> Column:
    node = _node(
        F.lit(2),
        F.col("entity_node"),
        entity_id=F.col("label"),
        node_type=F.col("kind"),
        char_start=F.col("label_span.start"),
        char_end=F.col("label_span.end"),
    )
    return F.when(F.col("label").isNotNull(), node)


def external_nodes() -> Column:
    return F.transform(
        "refs",
        lambda ref, i: _node(
            i + 3,
            external_id(ref),
            entity_id=reference_label(ref["match"]),
            node_type="ExternalSpec",
            char_start=ref["start"],
            char_end=ref["end"],
        ),
    )


def _edge(
    step: Column,
    source: tuple[Column, Column],
    relation: str,
    target: tuple[Column, Column],
    offsets: tuple[Column, Column],
    method: str,
) -> Column:
    """One edge proposal as a struct, marked legal or not by the whitelist."""
    triple = F.concat_ws("|", source[1], F.lit(relation), target[1])
    return F.struct(
        step.cast("long").alias("step"),
        source[0].alias("source"),
        target[0].alias("target"),
        F.lit(relation).alias("keywords"),
        offsets[0].cast("string").alias("char_start"),
        offsets[1].cast("string").alias("char_end"),
        F.lit("verified").alias("confidence_label"),
        F.lit(method).alias("extraction_method"),
        triple.isin(["|".join(t) for t in ALLOWED_TRIPLES]).alias("legal"),
    )


def hierarchy_edge() -> Column:
    section = F.lit("Section")
    edge = _edge(
        F.lit(1),
        (section_id(), section),
        "SUBCLAUSE_OF",
        (F.concat(F.lit("section:"), F.col("parent")), section),
        (
            F.lit(0),
            F.least(F.col("text_len"), F.greatest(F.char_length("section"), F.lit(1))),
        ),
        "section_hierarchy",
    )
    return F.when(F.col("parent").isNotNull(), edge)


def definition_edge() -> Column:
    edge = _edge(
        F.lit(2),
        (F.col("entity_node"), F.col("kind")),
        "DEFINED_IN",
        (section_id(), F.lit("Section")),
        (F.col("label_span.start"), F.col("label_span.end")),
        "section_title",
    )
    return F.when(F.col("label").isNotNull(), edge)


def reference_edges() -> Column:
    """From the entity of the chunk, or from its section when it has no title."""
    titled = F.col("label").isNotNull()
    source = (
        F.coalesce("entity_node", section_id()),
        F.when(titled, F.col("kind")).otherwise(F.lit("Section")),
    )
    return F.transform(
        "refs",
        lambda ref, i: _edge(
            i + 3,
            source,
            "REFERENCES",
            (external_id(ref), F.lit("ExternalSpec")),
            (ref["start"], ref["end"]),
            "reference_pattern",
        ),
    )


def _proposals(facts: DataFrame, single: list[Column], many: Column, columns: list[str]) -> DataFrame:
    """All proposals of a chunk from one row, so the texts are read once.

    The outer explode keeps the optimizer from inferring a filter that would
    evaluate every proposal a second time at the scan.
    """
    offered = F.concat(F.array_compact(F.array(*single)), many)
    rows = facts.select("chunk_seq", *columns, F.explode_outer(offered).alias("p"))
    return rows.select(
        F.struct("chunk_seq", F.col("p.step").alias("step")).alias("seq"), *columns, "p.*"
    ).drop("step")


def first_wins(proposals: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the proposal with the smallest ``seq``."""
    rest = [c for c in proposals.columns if c not in {*keys, "seq"}]
    kept = proposals.groupBy(*keys).agg(F.min_by(F.struct("seq", *rest), "seq").alias("row"))
    return kept.select(*keys, "row.*")


class SpecGraph:
    """Nodes, edges and counters of the graph built from ``chunks``.

    ``chunks`` needs a ``chunk_seq`` column giving the corpus order.
    """

    def __init__(self, chunks: DataFrame, *, reference_pattern: str = REFERENCE_PATTERN) -> None:
        self.chunks = chunks
        self.facts = prepare(chunks, reference_pattern).withColumn("entity_node", entity_id())

    def node_proposals(self) -> DataFrame:
        single = [section_node(), parent_node(), entity_node()]
        return _proposals(self.facts, single, external_nodes(), ["chunk_id"])

    def edge_proposals(self) -> DataFrame:
        single = [hierarchy_edge(), definition_edge()]
        rows = _proposals(
            self.facts,
            single,
            reference_edges(),
            ["chunk_id", "section", "source_file"],
        )
        return rows.filter(F.col("source").isNotNull())

    def nodes(self) -> DataFrame:
        return first_wins(self.node_proposals(), ["node_id"])

    def edges(self) -> DataFrame:
        legal = self.edge_proposals().filter("legal").drop("legal")
        kept = first_wins(legal.withColumn("relation", F.col("keywords")), ["source", "relation", "target"])
        edge_id = F.concat(
            F.lit("edge:"),
            slug(F.col("source")),
            F.lit(":"),
            F.lower("relation"),
            F.lit(":"),
            slug(F.col("target")),
        )
        return kept.withColumn("edge_id", edge_id)

    def _kept(self) -> SpecGraph:
        """The same graph with its facts kept, so that the texts are read once."""
        kept = SpecGraph.__new__(SpecGraph)
        kept.chunks, kept.facts = self.chunks, materialize(self.facts)
        return kept

    def counters(self) -> DataFrame:
        """One row: chunks, nodes, edges, provenance_edges, skipped_illegal_triples."""
        stored = self._kept()  # three parts read the facts
        proposals = stored.edge_proposals()
        edges = first_wins(
            proposals.filter("legal").select("seq", "source", "keywords", "target", "chunk_id"),
            ["source", "keywords", "target"],
        )
        count = F.count(F.lit(1))
        parts = [
            stored.facts.agg(count.alias("chunks")),
            stored.node_proposals().select("node_id").distinct().agg(count.alias("nodes")),
            edges.agg(
                count.alias("edges"),
                F.count_if(F.col("chunk_id") != "").alias("provenance_edges"),
            ),
            proposals.agg(F.count_if(~F.col("legal")).alias("skipped_illegal_triples")),
        ]
        # One-row relations, joined on a constant.
        keyed = [part.withColumn("_one", F.lit(1)) for part in parts]
        return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")

    def as_property_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) with attribute maps, in the order of the interchange file."""
        kept = self._kept()
        nodes = kept.nodes().select(
            "node_id", "seq", _attribute_map(NODE_COLUMNS).alias("attributes")
        )
        edges = kept.edges().select(
            "edge_id", "source", "target", "seq", _attribute_map(EDGE_COLUMNS).alias("attributes")
        )
        return nodes, edges


def _attribute_map(columns: tuple[str, ...]) -> Column:
    pairs = [part for name in columns for part in (F.lit(name), F.col(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
