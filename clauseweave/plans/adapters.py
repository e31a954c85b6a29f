"""Fixed views of the given tables in the shapes the operators expect.

Every view has a SQL twin in :mod:`oracles`; the two are kept side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank

# License names that play external references in the documents.
LICENSE_PATTERN = r"\b(?:Apache License|MIT License|GNU General Public License|CC BY-NC)\b"

PROVENANCE = "../specs/24501-j20.md"
OTHER_PROVENANCE = "../specs/23501-j10.md4.1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def section_of(doc_id: Column, source: Column) -> Column:
    return F.concat((doc_id % 9 + 1).cast("string"), F.lit("."), F.substr(source, F.lit(4)))


def _chunk_columns() -> list[Column]:
    text = F.col("text")
    first_line = F.get(F.split(text, "\n"), F.lit(0))
    section = section_of(F.col("doc_id"), F.col("source"))
    return [
        F.col("doc_id").alias("chunk_seq"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.lit("corpus").alias("spec_id"),
        F.lit("Rel-1").alias("release"),
        F.lit("1.0.0").alias("version"),
        section.alias("section"),
        first_line.alias("section_title"),
        F.array(section).alias("heading_path"),
        F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"),
        F.col("lang").alias("content_type"),
        text,
        F.col("source").alias("source_file"),
    ]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: a section by id, its first line as the title."""
    documents = table(spark, sf_dir, "documents")
    return documents.filter(~is_blank(F.col("text"))).select(*_chunk_columns())


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions about one top-level section."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"),
        F.col("text").alias("question"),
        F.array((F.col("item_id") % 9 + 1).cast("string")).alias("required_sections"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_seq"),
        F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("chunk_id"),
        "embedding",
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the smallest id plays the embedded query."""
    rows = table(spark, sf_dir, "embeddings")
    return list(rows.orderBy("vec_id").select("embedding").first()[0])


def block_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as structured blocks, one per line.

    Every fourth line is a numbered heading of level 1 to 3, every line before
    a heading is a table; a contents line per top section precedes the body.
    """
    documents = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    top = (F.col("doc_id") % 9 + 1).cast("string")

    def block(line: Column, i: Column) -> Column:
        is_head = i % 4 == 0
        number = F.concat(top, F.lit("."), F.floor(i / 4).cast("string"))
        raw = F.when(is_head, F.concat(number, F.lit("\t"), line)).otherwise(line)
        text = F.trim(F.regexp_replace(raw, r"[ \t]+", " "))
        style = F.when(
            is_head, F.concat(F.lit("Heading "), (F.floor(i / 4) % 3 + 1).cast("string"))
        ).otherwise(F.lit("Normal"))
        kind = F.when(i % 4 == 3, F.lit("table")).otherwise(F.lit("paragraph"))
        return F.struct(kind.alias("kind"), text.alias("text"), style.alias("style"), raw.alias("raw"))

    toc = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda n: F.concat_ws(
            "\t",
            F.concat(top, F.lit("."), n.cast("string")),
            F.lit("Contents"),
            (F.col("doc_id") % 50 + n).cast("string"),
        ),
    )
    toc_blocks = F.transform(
        toc,
        lambda raw: F.struct(
            F.lit("paragraph").alias("kind"),
            F.replace(raw, F.lit("\t"), F.lit(" ")).alias("text"),
            F.lit("toc 1").alias("style"),
            raw.alias("raw"),
        ),
    )
    return documents.select(
        F.col("doc_id").alias("doc"),
        F.col("source").alias("source_file"),
        F.concat(toc_blocks, F.transform(lines, block)).alias("blocks"),
    )


def _attributes(**values: Column) -> Column:
    return F.create_map(*[part for name, v in values.items() for part in (F.lit(name), v)])


def topic_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One topic per document, described by all its lines after the first; an edge to the next document.

    Every tenth topic and every edge of such a document carries no provenance.
    """
    documents = table(spark, sf_dir, "documents")
    words = F.split(F.get(F.split("text", "\n"), F.lit(0)), " ")
    section = section_of(F.col("doc_id"), F.col("source"))
    own = F.concat(F.lit(PROVENANCE), section)
    path = (
        F.when(F.col("doc_id") % 10 == 0, F.lit(""))
        .when(F.col("doc_id") % 10 == 1, F.concat(own, F.lit("<SEP>"), F.lit(PROVENANCE), F.lit("4.7")))
        .when(F.col("doc_id") % 10 == 2, F.lit(OTHER_PROVENANCE))
        .otherwise(own)
    )
    description = F.regexp_extract("text", r"^[^\n]*\n((?s:.*))$", 1)
    nodes = documents.select(
        F.concat(F.lit("topic:"), F.col("doc_id").cast("string")).alias("node_id"),
        (F.col("doc_id") + 1).alias("node_seq"),
        _attributes(
            entity_id=F.array_join(F.slice(words, 1, 2), " "),
            entity_type=F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("lang")),
            description=F.coalesce(description, F.lit("")),
            file_path=path,
            source_file=F.when(F.contains(path, F.lit("24501-j20")), F.lit("24501-j20.docx")).otherwise(
                F.lit("")
            ),
        ).alias("attributes"),
    )
    keywords = F.concat(F.lit("FOLLOWS<SEP> "), F.col("lang"))
    edges = documents.select(
        F.concat(F.lit("edge:"), F.col("doc_id").cast("string")).alias("edge_id"),
        F.concat(F.lit("topic:"), F.col("doc_id").cast("string")).alias("source"),
        F.concat(
            F.lit("topic:"),
            F.when(F.col("doc_id") % 25 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string"),
        ).alias("target"),
        (F.col("doc_id") + 1).alias("edge_seq"),
        _attributes(
            keywords=keywords,
            description=F.lit(""),
            file_path=F.when(F.col("doc_id") % 2 == 0, path).otherwise(F.lit(OTHER_PROVENANCE)),
        ).alias("attributes"),
    )
    return nodes, edges


# A task makes the pairs of so many rows distinct.
PAIR_ROWS = 500_000


def _distinct_pairs(rows: DataFrame, *pairs: tuple[str, str]) -> list[DataFrame]:
    """The distinct pairs of columns of a large table.

    Most are distinct already, so a table of a whole split's pairs would only fill memory: rows are
    dealt by their pair into partitions whose number grows with the table's (counted in its footers).
    """
    parts = max(1, -(-rows.count() // PAIR_ROWS))
    return [rows.select(*pair).repartition(parts, *pair).distinct() for pair in pairs]


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers, suppliers, parts and orders as a property graph.

    Order-to-part and part-to-supplier edges are the distinct pairs of the line items.
    """
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def ident(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def nodes_of(rank: int, kind: str, df: DataFrame, key: str, name: Column) -> DataFrame:
        return df.select(
            ident(kind, key).alias("node_id"),
            (F.lit(rank * 10**12) + F.col(key)).cast("long").alias("node_seq"),
            _attributes(entity_id=name, entity_type=F.lit(kind)).alias("attributes"),
        )

    def edges_of(rank: int, relation: str, df: DataFrame, source: tuple, target: tuple, *keys: str) -> DataFrame:
        # Every pair of 18-digit keys has a number and an id of its own.
        wide = [F.col(k).cast("decimal(18,0)") for k in keys] + [F.lit(0).cast("decimal(18,0)")] * (2 - len(keys))
        digits = [F.lpad(w.cast("string"), 18, "0") for w in wide]
        return df.select(
            F.concat(F.lit(f"{relation}:"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys])).alias("edge_id"),
            ident(*source).alias("source"),
            ident(*target).alias("target"),
            F.concat(F.lit(str(rank)), *digits).cast("decimal(38,0)").alias("edge_seq"),
            _attributes(keywords=F.lit(relation)).alias("attributes"),
        )

    nodes = (
        nodes_of(1, "region", t["region"], "r_regionkey", F.col("r_name"))
        .unionByName(nodes_of(2, "nation", t["nation"], "n_nationkey", F.col("n_name")))
        .unionByName(nodes_of(3, "customer", t["customer"], "c_custkey", F.col("c_name")))
        .unionByName(nodes_of(4, "supplier", t["supplier"], "s_suppkey", F.col("s_name")))
        .unionByName(nodes_of(5, "part", t["part"], "p_partkey", F.col("p_name")))
        .unionByName(nodes_of(6, "order", t["orders"], "o_orderkey", F.lit("")))
    )
    contains, supplied = _distinct_pairs(t["lineitem"], ("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey"))
    edges = (
        edges_of(1, "IN_REGION", t["nation"], ("nation", "n_nationkey"), ("region", "n_regionkey"), "n_nationkey")
        .unionByName(edges_of(2, "IN_NATION", t["customer"], ("customer", "c_custkey"), ("nation", "c_nationkey"), "c_custkey"))
        .unionByName(edges_of(3, "BASED_IN", t["supplier"], ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "s_suppkey"))
        .unionByName(edges_of(4, "PLACED", t["orders"], ("customer", "o_custkey"), ("order", "o_orderkey"), "o_orderkey"))
        .unionByName(edges_of(5, "CONTAINS", contains, ("order", "l_orderkey"), ("part", "l_partkey"), "l_orderkey", "l_partkey"))
        .unionByName(edges_of(6, "SUPPLIED_BY", supplied, ("part", "l_partkey"), ("supplier", "l_suppkey"), "l_partkey", "l_suppkey"))
    )
    return nodes, edges


def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to resolve: distinct part names, supplier names in capitals, nations with their regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return (
        parts.select(F.concat(F.lit("part "), "p_name").alias("term_id"), F.col("p_name").alias("term"))
        .unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("term_id"), F.upper("s_name").alias("term")))
        .unionByName(places.select(F.concat(F.lit("place "), F.col("n_nationkey").cast("string")).alias("term_id"), F.concat("n_name", F.lit(", "), "r_name").alias("term")))
    )


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, some deliberately damaged by a rule on the id."""
    rows = chunks(spark, sf_dir).drop("page_start", "page_end")
    fields = [c for c in rows.columns if c != "chunk_seq"]
    whole = F.to_json(F.struct(*fields))
    no_title = F.to_json(F.struct(*[c for c in fields if c != "section_title"]))
    value = (
        F.when(F.col("chunk_seq") % 50 == 7, F.substring(whole, 1, 20))
        .when(F.col("chunk_seq") % 50 == 8, no_title)
        .otherwise(whole)
    )
    return rows.select("chunk_seq", value.alias("value"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that cite one chunk each."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    number = (F.col("conv_id") * 31 + F.col("turn")).cast("string")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        F.concat("text", F.lit(" (chunk_id: `doc-"), number, F.lit("`)")).alias("answer"),
        "conv_id",
        F.concat(F.lit("doc-"), number).alias("cited"),
    )


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search tool returned for the answers of even conversations: JSON with the cited document, if there is one.

    Of every other such conversation the stored text is cut, and so no JSON.
    """
    asked = answers(spark, sf_dir).filter(F.col("conv_id") % 2 == 0).select("answer_id", "conv_id", "cited")
    held = chunks(spark, sf_dir).select("chunk_id", "section", "section_title", F.char_length("text").alias("chars"))
    evidence = F.struct("chunk_id", "section", "section_title")
    result = F.struct(
        F.lit(True).alias("ok"),
        F.struct(
            F.array(F.struct(F.lit(1).alias("rank"), evidence.alias("evidence"))).alias("hits"), F.col("chars").alias("chunk_id")
        ).alias("result"),
    )
    stored = F.to_json(result)
    found = asked.join(held, F.col("cited") == F.col("chunk_id"))
    return found.select("answer_id", F.when(F.col("conv_id") % 4 == 2, F.substring(stored, 1, 30)).otherwise(stored).alias("result"))
