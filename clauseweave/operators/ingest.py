"""Structured documents to section-aware chunks.

A document is one row holding its ordered blocks, as a reader produces it from
one file; ``doc`` names it.  Blocks are dealt by document once, and what depends
on their order is windows over that one sort: the section is carried forward,
the heading stack is the last heading of each level that no higher one has
closed since, and paragraphs are packed inside each run of paragraphs between
headings and tables.  Work grows with the blocks of a document, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sections import SECTION_TOKEN
from ..functions.text import collapse_space, strip
from ..session import materialize

DEFAULT_MAX_CHARS = 2400
MIN_MAX_CHARS = 500

_WS = r"[\s\x1c-\x1f]"
_HEADING_STYLE = rf"(?iU)^{_WS}*Heading{_WS}+(\d+){_WS}*$"
_HEADING_TEXT = rf"(?sU)^({SECTION_TOKEN}){_WS}+\t?{_WS}*(.+)$"
_UNNUMBERED = "Foreword"  # fixed value: the one heading accepted without a number

_HEADING = "struct<level:int,section:string,title:string>"


def heading_of(block: Column) -> Column:
    """Heading of a block as (level, section, title), or null for body text."""
    text = strip(block["text"])
    level = F.nullif(F.regexp_extract(block["style"], _HEADING_STYLE, 1), F.lit(""))
    section = F.regexp_extract(text, _HEADING_TEXT, 1)
    title = strip(F.regexp_extract(text, _HEADING_TEXT, 2))
    unnumbered = F.struct(
        F.lit(1).alias("level"), F.lit(_UNNUMBERED).alias("section"), F.lit(_UNNUMBERED).alias("title")
    )
    numbered = F.struct(
        level.cast("int").alias("level"), section.alias("section"), title.alias("title")
    )
    return (
        F.when(level.isNull(), F.lit(None).cast(_HEADING))
        .when(F.lower(text) == _UNNUMBERED.lower(), unnumbered)
        .when(section != "", numbered)
    )


def toc_page_entries(blocks: Column) -> Column:
    """Contents lines before the first heading style, as array<struct<section,page>>."""
    style = lambda b: F.lower(F.coalesce(b["style"], F.lit("")))
    first = F.get(
        F.filter(
            F.transform(blocks, lambda b, i: F.when(F.startswith(style(b), F.lit("heading")), i)),
            lambda i: i.isNotNull(),
        ),
        F.lit(0),
    )
    lines = F.filter(
        blocks,
        lambda b, i: (b["kind"] == "paragraph")
        & F.startswith(style(b), F.lit("toc"))
        & (first.isNull() | (i < first)),
    )
    parsed = F.transform(lines, lambda b: parse_toc_line(F.coalesce(b["raw"], b["text"])))
    return F.filter(parsed, lambda entry: entry.isNotNull())


def parse_toc_line(text: Column) -> Column:
    """(section, page) of a tab-separated contents line, or null."""
    parts = F.filter(F.transform(F.split(text, "\t"), strip), lambda p: p != "")
    head, tail = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    valid = (
        (F.size(parts) >= 3) & head.rlike(rf"(?U)^(?:{SECTION_TOKEN})$") & tail.rlike(r"^[0-9]+$")
    )
    return F.when(valid, F.struct(head.alias("section"), tail.cast("int").alias("page")))


def section_pages(documents: DataFrame) -> DataFrame:
    """(doc, section, page) of the contents lines; a later line for a section overrides."""
    lines = documents.select("doc", F.posexplode_outer(toc_page_entries(F.col("blocks"))).alias("_line", "e"))
    known = lines.filter(F.col("e").isNotNull())
    return known.groupBy("doc", F.col("e.section").alias("section")).agg(F.max_by("e.page", "_line").alias("page"))


def block_rows(documents: DataFrame) -> DataFrame:
    """(doc, source_file, at, kind, text, heading), one row for each non-blank block."""
    rows = mark_blocks(documents).select("doc", "source_file", F.explode_outer("marked").alias("b"))
    return rows.filter(F.col("b").isNotNull()).select("doc", "source_file", "b.*")


def heading_paths(rows: DataFrame) -> DataFrame:
    """(doc, head, path): for each heading, at its place, the sections from the top down to it.

    A level's last heading is on the path if it stands after the last of every level above.
    """
    heads = rows.filter(F.col("heading").isNotNull()).select("doc", F.col("at").alias("head"), "heading")
    levels = [r[0] for r in heads.select(F.col("heading.level").alias("level")).distinct().orderBy("level").collect()]
    so_far = Window.partitionBy("doc").orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda level: F.last(
        F.when(F.col("heading.level") == level, F.struct("head", F.col("heading.section").alias("section"))), ignorenulls=True
    ).over(so_far)
    seen = heads.select("doc", "head", *[last(level).alias(f"l{i}") for i, level in enumerate(levels)])
    above = F.lit(-1)
    path = []
    for i in range(len(levels)):
        path.append(F.when(F.col(f"l{i}.head") > above, F.col(f"l{i}.section")))
        above = F.greatest(above, F.coalesce(F.col(f"l{i}.head"), F.lit(-1)))
    return seen.select("doc", "head", F.array_compact(F.array(*path).cast("array<string>")).alias("path"))


def packed_starts(costs: Column, max_chars: int) -> Column:
    """Places at which groups begin when costs are taken in order until the next would exceed ``max_chars``."""
    start = F.struct(F.lit(max_chars + 1).cast("long").alias("room"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, cost: Column) -> Column:
        opens = acc["room"] + cost > max_chars
        return F.struct(
            F.when(opens, cost.cast("long")).otherwise(acc["room"] + cost).alias("room"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(costs, start, step, lambda acc: acc["starts"])


def packed_groups(rows: DataFrame, max_chars: int) -> DataFrame:
    """(doc, source_file, head, heading, start, kind, text): blocks below a heading, packed.

    A table is a group of its own; the paragraphs between two headings or tables are packed in
    order.  Each paragraph costs its length plus two, the first included.
    """
    so_far = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head, table = F.col("heading").isNotNull(), F.col("kind") == "table"
    carried = rows.select(
        "*",
        F.last(F.when(is_head, F.struct("at", "heading")), ignorenulls=True).over(so_far).alias("under"),
        F.count(F.when(is_head | table, F.lit(1))).over(so_far).alias("run"),
    ).filter(F.col("heading").isNull() & F.col("under").isNotNull())
    runs = carried.groupBy("doc", "run", table.alias("table")).agg(
        F.first("source_file").alias("source_file"),
        F.first("under").alias("under"),
        F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("blocks"),
    )
    starts = packed_starts(F.transform("blocks", lambda b: F.char_length(b["text"]) + 2), max_chars)
    placed = runs.withColumn("starts", starts)

    def group(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.size("blocks"))
        texts = F.transform(F.slice("blocks", start + 1, stop - start), lambda b: b["text"])
        first = F.get("blocks", start)
        return F.struct(first["at"].alias("start"), first["kind"].alias("kind"), strip(F.array_join(texts, "\n\n")).alias("text"))

    groups = placed.select("doc", "source_file", "under", F.explode_outer(F.transform("starts", group)).alias("g"))
    return groups.select("doc", "source_file", F.col("under.at").alias("head"), F.col("under.heading").alias("heading"), "g.*")


def mark_blocks(documents: DataFrame) -> DataFrame:
    """Add ``marked``: the non-blank blocks with position and heading."""
    collapsed = F.filter(
        F.transform(
            F.col("blocks"),
            lambda b: F.struct(
                b["kind"].alias("kind"), b["text"].alias("text"), F.coalesce(b["style"], F.lit("")).alias("style")
            ),
        ),
        lambda b: b["text"] != "",
    )
    heading = F.transform(
        F.col("_body"),
        lambda b, i: F.struct(
            i.alias("at"), b["kind"].alias("kind"), b["text"].alias("text"), heading_of(b).alias("heading")
        ),
    )
    return documents.withColumn("_body", collapsed).withColumn("marked", heading).drop("_body")


def stable_chunk_id(spec_id: Column, version: Column, section: Column, index: Column, text: Column) -> Column:
    spec = F.lower(spec_id)
    for part in ("3gpp", "ts", "."):
        spec = F.replace(spec, F.lit(part), F.lit(""))
    spec = F.regexp_replace(spec, rf"(?U){_WS}+", "")
    return F.concat(
        F.lit("ts"),
        spec,
        F.lit("-v"),
        version,
        F.lit("-"),
        F.lower(F.replace(section, F.lit("."), F.lit("-"))),
        F.lit("-"),
        F.format_string("%03d", index),
        F.lit("-"),
        F.substring(F.sha1(text), 1, 10),
    )


def chunk_documents(
    documents: DataFrame,
    *,
    spec_id: Column | str = "3GPP TS 24.501",
    release: Column | str = "Rel-19",
    version: Column | str = "19.2.0",
    max_chars: int = DEFAULT_MAX_CHARS,
) -> DataFrame:
    """Chunks of ``documents(doc, source_file, blocks)``, with ``doc`` and ``chunk_no``.

    ``chunk_no`` numbers the chunks of a document from 0 in document order.
    """
    if max_chars < MIN_MAX_CHARS:
        raise ValueError(f"max_chars must be at least {MIN_MAX_CHARS}")
    literal = lambda v: F.lit(v) if isinstance(v, str) else v
    spec_id, release, version = literal(spec_id), literal(release), literal(version)

    rows = materialize(block_rows(documents))
    groups = packed_groups(rows, max_chars)
    in_document = Window.partitionBy("doc").orderBy("start")
    in_section = Window.partitionBy("doc", "head").orderBy("start")
    placed = groups.select(
        "*",
        (F.row_number().over(in_document) - 1).alias("chunk_no"),
        F.row_number().over(in_section).alias("_index"),
        F.col("heading.section").alias("section"),
        F.col("heading.title").alias("section_title"),
    )
    page = F.col("page")
    named = placed.join(heading_paths(rows), ["doc", "head"]).join(section_pages(documents), ["doc", "section"], "left")
    return named.select(
        "doc",
        "chunk_no",
        stable_chunk_id(spec_id, version, F.col("section"), F.col("_index"), F.col("text")).alias("chunk_id"),
        spec_id.alias("spec_id"),
        release.alias("release"),
        version.alias("version"),
        "section",
        "section_title",
        F.col("path").alias("heading_path"),
        page.alias("page_start"),
        page.alias("page_end"),
        F.col("kind").alias("content_type"),
        "text",
        "source_file",
    )


def ingestion_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: paragraphs, tables, sections, chunks, chunks_with_page."""
    first = F.get(
        F.filter(
            F.transform("marked", lambda b: F.when(b["heading"].isNotNull(), b["at"])),
            lambda at: at.isNotNull(),
        ),
        F.lit(0),
    )

    def body(kind: str) -> Column:
        hits = F.filter(
            "marked",
            lambda b: b["heading"].isNull() & (b["at"] > F.col("_first")) & (b["kind"] == kind),
        )
        return F.coalesce(F.sum(F.when(F.col("_first").isNotNull(), F.size(hits)).cast("long")), F.lit(0))

    headings = F.filter("marked", lambda b: b["heading"].isNotNull())
    blocks = (
        mark_blocks(documents)
        .withColumn("_first", first)
        .agg(
            body("paragraph").alias("paragraphs"),
            body("table").alias("tables"),
            F.coalesce(F.sum(F.size(headings).cast("long")), F.lit(0)).alias("sections"),
        )
    )
    made = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count("page_start").alias("chunks_with_page")
    )
    return blocks.withColumn("_one", F.lit(1)).join(made.withColumn("_one", F.lit(1)), "_one").drop("_one")


def line_blocks(text: Column) -> Column:
    """Paragraph blocks from the lines of a plain text."""
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            F.lit("paragraph").alias("kind"),
            collapse_space(line).alias("text"),
            F.lit("").alias("style"),
            line.alias("raw"),
        ),
    )
