"""GraphML reader that splits the text in one scan, and a distributed GraphML writer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.graph_build import EDGE_COLUMNS, NODE_COLUMNS
from ..session import broadcast_within, materialize, stored

NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
_DATA = "data array<struct<_key:string,_VALUE:string>>"


@dataclass(frozen=True)
class GraphFile:
    nodes: DataFrame  # node_id, node_seq, attributes
    edges: DataFrame  # edge_id, source, target, edge_seq, attributes
    directed: bool
    size_bytes: int
    edge_default: str


# elements that are read, each from its opening tag up to the next such tag
_KINDS = ("node", "edge", "key", "graph")
_OPENING = rf"<({'|'.join(_KINDS)})(?=[\s/]|$)"
_ELEMENT = (
    "`_id` string, `_attr.name` string, `_source` string, `_target` string, `_edgedefault` string, " + _DATA
)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between one ">" and the next, in the file's splits, with running counts of the opening tags before it.

    A tag counts only outside comments and CDATA sections.  Which of those a split starts in is known
    only once all splits are read, so tags before a split's first mark are counted on their own.
    """
    value = F.col("value")
    marker = (
        F.when(F.endswith(value, F.lit("--")) | F.endswith(value, F.lit("]]")), F.lit(""))
        .when(F.contains(value, F.lit("<!--")), F.lit("comment"))
        .when(F.contains(value, F.lit("<![CDATA[")), F.lit("cdata"))
    )
    cut = F.regexp_replace(value, r"(?s)(<!--|<!\[CDATA\[).*$", "")
    bare = F.when(F.contains(value, F.lit("<!")), cut).otherwise(value)
    split = Window.partitionBy("file", "start").orderBy("row")
    read = spark.read.option("lineSep", ">").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        marker.alias("marker"),
        F.regexp_extract(bare, _OPENING, 1).alias("opens"),
    )
    placed = read.withColumn("inside", F.last("marker", True).over(split.rowsBetween(Window.unboundedPreceding, -1)))
    counts = []
    for kind in _KINDS:
        is_kind = F.col("opens") == kind
        counts += [
            F.count_if(F.col("inside").isNull() & is_kind).over(split).alias(f"early_{kind}"),
            F.count_if((F.col("inside") == "") & is_kind).over(split).alias(f"late_{kind}"),
        ]
    return stored(placed.select("*", *counts), name="pieces")


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of the file (kind, number in its kind from 1, parsed ``e``), from one scan.

    Comments do not count, CDATA sections do; only where one of them quotes the other's marks
    is the end of it misread.
    """
    pieces = _pieces(spark, path)
    ends = pieces.groupBy("file", "start").agg(
        F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("row"))).alias("left_in"),
        *[F.max(f"{when}_{kind}").alias(f"{when}_{kind}") for kind in _KINDS for when in ("early", "late")],
    )
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    ends = ends.withColumn("starts_in", F.coalesce(F.last("left_in", True).over(before), F.lit("")))
    early = (F.col("starts_in") == "").cast("long")
    offsets = ends.select(
        "file", "start", "starts_in", F.row_number().over(Window.orderBy("file", "start")).alias("split"),
        *[F.coalesce(F.sum(F.col(f"late_{k}") + early * F.col(f"early_{k}")).over(before), F.lit(0)).alias(f"past_{k}") for k in _KINDS],
    )
    joined = pieces.join(broadcast_within(materialize(offsets)), ["file", "start"])
    inside = F.coalesce("inside", "starts_in")
    number = {k: F.col(f"past_{k}") + F.col(f"late_{k}") + early * F.col(f"early_{k}") for k in _KINDS}
    opens = F.when(inside == "", F.col("opens")).otherwise("")
    from_tag = F.regexp_extract("value", rf"(?s)<(?:{'|'.join(_KINDS)})(?:[\s/].*)?$", 0)
    text = F.when(opens != "", from_tag).otherwise(F.col("value"))
    has_comment = (inside == "") & F.contains("value", F.lit("<!--"))
    text = F.when(has_comment, F.regexp_replace(text, r"(?s)<!--.*$", "")).otherwise(F.concat(text, F.lit(">")))
    kept = joined.filter(inside != "comment").select(
        sum(number.values()).alias("element"), opens.alias("opens"), *[n.alias(k) for k, n in number.items()],
        F.struct("split", "row", text.alias("text")).alias("piece"),
    )
    whole = kept.filter("element > 0").groupBy("element").agg(
        F.max("opens").alias("kind"),
        *[F.max(k).alias(k) for k in _KINDS],
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "").alias("text"),
    )
    # without what follows the element; an opening tag without content or of the graph is closed here
    closed = F.regexp_extract("text", r"(?s)^.*</(?:node|edge|key)\s*>", 0)
    alone = F.concat(F.regexp_extract("text", r"""^(<(?:[^"'>/]+|/(?!>)|"[^"]*"|'[^']*')*)/?>""", 1), F.lit("/>"))
    one = F.when((F.col("kind") != "graph") & (closed != ""), closed).otherwise(alone)
    parsed = F.from_xml(one, _ELEMENT, {"ignoreNamespace": "true"})
    place = F.coalesce(*[F.when(F.col("kind") == k, F.col(k)) for k in _KINDS])
    return materialize(whole.select("kind", place.cast("long").alias("number"), parsed.alias("e")))


def _attributes(key_names: dict[str, str]) -> Column:
    """data elements to a map by attribute name; a repeated name keeps its last value."""
    pairs = [part for item in key_names.items() for part in (F.lit(item[0]), F.lit(item[1]))]
    names = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    named = F.transform(
        F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")),
        lambda d: F.struct(
            F.coalesce(F.try_element_at(names, d["_key"]), d["_key"], F.lit("")).alias("key"),
            strip(F.coalesce(d["_VALUE"], F.lit(""))).alias("value"),
        ),
    )
    def last(all_: Column) -> Column:
        return F.filter(
            all_,
            lambda d, i: ~F.exists(
                F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))),
                lambda later: later["key"] == d["key"],
            ),
        )

    # one element of an array, so that the values are stripped once and not for each of them
    return F.map_from_entries(F.get(F.transform(F.array(named), last), F.lit(0)))


def read_graphml(spark: SparkSession, path: str) -> GraphFile:
    """Nodes and edges of a GraphML file, numbered from 1 in file order.

    A node id given twice keeps its first place and its last attributes.
    """
    elements = _elements(spark, path)
    keys = elements.filter("kind = 'key'").select("e._id", "e.`_attr.name`")
    names = {row[0] or "": row[1] if row[1] is not None else row[0] or "" for row in keys.collect()}  # a few dozen declarations
    head = elements.filter("kind = 'graph' AND number = 1").select("e._edgedefault").first()
    if head is None:
        raise ValueError(f"no graph element found in {path}")
    default = head[0] or "directed"
    attributes = _attributes(names)
    nodes = elements.filter("kind = 'node'").select("number", "e._id", "e.data").select(
        F.col("_id").alias("node_id"), F.col("number").alias("node_seq"), attributes.alias("attributes")
    )
    nodes = nodes.groupBy("node_id").agg(
        F.max_by("attributes", "node_seq").alias("attributes"), F.min("node_seq").alias("node_seq")
    ).select("node_id", "node_seq", "attributes")
    edges = elements.filter("kind = 'edge'").select("number", "e._id", "e._source", "e._target", "e.data").select(
        F.coalesce("_id", F.concat(F.lit("edge-"), F.col("number").cast("string"))).alias("edge_id"),
        F.col("_source").alias("source"),
        F.col("_target").alias("target"),
        F.col("number").alias("edge_seq"),
        attributes.alias("attributes"),
    )
    size = spark.read.format("binaryFile").load(path).select(F.sum("length")).first()[0]  # the listing; no content is read
    return GraphFile(nodes, edges, default == "directed", size, default)


# -- writer ------------------------------------------------------------------


def _escape(value: Column, quote: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")]
    for raw, safe in pairs:
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def _data_lines(key_ids: dict[str, str]) -> Column:
    """<data> elements of the attribute map, in declaration order."""
    pairs = [part for item in key_ids.items() for part in (F.lit(item[0]), F.lit(item[1]))]
    ids = F.create_map(*pairs)
    names = F.array(*[F.lit(n) for n in key_ids])

    def lines(attributes: Column) -> Column:
        return F.transform(
            F.filter(names, lambda n: F.map_contains_key(attributes, n)),
            lambda n: F.concat(
                F.lit('<data key="'),
                F.try_element_at(ids, n),
                F.lit('">'),
                _escape(F.try_element_at(attributes, n)),
                F.lit("</data>"),
            ),
        )

    # one element of an array, so that the map is made once and not for each of its names
    return F.array_join(F.get(F.transform(F.array("attributes"), lines), F.lit(0)), "")


def write_graphml(
    nodes: DataFrame,
    edges: DataFrame,
    path: str,
    *,
    graph_id: str,
    node_keys: tuple[str, ...] = NODE_COLUMNS,
    edge_keys: tuple[str, ...] = EDGE_COLUMNS,
    node_order: str = "node_id",
    edge_order: str = "edge_id",
    edge_default: str = "directed",
) -> None:
    """Write a directory of ordered text parts that together are one document.

    Executors render and range-sort the elements; joined in the order of their
    names the parts are one file.
    """
    names = [("node", n) for n in node_keys] + [("edge", n) for n in edge_keys]
    ids = {name: f"d{i}" for i, name in enumerate(names)}
    declared = "".join(
        f'<key id="{ids[(kind, name)]}" for="{kind}" attr.name="{name}" attr.type="string" />'
        for kind, name in names
    )
    head = (
        f"<?xml version='1.0' encoding='utf-8'?>\n<graphml xmlns=\"{NAMESPACE}\">{declared}"
        f'<graph id="{graph_id}" edgedefault="{edge_default}">'
    )
    spark = nodes.sparkSession

    def rows(section: int, order: Column, text: Column, df: DataFrame) -> DataFrame:
        return df.select(F.lit(section).alias("part"), order.alias("place"), text.alias("value"))

    def padded(name: str) -> Column:
        """Numbers are zero-padded so that text order is numeric order."""
        is_number = name.endswith("_seq")
        return F.lpad(F.col(name).cast("string"), 40, "0") if is_number else F.col(name)

    node_text = F.concat(
        F.lit('<node id="'),
        _escape(F.col("node_id"), True),
        F.lit('">'),
        _data_lines({n: ids[("node", n)] for n in node_keys}),
        F.lit("</node>"),
    )
    edge_text = F.concat(
        F.lit('<edge id="'),
        _escape(F.col("edge_id"), True),
        F.lit('" source="'),
        _escape(F.col("source"), True),
        F.lit('" target="'),
        _escape(F.col("target"), True),
        F.lit('">'),
        _data_lines({n: ids[("edge", n)] for n in edge_keys}),
        F.lit("</edge>"),
    )
    frame = spark.createDataFrame(
        [(0, "", head), (3, "", "</graph></graphml>")], "part int, place string, value string"
    )
    document = frame.unionByName(rows(1, padded(node_order), node_text, nodes)).unionByName(
        rows(2, padded(edge_order), edge_text, edges)
    )
    # the order is sampled first: rendered rows are kept, so that only their places are read for it
    stored(document, name="elements").orderBy("part", "place").select("value").write.text(path)
