"""Queries over a property graph: resolve, inspect, neighbours, bounded paths.

Graph tables: nodes(node_id, node_seq, attributes) and
edges(edge_id, source, target, edge_seq, attributes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import length_bound, matching_ratio
from ..functions.text import casefold, normalize_entity, normalize_entity_literal, split_values
from ..session import among, broadcast_within, freed_shuffles, materialize, stored, top_k_per_group

FUZZY_CUTOFF = 0.45
CONFIDENT_MATCH = 0.5


def attribute(name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(default))


def node_label() -> Column:
    return F.coalesce(F.nullif(attribute("entity_id"), F.lit("")), F.col("node_id"))


def edge_relations() -> Column:
    return split_values(attribute("keywords"))


# -- entity resolution ------------------------------------------------------


def resolve_entities(nodes: DataFrame, query: str, *, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """Nodes ranked against a term: exact, whole token, substring, then fuzzy.

    The query is one literal, so this is a projection over the nodes; only
    labels the first three tests leave open (and whose length can still reach
    the cutoff) are handed to the Python matcher.
    """
    wanted = normalize_entity_literal(query)
    if not wanted or limit < 1:
        return nodes.limit(0).select(
            "node_id", F.lit("").alias("label"), F.lit(0.0).alias("score"), F.lit("").alias("method")
        )
    label = F.col("normalized")
    size = F.lit(len(wanted))
    coverage = F.least(size, F.char_length(label)) / F.greatest(size, F.char_length(label))
    method = (
        F.when(label == wanted, "exact")
        .when(F.array_contains(F.split(label, " "), wanted), "token")
        .when(F.contains(label, F.lit(wanted)) | F.contains(F.lit(wanted), label), "substring")
    )
    open_label = F.when(
        F.col("method").isNull() & (length_bound(F.lit(wanted), label) >= FUZZY_CUTOFF), label
    )
    named = nodes.select(
        "node_id",
        "node_seq",
        node_label().alias("label"),
        normalize_entity(node_label()).alias("normalized"),
    ).withColumn("method", method)
    score = (
        F.when(F.col("method") == "exact", F.lit(1.0))
        .when(F.col("method") == "token", F.lit(0.98))
        .when(F.col("method") == "substring", F.lit(0.85) + F.lit(0.14) * coverage)
    )
    if fuzzy:
        named = named.withColumn("ratio", matching_ratio(wanted, open_label, FUZZY_CUTOFF))
        score = F.coalesce(score, F.col("ratio"))
    ranked = named.withColumn("score", score).filter(F.col("score").isNotNull())
    return (
        ranked.withColumn("method", F.coalesce("method", F.lit("fuzzy")))
        .orderBy(
            F.col("score").desc(), F.char_length("label"), casefold(F.col("label")), "node_seq"
        )
        .limit(limit)
        .select("node_id", "label", "score", "method")
    )


def _width(text: Column) -> Column:
    """The largest power of two that is no longer than a text."""
    return F.pow(F.lit(2.0), F.length(F.bin(F.char_length(text))) - 1).cast("int")


def _runs(text: Column, width: Column) -> Column:
    """All runs of ``width`` characters of a text that is as long at least."""
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - width + 1), lambda at: F.substr(text, at, width))


def _grams(text: Column, widths: list[int]) -> Column:
    """Distinct runs of the given widths."""
    none = F.array().cast("array<string>")
    runs = [F.when(F.char_length(text) >= width, _runs(text, F.lit(width))).otherwise(none) for width in widths]
    return F.array_distinct(F.concat(none, *runs))


def _held_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): distinct non-empty texts and those they occur in.

    A text is looked up by the rarest of its runs of more than half its length in an inverted index
    of the outer texts' runs of such widths; so few are looked up in vain, however many texts there
    are.  The larger side is cut to runs that the smaller one has before anything is shuffled.
    """
    widths = sorted(r[0] for r in inner.select(_width(F.col("inner"))).distinct().collect())  # powers of two
    own = lambda texts: texts.select("inner", F.explode(F.array_distinct(_runs(F.col("inner"), _width(F.col("inner"))))).alias("gram"))
    index = outer.select("outer", F.explode(_grams(F.col("outer"), widths)).alias("gram"))
    if inner.count() <= outer.count():
        index = materialize(index.join(broadcast_within(own(inner).select("gram").distinct()), "gram", "left_semi"))
    else:
        index = materialize(index)
        first = inner.withColumn("gram", F.substr("inner", F.lit(1), _width(F.col("inner"))))
        inner = materialize(first.join(broadcast_within(index.select("gram").distinct()), "gram", "left_semi").select("inner"))
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own(inner).join(counts, "gram", "left").groupBy("inner").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")
    )
    found = index.join(rarest.select("inner", F.col("least.gram").alias("gram")), "gram")
    return found.filter(F.contains("outer", F.col("inner"))).select("inner", "outer")


def resolve_many(nodes: DataFrame, terms: DataFrame, *, limit: int = 10) -> DataFrame:
    """(term_id, rank, node_id, label, score, method) for every row of ``terms`` (term_id, term).

    The rules of :func:`resolve_entities` without the fuzzy one, as joins of distinct folded
    texts: equal ones, one word of a label, and texts held in one another by an index of runs of
    characters.  Nodes are fetched for the labels found.  Terms that fold to nothing have no row.
    """
    named = nodes.select("node_id", "node_seq", node_label().alias("label"), normalize_entity(node_label()).alias("normalized"))
    named = stored(named, name="named")  # folded once, read three times
    wanted = materialize(terms.select("term_id", normalize_entity(F.col("term")).alias("wanted")).filter(F.col("wanted") != ""))
    some = stored(named.filter(F.col("normalized") != "").select("normalized").distinct(), name="labels")
    texts = materialize(wanted.select("wanted").distinct())
    few_texts = broadcast_within(texts)
    exact = some.join(few_texts, F.col("wanted") == F.col("normalized")).select("wanted", "normalized", F.lit(0).alias("order"))
    words = some.select("normalized", F.explode(F.array_distinct(F.split("normalized", " "))).alias("wanted"))
    token = words.join(few_texts, "wanted").select("wanted", "normalized", F.lit(1).alias("order"))
    as_text = lambda df, column, name: df.select(F.col(column).alias(name))
    inside = _held_in(as_text(texts, "wanted", "inner"), as_text(some, "normalized", "outer"))
    around = _held_in(as_text(some, "normalized", "inner"), as_text(texts, "wanted", "outer"))
    held = inside.select(F.col("inner").alias("wanted"), F.col("outer").alias("normalized")).unionByName(
        around.select(F.col("outer").alias("wanted"), F.col("inner").alias("normalized"))
    )
    pairs = exact.unionByName(token).unionByName(held.withColumn("order", F.lit(2)))
    best = materialize(pairs.groupBy("wanted", "normalized").agg(F.min("order").alias("order")))
    size = lambda column: F.char_length(column)
    coverage = F.least(size("wanted"), size("normalized")) / F.greatest(size("wanted"), size("normalized"))
    score = F.when(F.col("order") == 0, F.lit(1.0)).when(F.col("order") == 1, F.lit(0.98)).otherwise(F.lit(0.85) + F.lit(0.14) * coverage)
    found = named.join(broadcast_within(best.withColumn("score", score)), "normalized")
    order = [F.col("score").desc(), F.char_length("label"), casefold(F.col("label")), F.col("node_seq")]
    columns = ["wanted", "node_id", "node_seq", "label", "score", "order"]
    # a label that folds to nothing is held in every term, with the least score: the first few serve for all
    blank = named.filter(F.col("normalized") == "").withColumn("score", F.lit(0.85)).orderBy(*order).limit(limit)
    few = F.broadcast(blank.select(F.lit(1).alias("_one"), "node_id", "node_seq", "label", "score"))  # at most ``limit`` rows
    blanks = texts.withColumn("_one", F.lit(1)).join(few, "_one").withColumn("order", F.lit(2))
    ranked = top_k_per_group(found.select(*columns).unionByName(blanks.select(*columns)), ["wanted"], order, limit)
    method = F.when(F.col("order") == 0, "exact").when(F.col("order") == 1, "token").otherwise("substring")
    return wanted.join(ranked, "wanted").select("term_id", "rank", "node_id", "label", "score", method.alias("method"))


def best_entity(nodes: DataFrame, query: str) -> dict:
    """The single confident match of a term."""
    row = resolve_entities(nodes, query, limit=1).first()
    if row is None or row["score"] < CONFIDENT_MATCH:
        raise ValueError(f"no confident graph entity match for: {query}")
    return row.asDict()


# -- degree and neighbours --------------------------------------------------


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, incoming_count, outgoing_count); a self-loop counts both ways.

    One pass over the edges: both endpoints are counted map-side first.
    """
    one, zero = F.lit(1), F.lit(0)
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("node_id"), zero.alias("into"), one.alias("out")),
                F.struct(F.col("target").alias("node_id"), one.alias("into"), zero.alias("out")),
            )
        ).alias("e")
    ).select("e.*")
    counted = ends.groupBy("node_id").agg(F.sum("into").alias("into"), F.sum("out").alias("out"))
    return nodes.select("node_id").join(counted, "node_id", "left").select(
        "node_id",
        F.coalesce("into", F.lit(0)).alias("incoming_count"),
        F.coalesce("out", F.lit(0)).alias("outgoing_count"),
    )


def node_view(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row: the node, its label and its degrees."""
    node = nodes.filter(F.col("node_id") == node_id)
    if node.isEmpty():
        raise KeyError(node_id)
    touching = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    return degrees(node, touching).join(
        node.select("node_id", node_label().alias("label"), "attributes"), "node_id"
    )


def neighbors(
    edges: DataFrame,
    node_id: str,
    *,
    direction: str = "both",
    relation: str | None = None,
    limit: int = 50,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Edges at a node in (source, target, edge) order; with ``nodes``, checks the id."""
    if nodes is not None and nodes.filter(F.col("node_id") == node_id).isEmpty():
        raise KeyError(f"unknown graph node: {node_id}")
    if direction not in {"in", "out", "both"}:
        raise ValueError("direction must be 'in', 'out' or 'both'")
    sides = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
    found = reduce(
        lambda a, b: a.unionByName(b),
        [
            edges.filter(F.col(side) == node_id).withColumn("_side", F.lit(i))
            for i, side in enumerate(sides)
        ],
    ).withColumn("relations", edge_relations())
    if relation:
        wanted = relation.casefold()
        found = found.filter(F.exists("relations", lambda r: casefold(r) == wanted))
    order = [casefold(F.col("source")), casefold(F.col("target")), F.col("edge_id"), "_side", "edge_seq"]
    return found.orderBy(*order).limit(max(limit, 0)).drop("_side")


def label_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add both endpoint labels; an endpoint missing from the nodes is an error.

    The edges are a query's result and read twice, so they are computed once.
    (It also keeps a caller's limit from being pushed below a ranked one.)
    """
    edges = materialize(edges)
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    labels = nodes.select("node_id", node_label().alias("label"))
    labels = labels.join(broadcast_within(ends), "node_id", "left_semi")
    for end in ("source", "target"):
        side = labels.select(F.col("node_id").alias(end), F.col("label").alias(f"{end}_label"))
        edges = edges.join(side, end, "left")
    missing = F.col("source_label").isNull() | F.col("target_label").isNull()
    label = F.when(
        missing, F.raise_error(F.concat(F.lit("edge endpoint is not a node: "), F.col("edge_id")))
    ).otherwise(F.col("source_label"))
    return edges.withColumn("source_label", label)


# -- bounded simple paths ---------------------------------------------------

# Partial paths kept at first, and the most that are put in order; beyond it all are kept.
KEPT_PATHS = 1024
MOST_KEPT_PATHS = 1 << 20


def _adjacency(edges: DataFrame, directed: bool) -> DataFrame:
    out = edges.select(
        F.col("source").alias("here"),
        F.col("target").alias("there"),
        F.struct(F.lit(0).alias("dir"), F.col("edge_seq").alias("seq")).alias("step"),
        F.struct("edge_id", "source", "target", "edge_seq").alias("edge"),
    ).filter(F.col("here") != F.col("there"))
    if directed:
        return out
    back = edges.filter(F.col("source") != F.col("target")).select(
        F.col("target").alias("here"),
        F.col("source").alias("there"),
        F.struct(F.lit(1).alias("dir"), F.col("edge_seq").alias("seq")).alias("step"),
        F.struct("edge_id", "source", "target", "edge_seq").alias("edge"),
    )
    return out.unionByName(back)


def _next_layer(adjacency: DataFrame, layer: DataFrame, source: str, target: str, backwards: bool) -> DataFrame:
    """Nodes one step on from a layer (``node``), ends left out: a path passes neither in between."""
    start, stop = ("there", "here") if backwards else ("here", "there")
    near = among(adjacency.select("here", "there"), layer.withColumnRenamed("node", start))
    found = near.select(F.col(stop).alias("node")).filter(~F.col("node").isin(source, target))
    return materialize(found.distinct())


def _leading_to(adjacency: DataFrame, layer: DataFrame, following: DataFrame) -> DataFrame:
    """The nodes of a layer from which an edge leads to one of the nodes ``following``."""
    leading = among(adjacency.select("here", "there"), layer.withColumnRenamed("node", "here"), following.withColumnRenamed("node", "there"))
    return materialize(leading.select(F.col("here").alias("node")).distinct())


def _grown(adjacency: DataFrame, paths: DataFrame, allowed: DataFrame, most: int | None) -> DataFrame:
    """Partial paths one edge longer, through nodes that ``allowed`` holds and that they do not hold yet.

    With ``most`` only so many, the first in the order of their keys.  Of very many nodes allowed a few
    others may pass; such a path ends where no edge leads on.
    """
    longer = adjacency.join(broadcast_within(paths), "here").filter(~F.array_contains("visited", F.col("there")))
    longer = among(longer, allowed.withColumnRenamed("node", "there"), roughly=True).select(
        F.col("there").alias("here"),
        F.array_append("visited", F.col("there")).alias("visited"),
        F.array_append("key", F.col("step")).alias("key"),
        F.array_append("path", F.col("edge")).alias("path"),
    )
    return materialize(longer if most is None else longer.orderBy("key").limit(most))


def _first_paths(adjacency: DataFrame, seed: DataFrame, steps: list[DataFrame], limit: int) -> DataFrame:
    """The first ``limit`` paths, in the order of their keys, whose nodes after the seed are in ``steps`` one by one.

    Partial paths are cut to the first few: what is left out comes after all that is kept.  If
    too few of those reach the end, the search is made again with more, at last with all.
    """
    kept = max(KEPT_PATHS, limit)
    while True:
        most = kept if kept <= MOST_KEPT_PATHS else None
        paths, cut = seed, False
        for number, allowed in enumerate(steps, 1):
            last = number == len(steps)
            paths = _grown(adjacency, paths, allowed, limit if last else most)
            if not last and most is not None:
                cut = cut or paths.count() == most
        if not cut or paths.count() == limit:
            return paths
        kept *= 64


def find_paths(
    edges: DataFrame,
    source: str,
    target: str,
    *,
    max_hops: int = 3,
    limit: int = 5,
    directed: bool = False,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """(rank, hops, path array<struct<edge_id,source,target,edge_seq>>), shortest first.

    Paths repeat no node; parallel edges give distinct paths; ties follow edge
    order, outgoing before incoming, hop by hop.  Lengths are searched one after
    the other, and no longer one once ``limit`` paths exist.  For a length, layers
    of nodes from both ends, the smaller grown first, are narrowed to nodes on a
    walk of exactly that length, and the first paths grow through those.
    """
    if nodes is not None:
        known = nodes.filter(F.col("node_id").isin(source, target)).select("node_id").distinct()
        if known.count() < len({source, target}):
            raise KeyError("both source and target must be known graph nodes")
    if not 1 <= max_hops <= 6:
        raise ValueError("max_hops must be between 1 and 6")
    with freed_shuffles(edges.sparkSession):
        return _paths(edges, source, target, max_hops, limit, directed)


def _paths(edges: DataFrame, source: str, target: str, max_hops: int, limit: int, directed: bool) -> DataFrame:
    spark = edges.sparkSession
    seq = edges.schema["edge_seq"].dataType.simpleString()
    trail_schema = (
        f"key array<struct<dir:int,seq:{seq}>>, "
        f"path array<struct<edge_id:string,source:string,target:string,edge_seq:{seq}>>"
    )
    found_schema = f"hops int, {trail_schema}"
    adjacency = _adjacency(edges, directed)
    results = spark.createDataFrame([], found_schema)
    if source != target and limit > 0:
        end = lambda node: spark.createDataFrame([(node,)], "node string")
        seed = spark.createDataFrame([(source, [source], [], [])], f"here string, visited array<string>, {trail_schema}")
        # layer k: nodes that a walk of k edges leads to from that end
        ahead, behind = [end(source)], [end(target)]
        sizes = [1, 1]
        count = 0
        for hops in range(1, max_hops + 1):
            # length 2 needs both first layers; after it, one layer more a length
            for _ in range(2 if hops == 2 else int(hops > 2)):
                backwards = len(behind) < len(ahead) if hops == 2 else sizes[1] < sizes[0]
                side = behind if backwards else ahead
                side.append(_next_layer(adjacency, side[-1], source, target, backwards))
                sizes[backwards] = side[-1].count()
            if 0 in sizes:
                break  # no walk of this length, so none that is longer
            steps = [behind[k] for k in range(len(behind) - 1, -1, -1)]
            if hops > 1:
                steps[0] = materialize(among(ahead[-1], behind[-1]))
                if steps[0].isEmpty():
                    continue
                for layer in ahead[-2:0:-1]:
                    steps.insert(0, _leading_to(adjacency, layer, steps[0]))
            met = _first_paths(adjacency, seed, steps, limit - count)
            results = results.unionByName(met.select(F.lit(hops).alias("hops"), "key", "path"))
            count += met.count()
            if count >= limit:
                break
    best = results.orderBy("hops", "key").limit(max(limit, 0))
    rank = F.row_number().over(Window.orderBy("hops", "key"))
    return best.select(rank.alias("rank"), "hops", "path")
