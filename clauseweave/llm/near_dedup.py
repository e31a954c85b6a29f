"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, hashed once to 64 bits.  Its sketch is
the ``SKETCH`` smallest hashes.  Documents with equal sets are one class from the start (one
representative goes on, the copies join it by their fingerprint).  Then:

* inverted lists: two sets with a Jaccard similarity of 0.75 share a number of sketch values
  that falls short of its mean by ``DEVIATIONS`` deviations but once in 10**9, so each sketch
  is looked up only by as many of its rarest values as make one hit certain, and a hit counts
  only if enough values follow it in both; a value that very many documents share is never
  looked up unless it fills most of a document;
* rounds of leaders: a list links each member to one leader (one row per member, never all
  pairs), first the smallest id, then another one each round, and only across the components
  found so far; a document's most promising leaders are estimated by their union sketch, and
  full sets verify the best.  One round connects most of a group of near copies; another one
  is made only while the comparisons it leaves are many more than the documents;
* documents that still share a list in different components meet under the list's smallest
  component and are compared there on full sets, in blocks that put out links only.  So no
  link between different texts is lost.

Components are exact for the verified links.

Defined cases: null and empty texts and texts without words have an empty set and are linked
with nothing; with one to four words the whole sequence is the one shingle; repeated rows and
equal texts are copies; a repeated doc_id counts as one document, the union of its rows' links;
ties go to the smaller doc_id; a row without a doc_id has the component of the documents with its very set and is not
kept, or no component if there are none and is kept; texts of any length are read whole, and one above ``BLOCK``
shingles makes its block as much larger; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, freed_shuffles, reliable, small_batches
from .components import connected
from .text_hash import mix, text_shingles

SKETCH = 128
PERCENT = 75
# the estimate may miss the threshold by so many standard deviations
DEVIATIONS = 6.0
# leaders of a document that a round estimates, and that it verifies
ESTIMATED, VERIFIED = 4, 2
MOST_ROUNDS = 4
# comparisons for each document that the rounds may leave to the last step
LEFT = 512
# shingles of the documents that a block holds (some 6 MB of text); groups of so few share a block
BLOCK, SMALL = 1 << 20, 1 << 16
# ids that may be broadcast (8 MB)
BROADCAST_IDS = 1_000_000

_TOP = np.uint64(1 << 63)
_SECOND = np.uint64(0xA0761D6478BD642F)
_FEATURES = "doc_id long, n_shingles long, low long, high long, sketch array<long>"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fingerprint low and high, sketch in rising order)."""

    def sketched(batches):
        for batch in batches:
            sizes, low, high, kept = [], [], [], []
            for hashes in text_shingles(batch.column(1)):
                every = np.unique(hashes)
                sizes.append(len(every))
                low.append(int(mix(every).sum(dtype=np.uint64).view(np.int64)))
                high.append(int(mix(every ^ _SECOND).sum(dtype=np.uint64).view(np.int64)))
                kept.append((every[:SKETCH] ^ _TOP).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "low", "high", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sketched, _FEATURES)


def _needed(total) -> Column:
    """Sketch values that two sets with ``total`` values together share if they are linked.

    At the threshold their union has total / 1.75 values, of which the sketches show the
    smallest ``SKETCH`` as a sample without replacement; whole sketches give the exact number.
    """
    share = PERCENT / 100
    union = total / F.lit(1 + share)
    shown = F.least(union, F.lit(float(SKETCH)))
    spread = F.sqrt(shown * F.lit(share * (1 - share)) * F.greatest(F.lit(0.0), 1 - shown / union))
    return F.greatest(F.lit(1), F.ceil(shown * F.lit(share) - F.lit(DEVIATIONS) * spread - F.lit(1e-6)))


def _lists(sets: DataFrame) -> DataFrame:
    """Rows (value, doc, n, rest) of the inverted lists that have more than one member.

    Only the rarest values of each sketch are listed; ``rest`` is how many of its values,
    from this one on, are left in the order from rare to frequent.
    """
    rows = sets.select("doc", F.explode("sketch").alias("value"))
    often = F.count("*").over(Window.partitionBy("value"))
    shared = rows.withColumn("df", often).filter("df > 1")
    sizes = sets.select("doc", "n", F.size("sketch").alias("kept"))
    # partners have 0.75 to 1 / 0.75 of its values; what is needed is least at one of the ends
    needed = F.least(_needed(F.col("n") * F.lit(1 + PERCENT / 100)), _needed(F.col("n") * F.lit(1 + 100 / PERCENT)))
    own = Window.partitionBy("doc")
    # values of its own come first in a document's order: they are its rarest
    at = F.row_number().over(own.orderBy("df", "value")) + F.col("kept") - F.count("*").over(own)
    ranked = shared.join(sizes, "doc").withColumn("rest", (F.col("kept") - at + 1).cast("int"))
    return ranked.filter(F.col("rest") >= needed).select("value", "doc", "n", "rest")


def _near_sizes(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``estimate``, and ``possible``: whether it leaves the threshold possible.

    The smallest values of the union are a sample of it without replacement; at the
    threshold the union has (n_a + n_b) / 1.75 values.
    """
    left = sets.select(F.col("doc").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = sets.select(F.col("doc").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    top = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    size = F.size(top)
    estimate = F.size(F.array_intersect(top, F.array_intersect("sa", "sb"))) / size
    share = PERCENT / 100
    rest = F.greatest(F.lit(0.0), 1 - size * (1 + share) / (F.col("na") + F.col("nb")))
    least = F.lit(share) - F.lit(DEVIATIONS) * F.sqrt(F.lit(share * (1 - share)) / size * rest) - F.lit(1e-9)
    kept = pairs.columns
    both = pairs.join(left, "a").join(right, "b").withColumn("estimate", estimate)
    return both.withColumn("possible", F.col("estimate") >= least).select(*kept, "estimate", "possible")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among ``pairs`` (lead, doc, n): the full shingle sets reach the threshold.

    The documents of a leader meet in blocks of about ``BLOCK`` shingles, to each of which the
    leader's text is sent once; leaders with few shingles to compare share a block.
    """
    sizes = reliable(pairs.groupBy("lead").agg(F.sum("n").alias("weight")))
    name, parts = _names(sizes, "lead"), F.floor(F.col("weight") / BLOCK) + 1
    sizes = sizes.select("lead", name.alias("name"), F.when(F.col("weight") <= SMALL, F.lit(1)).otherwise(parts).alias("parts"))
    members = pairs.join(sizes, "lead").select("name", F.pmod(F.xxhash64("doc"), "parts").alias("part"), "lead", "doc").join(texts, "doc")
    leaders = sizes.select("name", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    leaders = leaders.join(texts.select(F.col("doc").alias("lead"), F.col("text").alias("lead_text")), "lead")
    leaders = leaders.select(F.col("name").alias("of"), F.col("part").alias("at"), F.col("lead").alias("led"), "lead_text")
    members = members.select("name", "part", "lead", "doc", "text")

    def confirmed(led: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        of_leader = dict(iter(members.groupby("lead")))
        for lead, text in zip(led.led, led.lead_text, strict=True):
            if (asked := of_leader.get(lead)) is not None:
                (own,) = map(np.unique, text_shingles(pa.array([text], pa.large_string())))
                for doc, hashes in zip(asked.doc, text_shingles(pa.array(asked.text, pa.large_string())), strict=True):
                    if _linked(own, np.unique(hashes)):
                        out.append((min(lead, doc), max(lead, doc)))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return leaders.groupBy("of", "at").cogroup(members.groupBy("name", "part")).applyInPandas(confirmed, "a long, b long")


def _names(sizes: DataFrame, key: str) -> Column:
    """Names of groups for rows (key, weight): those of small weight share some of about ``BLOCK`` shingles together."""
    small = F.col("weight") <= SMALL
    groups = (sizes.filter(small).agg(F.sum("weight")).first()[0] or 0) // BLOCK + 1
    shared = F.pmod(F.xxhash64(key), F.lit(groups)).cast("string")
    return F.when(small, shared).otherwise(F.concat(F.lit("of "), F.col(key).cast("string")))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return bool(shared) and 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of their document, itself where nothing is found."""
    return rows.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc")
    )


def _open(placed: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one component."""
    mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return placed.join(mixed.select("value"), "value")


def _led(lists: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """(doc, lead, a, b, hits): documents with the leaders of their lists, across components only.

    The leader of the first round is the smallest id, later ones go by a hash.
    """
    rows = lists.withColumn("component", F.col("doc")) if not number else _open(_placed(lists, found))
    turn = F.lit(0) if not number else F.xxhash64("value", "doc", F.lit(number))
    leaders = rows.groupBy("value").agg(
        F.min(F.struct(turn.alias("turn"), F.col("doc").alias("lead"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("component").alias("other"))).alias("l")
    )
    led = rows.join(leaders, "value").filter(F.col("component") != F.col("l.other")).filter(_near_sizes("n", "l.m"))
    led = led.filter(F.least("rest", "l.left") >= _needed(F.col("n") + F.col("l.m")))
    pairs = led.groupBy("doc", "l.lead").agg(F.count("*").alias("hits"))
    return pairs.select("doc", "lead", F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b"), "hits")


def _left(lists: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """What the components still share: (head, doc, component, n), (head, weight, asking), and whether it is much to compare.

    The documents of a list meet under its smallest component: one row for each document and
    such head, however many lists they share.
    """
    placed = _placed(lists, found)
    heads = placed.groupBy("value").agg(F.min("component").alias("head"), F.max("component").alias("high")).filter("head < high")
    rows = reliable(placed.join(heads.select("value", "head"), "value").select("head", "doc", "component", "n").distinct())
    other = F.col("component") != F.col("head")
    sizes = reliable(rows.groupBy("head").agg(
        F.sum("n").alias("weight"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("asking"),
        F.count("*").alias("docs"), F.count_if(other).alias("asked"),
    ))
    docs, pairs = sizes.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("asked"))).first()
    return rows, sizes.select("head", "weight", "asking"), (pairs or 0) > LEFT * (docs or 0)


def _across(rows: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components which still share a list and hold linked documents.

    Under a head every document that is not of the head itself is compared with all, on full
    sets and in blocks; only links that connect something are put out.
    """
    # small heads share a group, a large one has groups of its own
    cut = lambda n: F.when(F.col("weight") <= SMALL, F.lit(1)).otherwise(F.floor(F.col(n) / BLOCK) + 1).cast("long")
    sizes = sizes.select("head", _names(sizes, "head").alias("name"), cut("weight").alias("blocks"), cut("asking").alias("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = rows.join(sizes, "head")
    asked = whole.filter("component <> head").withColumn("part", F.pmod(F.xxhash64("doc"), "parts")).withColumn("block", numbers("blocks"))
    held = whole.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(1)), "blocks")).withColumn("part", numbers("parts"))
    keys = ("name", "block", "part")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        columns = (*keys, "head", "component", "doc", "text")
        named = df.join(texts, "doc").select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        return named.groupBy(*[f"{prefix}_{k}" for k in keys])

    return side(asked, "asked").cogroup(side(held, "held")).applyInPandas(_block_links, "a long, b long")


def _block_links(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Links that connect asked documents with held ones under the same head."""
    out: list[tuple[int, int]] = []
    for head, part in asked.groupby("asked_head"):
        block = held[held.held_head == head]
        if len(block):
            out += _spanning(part, block)
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _spanning(asked: pd.DataFrame, block: pd.DataFrame) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    sets = [np.unique(x) for x in text_shingles(pa.array(block.held_text, pa.large_string()))]
    sizes = np.array([len(x) for x in sets])
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    docs, components = block.held_doc.to_numpy(), block.held_component.to_numpy()
    out = []
    asking = zip(asked.asked_doc, asked.asked_component, text_shingles(pa.array(asked.asked_text, pa.large_string())), strict=True)
    for doc, component, hashes in asking:
        own = np.unique(hashes)
        low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        length = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        linked = (shared > 0) & (100 * shared >= PERCENT * (sizes + len(own) - shared)) & (components != component)
        for other in np.flatnonzero(linked):
            x, y = find(int(component)), find(int(components[other]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(doc, int(docs[other])), max(doc, int(docs[other]))))
    return out


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest linked doc_id) and kept (it is that one)."""
    with freed_shuffles(docs.sparkSession):
        return _components(docs, text)


def _components(docs: DataFrame, text: str) -> DataFrame:
    every = reliable(features(docs, text))
    classes = every.filter("n_shingles > 0").groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("doc"))
    classes = reliable(classes)
    whole = every.join(classes, ["n_shingles", "low", "high"]).filter("doc_id = doc").dropDuplicates(["doc", "low", "high"])
    whole = whole.select("doc", F.col("n_shingles").alias("n"), "sketch")
    lists = reliable(_lists(whole))
    involved = reliable(lists.select("doc").distinct())
    if involved.count() <= BROADCAST_IDS:
        involved = F.broadcast(involved)
    sets = reliable(whole.join(involved, "doc", "left_semi"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    texts = reliable(rows.join(involved, "doc", "left_semi"))

    spark = docs.sparkSession
    found = spark.createDataFrame([], "node long, component long")
    for number in range(MOST_ROUNDS):
        pairs = _led(lists, found, number)
        if number:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        by_hits = Window.partitionBy("doc").orderBy(F.desc("hits"), "a", "b")
        pairs = pairs.withColumn("rank", F.row_number().over(by_hits)).filter(F.col("rank") <= ESTIMATED).drop("rank")
        judged = _estimated(pairs, sets)
        by_estimate = Window.partitionBy("doc", "possible").orderBy(F.desc("estimate"), "a", "b")
        judged = judged.withColumn("rank", F.row_number().over(by_estimate)).filter(~F.col("possible") | (F.col("rank") <= VERIFIED))
        judged = reliable(judged.groupBy("a", "b").agg(F.bool_or("possible").alias("possible"), F.min("lead").alias("lead")))
        asked = judged.filter("possible").select("lead", (F.col("a") + F.col("b") - F.col("lead")).alias("doc"))
        with small_batches(spark):
            new = reliable(_verified(asked.join(whole.select("doc", "n"), "doc"), texts))
        if number and not new.take(1):
            break
        # what a round leaves goes before the next
        if number:
            before, known, old, gone = tried, links, found, left
            tried, links = reliable(tried.select("a", "b").union(judged.select("a", "b"))), reliable(links.union(new))
            found = reliable(connected(links))
            discard(judged, new, before, known, old, gone)
        else:
            tried, links, found = judged, new, reliable(connected(new))
        left, sizes, much = _left(lists, found)
        if not much:
            break

    with small_batches(spark):
        more = reliable(_across(left, sizes, texts))
    if more.take(1):
        found = reliable(connected(links.union(more)))

    of_class = classes.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select(
        "n_shingles", "low", "high", F.coalesce("component", "doc").alias("component")
    )
    out = every.select("doc_id", "n_shingles", "low", "high").join(of_class, ["n_shingles", "low", "high"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))
