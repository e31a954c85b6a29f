"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Every source's documents are shuffled into one stream of words and the stream is
cut into blocks of equal words.  Slot ``i`` of the mix maps the golden-ratio point
``frac((i + 1) * phi)`` through the cumulative weights to a source; the r-th slot of
a source takes block ``r`` of its stream, going round once more where a target is
above the size.  Because the points have low discrepancy, every stretch of the mix
holds the sources in their target shares within a few blocks.  Sources whose target is under
``LEAST_SLOTS`` blocks have a schedule of their own with blocks ``LEAST_SLOTS`` times smaller, and so
on down to blocks of one word: every source, however small, comes within a few thousandths of its target
(a few words, if it has few).

Defined cases: a null or blank text has size 0 and is taken zero times; a null source
is a source of its own, ordered last; an empty table gives an empty mix; repeated rows
are kept apart (their positions in the stream differ); columns of the input that are
named like an output column are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, row_of, word_count

# The weights that sources take in turn.
WEIGHTS = (3, 1, 2)
GOLDEN = 0.6180339887498949
SLOTS = 1 << 20
LEAST_BLOCK = 16
LEAST_SLOTS = 1024
_SLOT_CHUNK = 4096
_POINT_BINS = 1024


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Sources with their weight and target (source, source_size, target).

    Targets are ``min(most * size, lambda * weight)`` with the lambda that uses up
    ``share`` of all words: what sharing the excess again by weight converges to.
    One row per source is all that moves here.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = by_source.withColumn(
        "at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("at").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("light", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("heavy", F.sum("weight").over(everything) - F.col("light"))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("heavy"))
        # the first source, from the tightest, that its share leaves below the cap sets the level for all after it
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("lambda", F.min_by("level", F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "at"))).over(everything))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "at"))).over(everything))
    )
    own = F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("at"))
    target = F.when(F.col("first").isNull() | (own < F.col("first")), F.col("cap")).otherwise(F.col("lambda") * F.col("weight"))
    return level.select("source", "at", "source_size", target.cast("double").alias("target"))


def _stream(sized: DataFrame, seed: int, per_bucket: int = 50_000) -> DataFrame:
    """Each document's place in its source's shuffled stream of words (key, source, size, start).

    The running sum is taken inside hash buckets and the buckets are added up, so a
    source with a third of all rows is spread over as many tasks as it has buckets.
    """
    rows = sized.count()
    buckets = 1 << max(6, math.ceil(math.log2(max(1, rows / per_bucket))))
    if buckets > 1 << 28:
        raise ValueError("too many buckets")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    placed = sized.withColumn("order", order).withColumn(
        "bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") / F.lit((1 << 28) // buckets))
    )
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("offset")
    )
    inside = (
        Window.partitionBy("source", "bucket").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))
    ).select("key", "source", "size", (F.col("local") + F.col("offset")).alias("start"))


def block_sizes(wanted: float, slots: int = SLOTS) -> list[int]:
    """Block sizes from the largest, for sources with the largest targets, down to one word."""
    sizes = [max(LEAST_BLOCK, math.ceil(wanted / slots))]
    while sizes[-1] > 1:
        sizes.append(math.ceil(sizes[-1] / LEAST_SLOTS))
    return sizes


def with_blocks(target: DataFrame, sizes: list[int]) -> DataFrame:
    """``target`` with the ``block`` of each source: the largest that its target holds ``LEAST_SLOTS`` times, else 1."""
    fitting = [F.when(F.col("target") >= LEAST_SLOTS * size, F.lit(size)) for size in sizes]
    return target.withColumn("block", F.coalesce(*fitting, F.lit(1)).cast("long"))


def schedule(target: DataFrame) -> DataFrame:
    """The mix as slots (block, slot, source number ``at``, rank of the slot in its source).

    ``target`` is (at, target, block); sources of one block size share a schedule, whose slots are
    numbered from 0.  Slot i of n stands at the fraction i / n of the mix.
    """
    spark = target.sparkSession
    open_ = target.filter("target > 0")
    # a handful of rows: each block size is ``LEAST_SLOTS`` times smaller than the one before
    totals = open_.groupBy("block").agg(F.sum("target").alias("words")).collect()
    # as many slots as fill the targets, rounded up
    numbers = {r.block: math.ceil(round(r.words, 3) / r.block) for r in totals} or {1: 0}
    points = reduce(DataFrame.union, [
        spark.range(n).select(F.lit(block).cast("long").alias("block"), F.col("id").alias("slot")) for block, n in numbers.items()
    ])
    point = (F.col("slot") + 1) * F.lit(GOLDEN) - F.floor((F.col("slot") + 1) * F.lit(GOLDEN))
    points = points.withColumn("point", point).withColumn("bin", F.floor(F.col("point") * _POINT_BINS))
    together, running = Window.partitionBy("block"), Window.partitionBy("block").orderBy("at")
    upto = F.sum("target").over(running.rowsBetween(Window.unboundedPreceding, 0))
    ranges = open_.select(
        "block", "at", ((upto - F.col("target")) / F.sum("target").over(together)).alias("low"),
        (upto / F.sum("target").over(together)).alias("high"), F.lead("at").over(running).isNull().alias("last"),
    )
    binned = ranges.withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("low") * _POINT_BINS), F.least(F.floor(F.col("high") * _POINT_BINS), F.lit(_POINT_BINS - 1))))
    )
    mapped = points.join(binned, ["block", "bin"]).filter(
        (F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | F.col("last"))
    ).select("block", "slot", "at", F.floor(F.col("slot") / _SLOT_CHUNK).alias("chunk"))
    # ranks inside chunks of slots, chunks added up: no source's slots meet in one task
    counts = mapped.groupBy("at", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("at", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("at", "chunk").orderBy("slot")
    return mapped.withColumn("local", F.row_number().over(inside) - 1).join(offsets, ["at", "chunk"]).select(
        "block", "slot", "at", (F.col("local") + F.col("offset")).alias("rank")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size, row): each row with a key of its own, the same in every run.

    The key is the id, a hash of the whole row and a number among equal rows.
    """
    content = F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        content.alias("content"), row_of(docs).alias("row"),
    )
    twin = F.row_number().over(Window.partitionBy("doc_id", "content").orderBy("size"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("content").cast("string"), F.col("twin").cast("string"))
    return sized.withColumn("twin", twin).select(key.alias("key"), "doc_id", "source", "size", "row")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    slots: int = SLOTS,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id, text, source, ...) to target weights.

    Returns the documents with their row key, the targets, and the pieces of the mix:
    (key, block, slot, round, piece_start, piece_words) - the words of a document that a slot takes,
    counted from the document's first word; going round again repeats them.  The
    large sources share about ``slots`` slots (fewer only where a block would have under ``LEAST_BLOCK``
    words), whatever the size of the corpus; small ones have blocks of their own size (:func:`schedule`).
    """
    keyed = reliable(_keyed(docs).select("key", "doc_id", "source", "size"))
    words = keyed.agg(F.sum("size")).first()[0] or 0
    sizes = block_sizes(words * min(share, most), slots)
    target = reliable(with_blocks(targets(keyed, weights, share, most), sizes))
    dealt = reliable(schedule(target.select("at", "target", "block")))
    given = dealt.groupBy("at").agg(F.count("*").alias("given"))
    streamed = _stream(keyed.filter("size > 0"), seed).join(
        target.join(given, "at").select(F.col("source").alias("of"), "at", "source_size", "block", "given"),
        F.col("source").eqNullSafe(F.col("of")),
    )
    rounds = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))).alias("round")
    begin = F.col("start") + F.col("round") * F.col("source_size")
    # what lies behind the source's last slot is in no block
    laid = streamed.select("*", rounds).withColumn("low", begin).withColumn("high", begin + F.col("size")).filter(
        F.col("low") < F.col("given") * F.col("block")
    )
    last = F.least(F.floor((F.col("high") - 1) / F.col("block")), F.col("given") - 1)
    pieces = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / F.col("block")), last))).drop("block")
    taken = dealt.join(pieces, ["at", "rank"]).select(
        "key", "block", "slot", "round",
        (F.greatest("low", F.col("rank") * F.col("block")) - F.col("low")).alias("piece_start"),
        (F.least("high", (F.col("rank") + 1) * F.col("block")) - F.greatest("low", F.col("rank") * F.col("block"))).alias("piece_words"),
    )
    return keyed, target, taken


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document: how many of its words the mix takes."""
    keyed, target, taken = mix(docs, **options)
    words = taken.groupBy("key").agg(F.sum("piece_words").alias("taken"))
    out = keyed.join(words, "key", "left").join(
        target.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))
    )
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document once for every round that takes it, with the text it takes.

    A document at the edge of what a source gives is cut after its last taken word; all
    others are whole.  The columns are those of ``docs``; rows in no round, and rows without
    a word, are not in the mix.
    """
    _, _, taken = mix(docs, **options)
    rounds = taken.groupBy("key", "round").agg(F.sum("piece_words").alias("words"))
    both = _keyed(docs).select("key", "size", "row").join(rounds, "key")
    text = F.col("row")["text"]
    blank = r"[\x20\x09-\x0D]+"
    leading = F.regexp_like(text, F.lit(f"^{blank}")).cast("int")
    rest = F.element_at(F.split(text, blank, (F.col("words") + 1 + leading).cast("int")), -1)
    cut = F.when(F.col("words") >= F.col("size"), text).otherwise(
        F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), f"{blank}$", "")
    )
    return both.select(
        *[cut.alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )
