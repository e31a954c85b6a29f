"""Hard negatives from blocks of vectors on a Hilbert curve.

Candidates are sorted by label and by their place on a Hilbert curve through all dimensions,
and written as Parquet, one row a block of at most ``BLOCK_ROWS`` vectors, with the smallest
and largest value of every dimension (the zone map).  For an anchor a and a block with zones
[low, high], interval arithmetic bounds every score:

    sum(min(a * low, a * high))  <=  a . x  <=  sum(max(a * low, a * high))

Positives: an anchor's own block gives its first score to beat; only blocks of its label whose
upper bound reaches it are read.  Negatives: each positive opens a window of scores; only
blocks of other labels whose bounds meet a window are read.  Bounds are computed from the
zone columns alone, which is all that is read of blocks no anchor needs.

Scores are inner products of integers, compared exactly; one beyond a long is held at the
largest or smallest long.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; vectors are compared with vectors of their own length only; rows that share an
id are rows of their own (each an anchor of its own, each a candidate, and told apart from
the anchor by row, not by id); equal scores go to the smaller id; with fewer positives or
negatives all are returned; a window below zero is empty; other columns are not read; an
empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import number_ordered
from .common import reliable, small_batches

BLOCK_ROWS = 4096
# Anchors of so many neighbouring blocks are bounded and scored together.
GROUP_BLOCKS = 32
ZONE_PAGE = 512
HILBERT_BITS = 4
LONG = (1 << 63) - 1
# Rows of a block are numbered from its number times this.
_PLACES = 2 * BLOCK_ROWS

def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of flat columns and arrays, as the DDL names them."""
    types = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    types |= {a: pa.list_(pa.struct([(c, pa.int64()) for c in fields])) for a, fields in ((_NEAR, ("row", "vec_id", "score")), (_HIT, ("positive", "row", "vec_id", "score")))}
    return pa.schema([(name, types[kind]) for name, kind in (c.split(" ", 1) for c in ddl.split(", "))])


_NEAR = "array<struct<row:long,vec_id:long,score:long>>"
_HIT = "array<struct<positive:long,row:long,vec_id:long,score:long>>"
_BLOCK = "block long, dim int, label int, n int, ids array<long>, vectors array<long>, low array<long>, high array<long>"
_ANCHOR = f"anchor long, anchor_id long, block long, dim int, label int, vector array<long>, least long, near {_NEAR}"
_NEEDED = "dim int, group long, block long, asking array<int>"
_HITS = f"anchor long, hits {_HIT}"


# --- numbers


def hilbert_keys(points: np.ndarray, bits: int = HILBERT_BITS) -> list[bytes]:
    """Place of every point (whole numbers below 2**bits) on the Hilbert curve through its dimensions.

    Axes are turned into the transposed curve index (Gray code with exchanges, from the top
    bit down), whose bits are then read across the dimensions.
    """
    n, dims = points.shape
    if not dims:
        return [b""] * n
    x = points.T.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        mask = (1 << bit) - 1
        for d in range(dims):
            on = (x[d] >> bit & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[d]) & mask)
            x[0] = np.where(on, x[0] ^ mask, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        turn = np.where(x[dims - 1] >> bit & 1, turn ^ ((1 << bit) - 1), turn)
    x ^= turn
    levels = [(x >> bit & 1).T.astype(np.uint8) for bit in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(levels, axis=1), axis=1)]


def _held(values: np.ndarray) -> np.ndarray:
    """Exact whole numbers (floats below 2**53, or Python ones) as longs, held at the ends of the range."""
    if values.dtype != object:
        return values.astype(np.int64)
    return np.array([[max(-LONG, min(LONG, int(v))) for v in line] for line in values], dtype=np.int64).reshape(values.shape)


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b`` (longs), exact."""
    reach = _largest(a) * _largest(b) * max(a.shape[1], 1)
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 1 << 63:
        return a @ b.T
    return _held(a.astype(object) @ b.astype(object).T)


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every anchor (rows) with any vector of every block (columns).

    a * low and a * high swap places with the sign of a, so each bound is two products.
    """
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    reach = _largest(anchors) * max(_largest(low), _largest(high)) * max(anchors.shape[1], 1)
    if reach < 1 << 62:
        return products(up, low) + products(down, high), products(up, high) + products(down, low)
    up, down, low, high = (x.astype(object) for x in (up, down, low, high))
    return _held(up @ low.T + down @ high.T), _held(up @ high.T + down @ low.T)


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ties to the smaller id, then the smaller row."""
    keep = np.arange(len(scores))
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return keep[np.lexsort((rows[keep], ids[keep], -scores[keep]))][:k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


# --- blocks


def whole_numbers(df: DataFrame, label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, each component floor(scale * x) of x as double."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("int").alias("label"),
        F.transform(x, lambda c: F.greatest(F.floor(c * F.lit(scale)), F.lit(-LONG))).alias("vector"),
    )


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Hilbert-ordered blocks with their zone maps, one row each, written to the shared folder."""
    vectors = reliable(vectors.withColumn("dim", F.size("vector")))
    # one grid for all dimensions, fine enough for the whole range of values
    least, greatest = vectors.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    least, greatest = least or 0, greatest or 0
    step = (greatest - least) // (1 << HILBERT_BITS) + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b""] * batch.num_rows
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                points = _matrix(batch.column("vector").take(pa.array(at)), dim)
                wide = greatest - least >= 1 << 62
                cells = (points.astype(object) if wide else points) - least
                for i, key in zip(at.tolist(), hilbert_keys((cells // step).astype(np.int64)), strict=True):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        group, ids, rows = None, [], []
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("dim", "label")], strict=True)
            for key, vec_id, row in zip(keys, batch.column("vec_id").to_pylist(), _lists(batch.column("vector")), strict=True):
                if ids and (key != group or len(ids) == BLOCK_ROWS):
                    yield _block((part << 32) + made, *group, ids, rows)
                    made, ids, rows = made + 1, [], []
                group = key
                ids.append(vec_id)
                rows.append(row)
        if ids:
            yield _block((part << 32) + made, *group, ids, rows)

    # the id splits a place that many equal vectors share
    order = ["dim", "label", "place", "vec_id"]
    keyed = vectors.mapInArrow(placed, "vec_id long, label int, vector array<long>, dim int, place binary")
    curve = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    return reliable(curve.mapInArrow(packed, _BLOCK))


def _lists(column: pa.Array) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _block(number: int, dim: int, label: int, ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    vectors = np.array(rows, dtype=np.int64).reshape(len(ids), dim)
    line = (number, dim, label, len(ids), ids, vectors.ravel(), vectors.min(0), vectors.max(0))
    schema = _arrow(_BLOCK)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(line, schema, strict=True)], schema=schema)


def _numbers(block: int, n: int) -> np.ndarray:
    """A number for each row of a block, its own in the whole table."""
    return np.int64(block) * _PLACES + np.arange(n)


# --- mining


def hard_negatives(
    vectors: DataFrame, *, anchors_every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is as :func:`whole_numbers` returns it.  Anchors are rows whose id is divisible
    by ``anchors_every``; a negative scores between ``least`` and ``most`` hundredths of its positive.
    """

    def near(member: dict, labels, blocks, low, high):
        """Blocks of the anchor's label, besides its own, that may hold a better positive."""
        return (labels == member["label"]) & (high >= member["least"]) & (blocks != member["block"])

    def nearest(member: dict, ids, rows, scores):
        best = _first(scores, ids, rows, positives)
        return [(0, j) for j in best]

    def windows(member: dict) -> list[tuple[int, int, int]]:
        out = [(p["row"], -(-least * p["score"] // 100), most * p["score"] // 100) for p in member["near"]]
        return [(row, max(low, -LONG), min(high, LONG)) for row, low, high in out if low <= high]

    def between(member: dict, labels, blocks, low, high):
        """Blocks of other labels whose scores may fall in a window of the anchor."""
        meets = np.zeros(len(labels), bool)
        for _, floor, ceiling in windows(member):
            meets |= (high >= floor) & (low <= ceiling)
        return meets & (labels != member["label"])

    def hardest(member: dict, ids, rows, scores):
        out = []
        for row, floor, ceiling in windows(member):
            inside = np.flatnonzero((scores >= floor) & (scores <= ceiling))
            out += [(row, inside[j]) for j in _first(scores[inside], ids[inside], rows[inside], negatives)]
        return out

    with small_batches(vectors.sparkSession, 8):
        blocks = blocks_of(vectors)
        numbers = number_ordered(blocks.select("block", "dim").orderBy("dim", "block"), "number")
        pages = reliable(_pages(blocks, numbers))
        anchors = reliable(_with_home(blocks, anchors_every, positives))
        first = F.explode(F.concat(F.col("near"), F.col("others")))
        more = _scanned(blocks, reliable(_grouped(anchors, numbers)), pages, near, nearest).groupBy("anchor").agg(F.flatten(F.collect_list("hits")).alias("others"))
        both = anchors.join(more, "anchor", "left").withColumn("others", F.coalesce(F.transform("others", lambda h: F.struct(h["row"], h["vec_id"], h["score"])), F.array()))
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
        found = both.select("anchor", "anchor_id", first.alias("p")).select("anchor", "anchor_id", "p.*")
        found = reliable(found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= positives).drop("_rank"))
        chosen = found.groupBy("anchor").agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("near"))
        opened = reliable(_grouped(anchors.drop("near").join(chosen, "anchor"), numbers))
        mined = reliable(_scanned(blocks, opened, pages, between, hardest).select("anchor", F.explode("hits").alias("h")).select("anchor", "h.*"))
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    ranked = mined.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    named = found.select("anchor", "anchor_id", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _with_home(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """The anchors of every block with the first others of it, and the score that other blocks must reach."""

    def homed(batches):
        schema = _arrow(_ANCHOR)
        for batch in batches:
            for block in batch.to_pylist():
                ids, x = np.array(block["ids"]), np.array(block["vectors"], dtype=np.int64).reshape(block["n"], block["dim"])
                at, rows = np.flatnonzero(ids % every == 0), _numbers(block["block"], len(ids))
                for start in range(0, len(at), 256):
                    part, out = at[start : start + 256], []
                    for own, line in zip(part.tolist(), products(x[part], x), strict=True):
                        others = np.delete(np.arange(len(ids)), own)
                        best = others[_first(line[others], ids[others], rows[others], k)]
                        near = [{"row": int(rows[j]), "vec_id": int(ids[j]), "score": int(line[j])} for j in best]
                        least = near[-1]["score"] if len(near) == k else -LONG
                        out.append(
                            {"anchor": int(rows[own]), "anchor_id": int(ids[own]), "vector": x[own], "least": least, "near": near}
                            | {c: block[c] for c in ("block", "dim", "label")}
                        )
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return blocks.mapInArrow(homed, _ANCHOR)


def _pages(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Zone maps, ``ZONE_PAGE`` neighbouring blocks a row."""
    zones = blocks.select("block", "label", "low", "high").join(numbers, "block")
    page = F.floor((F.col("number") - 1) / ZONE_PAGE).alias("page")
    return zones.groupBy("dim", page).agg(F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))


def _grouped(anchors: DataFrame, numbers: DataFrame) -> DataFrame:
    """Anchors of ``GROUP_BLOCKS`` neighbouring blocks, one row."""
    member = F.struct(*[F.col(c) for c in ("anchor", "label", "block", "vector", "least", "near")])
    group = F.floor((F.col("number") - 1) / GROUP_BLOCKS).alias("group")
    return anchors.join(numbers.drop("dim"), "block").groupBy("dim", group).agg(F.collect_list(member).alias("members"))


def _scanned(blocks: DataFrame, groups: DataFrame, pages: DataFrame, needs, solve) -> DataFrame:
    """What ``solve`` finds for each anchor in the blocks that ``needs`` picks by their bounds.

    Every group meets every page of zone maps (a query set against all blocks, in blocks);
    vectors are read of the blocks only that a group needs.
    """

    def bounded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                members, zones = row["members"], row["zones"]
                a = np.array([m["vector"] for m in members], dtype=np.int64)
                sides = [np.array([z[side] for z in zones], dtype=np.int64) for side in ("low", "high")]
                blocks_, labels = (np.array([z[c] for z in zones]) for c in ("block", "label"))
                low, high = score_bounds(a, *sides)
                wanted = np.array([needs(m, labels, blocks_, low[i], high[i]) for i, m in enumerate(members)])
                some = np.flatnonzero(wanted.any(0))
                out = [
                    {"dim": row["dim"], "group": row["group"], "block": int(blocks_[b]), "asking": np.flatnonzero(wanted[:, b])} for b in some
                ]
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(_NEEDED))

    def scored(batches):
        schema = _arrow(_HITS)
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.array(row["ids"]), np.array(row["vectors"], dtype=np.int64).reshape(row["n"], row["dim"])
                rows = _numbers(row["block"], len(ids))
                for start in range(0, len(row["asking"]), 256):
                    asking, out = [row["members"][i] for i in row["asking"][start : start + 256]], []
                    lines = products(np.array([m["vector"] for m in asking], dtype=np.int64), x)
                    for member, line in zip(asking, lines, strict=True):
                        hits = solve(member, ids, rows, line)
                        found = [{"positive": int(p), "row": int(rows[j]), "vec_id": int(ids[j]), "score": int(line[j])} for p, j in hits]
                        if found:
                            out.append({"anchor": member["anchor"], "hits": found})
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    last = pages.agg(F.max("page")).first()[0] or 0
    met = groups.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(pages, ["dim", "page"])
    wanted = met.mapInArrow(bounded, _NEEDED)
    read = wanted.join(groups, ["dim", "group"]).join(blocks.select("block", "n", "ids", "vectors"), "block")
    return read.select("block", "dim", "n", "ids", "vectors", "members", "asking").mapInArrow(scored, _HITS)
