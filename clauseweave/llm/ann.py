"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

A tree splits its points at the median of their projections on the difference of two random
points, down to leaves of about ``LEAF`` points.  The forest is fitted on at most ``SAMPLE``
vectors; every row is then dropped down every tree and listed under its leaf.  A query keeps
one priority queue over the nodes of all trees, ordered by how far on its side of the splits
it is, and opens the most promising leaves, of whichever tree, until they hold ``CANDIDATES``
rows and share of all.  The rows of the opened leaves are ranked by their exact cosine.

Rows do not move: the queries, ``GROUP`` at a time with a bit for each leaf they open, are sent to
the rows, which find their leaves again.  A task multiplies pieces of its rows with pieces of the
queries, looks the leaves up for pairs that reach the query's k-th best so far only, and hands on
the k best rows of each query.  So what is written grows with the queries, not with the leaves.

Defined cases: vectors that are null, empty, zero, or that hold a null or non-finite component
take no part, nor do rows without an id; rows with one id are rows of their own, as queries
and as candidates; vectors are compared with those of their own length; a query's own row is no
candidate; with fewer than k candidates all are returned; ties go to the smaller id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, freed_shuffles, reliable
from .vectors import of_each_length

TREES = 8
LEAF = 128
SAMPLE = 32_768
# Rows of the leaves a query opens, in all trees together: this many, or this multiple of the number
# of vectors if that is more.  Vectors without structure need about as many for a recall above 0.9.
CANDIDATES = 4_000
CANDIDATE_SHARE = 1.0
# A task compares so many rows with so many queries at once.
PIECE = 1024
QUERY_PIECE = 512
# So many queries are sent to the rows at once.
GROUP = 16_384
# Ids that may be broadcast (about 40 MB).
BROADCAST_IDS = 500_000
# Exact cosines are taken of pairs with so many components in all.
COMPONENTS = 1 << 22


class Forest:
    """Trees as flat arrays: an inner node has a direction, a cut and two children, a leaf is ``-1 - leaf``."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        draw = np.random.default_rng(seed)
        self.direction, self.cut, self.child, self.root = [], [], [], []
        self.leaves = 0
        unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
        for _ in range(trees):
            self.root.append(self._grow(unit, np.arange(len(unit)), leaf, draw))
        self.direction = np.array(self.direction).reshape(-1, sample.shape[1])
        self.cut, self.child = np.array(self.cut), np.array(self.child, dtype=np.int64).reshape(-1, 2)
        self.root = np.array(self.root, dtype=np.int64)

    def _grow(self, unit: np.ndarray, members: np.ndarray, leaf: int, draw: np.random.Generator) -> int:
        if len(members) > leaf:
            for _ in range(4):
                one, two = unit[draw.choice(members, 2, replace=False)]
                along = unit[members] @ (one - two)
                cut = np.median(along)
                left = along <= cut
                if 0 < left.sum() < len(members):
                    node = len(self.cut)
                    self.direction.append(one - two)
                    self.cut.append(cut)
                    self.child.append([0, 0])
                    self.child[node] = [self._grow(unit, members[left], leaf, draw), self._grow(unit, members[~left], leaf, draw)]
                    return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, unit: np.ndarray, tree: int) -> np.ndarray:
        at = np.full(len(unit), self.root[tree])
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            along = (unit[inner] * self.direction[node]).sum(1)
            at[inner] = self.child[node, (along > self.cut[node]).astype(np.int64)]
        return -1 - at

    def opened(self, unit: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
        """Leaves that one query opens, from one queue over all trees; ``held`` are the rows of each leaf."""
        queue = [(-np.inf, int(node)) for node in self.root]
        heapq.heapify(queue)
        side = self.direction @ unit - self.cut if len(self.cut) else self.cut
        out, rows = [], 0
        while queue and rows < wanted:
            worth, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                rows += int(held[-1 - node])
                continue
            margin = float(side[node])
            heapq.heappush(queue, (max(worth, -margin), int(self.child[node, 1])))
            heapq.heappush(queue, (max(worth, margin), int(self.child[node, 0])))
        return out


def fit(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 3) -> Forest:
    """A forest fitted on the ``sample`` rows of (vec_id, v) with the smallest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    return Forest(np.array([r.v for r in rows]) if rows else np.zeros((0, 1)), trees, leaf, seed)


def _units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column, one a line, and the same with length 1."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return rows, rows / np.sqrt((rows * rows).sum(1))[:, None]


def leaf_sizes(vectors: DataFrame, forest: Forest) -> np.ndarray:
    """How many rows of (vec_id, v) each leaf holds."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def counted(batches):
        trees = shared.value
        held = np.zeros(trees.leaves, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                unit = _units(batch.column(0))[1]
                for tree in range(len(trees.root)):
                    held += np.bincount(trees.leaf_of(unit, tree), minlength=trees.leaves)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["leaf", "held"])

    sizes = vectors.select("v").mapInArrow(counted, "leaf long, held long").groupBy("leaf").agg(F.sum("held").alias("held"))
    held = np.zeros(forest.leaves, dtype=np.int64)
    for leaf, n in sizes.collect():  # one small row per leaf
        held[leaf] = n
    shared.destroy()
    return held


def _cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pair by pair in the same order of operations, so that equal vectors get equal scores wherever they are."""
    return (rows * queries).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((queries * queries).sum(1)))


class _Best:
    """The k best rows that each of some queries has met: best score first, ties to the smaller id."""

    def __init__(self, marks: np.ndarray, vectors: np.ndarray, opened: np.ndarray, k: int):
        self.marks, self.vectors, self.opened, self.k = marks, vectors, opened, k
        self.unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        self.score = np.full((len(marks), k), -np.inf)
        self.ids, self.rows = (np.zeros((len(marks), k), dtype=np.int64) for _ in range(2))

    def meet(self, ids: np.ndarray, marks: np.ndarray, rows: np.ndarray, unit: np.ndarray, leaves: list[np.ndarray]) -> None:
        """Compare all queries with some rows; ``leaves`` are the rows' leaves, tree by tree."""
        step = max(1, COMPONENTS // rows.shape[1])
        for first in range(0, len(self.marks), QUERY_PIECE):
            part = slice(first, first + QUERY_PIECE)
            rough = self.unit[part] @ unit.T
            query, row = np.nonzero(rough >= self.score[part, -1:] - _SLACK)
            inside = np.zeros(len(query), dtype=bool)
            for leaf in leaves:
                inside |= (self.opened[first + query, leaf[row] >> 3] >> (leaf[row] & 7) & 1).astype(bool)
            inside &= marks[row] != self.marks[first + query]
            query, row = query[inside], row[inside]
            # of very many only those that can be among the k best here
            some = np.flatnonzero(np.bincount(query, minlength=1) > self.k)
            if len(some):
                line = np.full(len(rough), -1)
                line[some] = np.arange(len(some))
                left = np.full((len(some), len(ids)), -np.inf)
                of = line[query] >= 0
                left[line[query[of]], row[of]] = rough[query[of], row[of]]
                least = np.full(len(rough), -np.inf)
                least[some] = np.partition(left, -self.k, axis=1)[:, -self.k] - _SLACK
                near = rough[query, row] >= least[query]
                query, row = query[near], row[near]
            for at in range(0, len(query), step):
                q, r = first + query[at : at + step], row[at : at + step]
                self._keep(q, _cosines(self.vectors[q], rows[r]), ids[r], marks[r])

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        of = np.unique(query)
        query = np.concatenate([np.repeat(of, self.k), query])
        score, ids, rows = (np.concatenate([kept[of].ravel(), new]) for kept, new in ((self.score, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((ids, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        at = query[order], place
        self.score[at], self.ids[at], self.rows[at] = score[order], ids[order], rows[order]


# Two ways to multiply the same two vectors differ by less.
_SLACK = 1e-9


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, forest: Forest | None = None,
    candidates: int = CANDIDATES, share: float = CANDIDATE_SHARE,
) -> DataFrame:
    """The k nearest found of every query (query_id, rank, vec_id, score).

    ``vectors`` and ``queries`` are (vec_id, v) as :func:`vectors.usable` returns them;
    queries are the rows of ``vectors`` with one of their ids.
    """
    with freed_shuffles(vectors.sparkSession):
        rows = reliable(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
        asked = reliable(rows.select("row", "vec_id").join(_sent(queries.select("vec_id").distinct()), "vec_id", "left_semi").select("row"))
        found = of_each_length(rows, lambda same: _nearest(same, asked, k, forest, candidates, share))
        discard(rows, asked)
    return found


def _sent(ids: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it is proven small, so that the vectors stay where they are."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, forest: Forest | None, candidates: int, share: float) -> DataFrame:
    spark = vectors.sparkSession
    context = spark.sparkContext
    asked = vectors.join(_sent(queries), "row", "left_semi")
    groups = -(-asked.count() // GROUP)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = forest or fit(vectors)
    held = leaf_sizes(vectors, forest)
    wanted = max(candidates, int(share * held.sum() / len(forest.root)))
    shared = context.broadcast((forest, held, wanted))

    def searched(frames):
        trees, rows, want = shared.value
        for pdf in frames:
            bits = []
            for v in pdf.v:
                opened = np.zeros(-(-trees.leaves // 8) * 8, dtype=bool)
                opened[trees.opened(v / np.sqrt((v * v).sum()), rows, want)] = True
                bits.append(np.packbits(opened, bitorder="little").tobytes())
            yield pdf[["row", "vec_id", "v"]].assign(opened=bits, group=pdf.group)

    numbered = asked.select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    opening = reliable(numbered.mapInPandas(searched, "row long, vec_id long, v array<double>, opened binary, group long"))
    out = [_of_group(vectors, opening.filter(F.col("group") == group), shared, k) for group in range(groups)]
    discard(opening)
    shared.destroy()
    return reduce(DataFrame.union, out)


def _of_group(vectors: DataFrame, opening: DataFrame, shared, k: int) -> DataFrame:
    """The k nearest of some queries (row, vec_id, v, opened), about ``GROUP``, which are sent to all rows."""
    spark = vectors.sparkSession
    asking = opening.select("row", "vec_id", "v", "opened").orderBy("row").toPandas()
    if not len(asking):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bits = np.frombuffer(b"".join(asking.opened), dtype=np.uint8).reshape(len(asking), -1)
    sent = spark.sparkContext.broadcast((asking.row.to_numpy(), asking.vec_id.to_numpy(), np.array(asking.v.tolist()), bits))

    def compared(batches):
        trees = shared.value[0]
        marks, query_ids, queries, opened = sent.value
        best = _Best(marks, queries, opened, k)
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                rows, unit = _units(piece.column(2))
                leaves = [trees.leaf_of(unit, tree) for tree in range(len(trees.root))]
                best.meet(piece.column(1).to_numpy(), piece.column(0).to_numpy(), rows, unit, leaves)
        query, place = np.nonzero(best.score > -np.inf)
        columns = [marks[query], query_ids[query], best.rows[query, place], best.ids[query, place], best.score[query, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asking", "query_id", "row", "vec_id", "score"])

    local = vectors.select("row", "vec_id", "v").mapInArrow(compared, "asking long, query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")).cast("int")
    found = reliable(local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    sent.destroy()
    return found
