"""Exact top-k inner products as a Voronoi kNN join.

Queries and data are grouped by their nearest pivot.  Group summaries (radius of the
queries, sorted smallest distances of the data) give each query group a score that its
k-th best cannot fall below; a data row is replicated to a query group only if its own
upper bound reaches that score, and every group is solved locally in blocks.

For a query q = p + e with |e| <= r and a row x:  p.x - r|x| <= q.x <= p.x + r|x|,
so the bounds hold for the inner product itself and results are exact.

Defined cases: a null or empty vector, one with a null or non-finite component and one with a null
id take no part; rows with one id are rows of their own, as queries and as candidates; vectors are compared
with those of their own length; a query's own row is no candidate; with fewer than k candidates all are returned;
ties go to the smaller id; an empty table gives an empty result; other columns are not read.  Scores are exact:
doubles, longs or unbounded integers are used as the components of a block need.  A scaled component of 2**62 or
more, or a score beyond a long, is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable
from .vectors import of_each_length

QUERY_BLOCK = 2048
DATA_BLOCK = 16384
PIVOTS = 16
PIVOT_SAMPLE = 4096
_LARGEST = float(1 << 62)
_QUERIES_AT_ONCE = 64


def quantized(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): the vectors that take part, each component floor(scale * x) as a double."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = (F.size(vector) > 0) & F.col(vec_id).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return df.filter(usable).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("v"),
    )


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)[None]
    at = square.argmin(1)
    return at, np.sqrt(np.maximum(((v - pivots[at]) ** 2).sum(1), 0.0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _scores(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs."""
    most = float(np.abs(asked).max()) * float(np.abs(rows).max()) * asked.shape[1]
    if most < 2.0**53:
        return (asked @ rows.T).astype(np.int64)
    if most < 2.0**62:
        return asked.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return (whole(asked) @ whole(rows).T).astype(np.int64)  # OverflowError beyond a long


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """The k largest inner products of every query (query_id, rank, vec_id, score long).

    ``vectors`` and ``queries`` are (vec_id, v) as :func:`quantized` returns them; queries are the rows
    of ``vectors`` with one of their ids.  Pivots are picked from at most ``PIVOT_SAMPLE`` rows, which
    bears on the work only, never on the result.
    """
    rows = reliable(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    asked = reliable(rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("row"))
    return of_each_length(rows, lambda same: _top_of_length(same, asked, k, pivots))


def _top_of_length(vectors: DataFrame, queries: DataFrame, k: int, pivots: int) -> DataFrame:
    spark = vectors.sparkSession
    context = spark.sparkContext
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sample:
        return none
    chosen = _far_apart(np.array([r.v for r in sample]), pivots)
    shared = context.broadcast(chosen)

    def grouped(frames):
        for pdf in frames:
            if len(pdf):
                v = np.array(pdf.v.tolist())
                if np.abs(v).max() >= _LARGEST:
                    raise ValueError("a scaled component is not below 2**62")
                at, far = _nearest(v, shared.value)
                yield pdf.assign(cell=at.astype(np.int32), far=far, norm=np.sqrt((v * v).sum(1)))

    shape = "row long, vec_id long, v array<double>, cell int, far double, norm double"
    data = vectors.mapInPandas(grouped, shape)
    asked = reliable(vectors.join(queries, "row", "left_semi").select("row", "vec_id", "v").mapInPandas(grouped, shape))

    # summaries: a few numbers per cell, at most pivots * k distances
    spans = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    if not spans:
        return none
    near = _k_smallest(data.select("cell", "far", "norm"), k + 1)
    reach = np.zeros(len(chosen))
    floor = np.full(len(chosen), -np.inf)
    slack = (chosen.shape[1] + 4) * 2.0**-50  # rounding of an inner product, relative to the lengths of its vectors
    for cell, (far, _) in spans.items():
        reach[cell] = far
        # each known row is at least this good for any query of the cell; one of them may be the query itself
        long = np.linalg.norm(chosen[cell]) + far
        norms = [np.linalg.norm(chosen[c]) for c, _ in near]
        lows = [
            chosen[cell] @ chosen[c] - long * d - far * norm - slack * long * (norm + d)
            for (c, d), norm in zip(near, norms, strict=True)
        ]
        if len(lows) > k:
            floor[cell] = sorted(lows, reverse=True)[k] - 1e-6 * (1 + abs(sorted(lows, reverse=True)[k]))
    cells = np.array(sorted(spans), dtype=np.int32)
    bounds = context.broadcast((chosen, cells, reach, floor))

    def replicated(frames):
        points, present, radius, least = bounds.value
        for pdf in frames:
            if not len(pdf) or not len(present):
                continue
            v = np.array(pdf.v.tolist())
            lengths = np.linalg.norm(points[present], axis=1)
            upper = v @ points[present].T + pdf.norm.to_numpy()[:, None] * (radius[present] * (1 + 1e-9) + slack * lengths)[None]
            row, cell = np.nonzero(upper >= least[present][None])
            yield pd.DataFrame({"cell": present[cell], "row": pdf.row.to_numpy()[row], "vec_id": pdf.vec_id.to_numpy()[row], "v": pdf.v.to_numpy()[row]})

    needed = data.mapInPandas(replicated, "cell int, row long, vec_id long, v array<double>")
    # blocks of bounded size: a cell's queries in parts, its data in pieces, each part meets each piece
    pieces = -(-vectors.count() // DATA_BLOCK)
    count = F.create_map(*[F.lit(x) for c in cells for x in (int(c), -(-spans[c][1] // QUERY_BLOCK))])[F.col("cell")]
    left = asked.withColumn("part", F.pmod(F.xxhash64("row"), count).cast("int")).select(
        "cell", "row", "vec_id", "v", "part", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    )
    right = needed.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int")).select(
        "cell", "row", "vec_id", "v", "piece", F.explode(F.sequence(F.lit(0), count - 1)).alias("part")
    )

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            ids, marks, x = d.vec_id.to_numpy(), d.row.to_numpy(), np.array(d.v.tolist())
            for start in range(0, len(q), _QUERIES_AT_ONCE):
                part = q.iloc[start : start + _QUERIES_AT_ONCE]
                scores = _scores(np.array(part.v.tolist()), x)
                for own, query_id, line in zip(part.row.to_numpy(), part.vec_id.to_numpy(), scores, strict=True):
                    other = np.flatnonzero(marks != own)
                    best = other[_best(ids[other], line[other], k)]
                    out.append(pd.DataFrame({"asking": own, "query_id": query_id, "vec_id": ids[best], "score": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("asking", "query_id", "vec_id", "score")}, dtype=np.int64)

    keys = ["cell", "part", "piece"]
    shape = "asking long, query_id long, vec_id long, score long"
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, shape)
    rank = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")).cast("int")
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _k_smallest(rows: DataFrame, k: int) -> list[tuple[int, float]]:
    """(cell, distance) of the k rows nearest to each pivot: pivots * k numbers at most."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("far")))
    return [(r.cell, r.far) for r in ranked.filter(F.col("n") <= k).select("cell", "far").collect()]


def _far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots from a sample: each next one is the farthest from those before."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]
