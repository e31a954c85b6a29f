"""Scoring many weighted term lists against blocks of postings, with early termination.

A block holds the terms of some thousand chunks.  Its chunks are cut by length into small
parts; the largest factor of every term in a part, times the weights of a search, bounds the
score of all its chunks.  A part is scored for the searches only whose bound reaches the k-th
best score known to them, which rises as parts are scored.  Terms in many chunks of a part are
multiplied out as a matrix in single precision, those in few are added up entry by entry.
Scores are sums in another order than the definition's and less precise, so a slack is allowed
for (``SLACK``, and more for long searches) and what stays is scored anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHUNKS = 2048
PART_CHUNKS = 512
SEARCHES = 512
SLACK = 1e-5
# A term in at least one of so many chunks of a part is multiplied out.
_DENSE = 32
# Running scores are kept for so many batches of searches at once.
_KEPT_BATCHES = 32
# Searches that are not broadcast meet the blocks in groups of so many batches.
GROUP_BATCHES = 8

_BLOCK = "rows array<long>, lengths array<int>, sizes array<int>, terms array<string>, tfs array<int>"
_BLOCK_COLUMNS = ("rows", "lengths", "sizes", "terms", "tfs")
_FOUND = "search_no long, row_no long, about double"


def slack(terms: int) -> float:
    """How far a score of so many terms may be off: a sum of non-negative parts, by one rounding of a single a part."""
    return max(SLACK, (terms + 8) * 2.0**-22)


def packed(documents: DataFrame) -> DataFrame:
    """Blocks of at most ``BLOCK_CHUNKS`` rows of (row_no, doc_len, terms, tfs), one row each; no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_CHUNKS):
                part = batch.slice(start, BLOCK_CHUNKS)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [
                    part.column("row_no"), part.column("doc_len"), pc.list_value_length(part.column("terms")),
                    pc.list_flatten(part.column("terms")), pc.list_flatten(part.column("tfs")),
                ]
                yield pa.RecordBatch.from_arrays([one(c) for c in columns], names=list(_BLOCK_COLUMNS))

    return documents.select("row_no", "doc_len", "terms", "tfs").mapInArrow(pack, _BLOCK)


def batched(weights: DataFrame) -> DataFrame:
    """Batches of searches (batch, searches) from (search_no, term, weight)."""
    one = weights.groupBy("search_no").agg(F.collect_list(F.struct("term", "weight")).alias("parts"))
    batch = F.floor(F.col("search_no") / SEARCHES).cast("int").alias("batch")
    return one.groupBy(batch).agg(F.collect_list(F.struct("search_no", "parts")).alias("searches"))


def known(least: DataFrame) -> DataFrame:
    """(batch, known): scores that the k-th best of some searches reach, from (search_no, least)."""
    batch = F.floor(F.col("search_no") / SEARCHES).cast("int").alias("batch")
    return least.groupBy(batch).agg(F.collect_list(F.struct("search_no", "least")).alias("known"))


class _Searches:
    """A batch of searches as a sparse matrix by term, with the best scores each has met."""

    def __init__(self, searches: pa.StructArray, known: pa.StructArray | None, k: int) -> None:
        parts = searches.field("parts")
        flat = pc.list_flatten(parts)
        self.numbers = searches.field("search_no").to_numpy()
        self.least = np.zeros(len(searches))
        if known is not None and len(known):
            order = np.argsort(self.numbers)
            at = order[np.searchsorted(self.numbers[order], known.field("search_no").to_numpy())]
            self.least[at] = known.field("least").to_numpy()
        self.best = np.zeros((len(searches), k), np.float32)
        self.slack = slack(pc.max(pc.list_value_length(parts)).as_py() or 0)
        at = np.repeat(np.arange(len(searches)), pc.list_value_length(parts).to_numpy())
        coded = flat.field("term").dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.vocabulary = coded.dictionary
        self.search = at[order]
        self.weight = flat.field("weight").to_numpy()[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.vocabulary) + 1))

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``terms``, search, weight) of all entries of some terms."""
        counts = self.first[terms + 1] - self.first[terms]
        place = np.repeat(np.arange(len(terms)), counts)
        at = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[terms], counts)
        return place, self.search[at], self.weight[at]


def _part_hits(
    batch: _Searches, factors: np.ndarray, terms: np.ndarray, rows: np.ndarray, rare: tuple[np.ndarray, ...] | None = None
) -> Iterator[tuple[np.ndarray, ...]]:
    """(search numbers, rows, scores) that may be among the best, of chunks with ``factors`` (chunks x terms).

    ``rare`` are factors of other terms, one by one: (chunk, term, factor), those of a term one after the other.
    """
    place, search, weight = batch.entries(terms)
    bound = np.bincount(search, weight * factors.max(0)[place], len(batch.numbers)) if len(terms) else np.zeros(len(batch.numbers))
    if rare is not None and len(rare[0]):
        chunk, term, value = rare
        first = np.flatnonzero(np.diff(term, prepend=-1))
        rare_place, rare_search, rare_weight = batch.entries(term[first])
        bound += np.bincount(rare_search, rare_weight * np.maximum.reduceat(value, first)[rare_place], len(batch.numbers))
    active = np.flatnonzero((bound > 0) & (bound * (1 + batch.slack) >= batch.least))
    if not len(active):
        return
    line = np.full(len(batch.numbers), -1)
    line[active] = np.arange(len(active))
    matrix = np.zeros((len(active), len(terms)), np.float32)
    wanted = line[search] >= 0
    matrix[line[search[wanted]], place[wanted]] = weight[wanted]
    scores = matrix @ factors.astype(np.float32, copy=False).T
    if rare is not None and len(rare[0]):
        # every chunk of a term meets every search of it
        wanted = line[rare_search] >= 0
        at, row, weight = rare_place[wanted], line[rare_search[wanted]], rare_weight[wanted]
        counts = np.diff(first, append=len(term))[at]
        entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[at], counts)
        cell = np.repeat(row, counts) * len(rows) + chunk[entry]
        scores += np.bincount(cell, np.repeat(weight, counts) * value[entry], scores.size).reshape(scores.shape).astype(np.float32)
    k = batch.best.shape[1]
    # only a chunk above the k-th best so far can raise it
    better = np.flatnonzero(scores.max(1) > batch.best[active].min(1))
    mine = active[better]
    batch.best[mine] = np.partition(np.concatenate([batch.best[mine], scores[better]], axis=1), -k, axis=1)[:, -k:]
    batch.least[mine] = np.maximum(batch.least[mine], batch.best[mine].min(1) * (1 - batch.slack))
    floor = (batch.least[active] / (1 + batch.slack) * (1 - 2.0**-20)).astype(np.float32)
    at, row = np.nonzero((scores > 0) & (scores >= floor[:, None]))
    yield batch.numbers[active[at]], rows[row], scores[at, row].astype(np.float64)


def found(blocks: DataFrame, batches: DataFrame, factor, k: int) -> DataFrame:
    """(search_no, row_no, about): all chunks that may be among the first ``k`` of a search, and few others.

    ``blocks`` are those of :func:`packed`, ``batches`` (batch, searches, known), broadcast or checkpointed.
    ``factor(tf, length)`` is a term's part of the score at weight 1.  Each block meets each
    batch (a stated set of searches against all chunks, in blocks), as a product of partitions:
    neither side is shuffled, and a task holds one block and one partition of batches.
    """

    def scored(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Searches] = {}
        block = None
        for frame in frames:
            for i in range(frame.num_rows):
                number = frame.column("batch")[i].as_py()
                if number not in kept:
                    if len(kept) == _KEPT_BATCHES:
                        kept.clear()
                    kept[number] = _Searches(frame.column("searches")[i].values, frame.column("known")[i].values, k)
                rows = frame.column("rows")[i].values
                if block is None or not block.rows.equals(rows):  # a block meets its batches one after the other
                    block = _Block({c: frame.column(c)[i].values for c in _BLOCK_COLUMNS}, factor)
                for hits in _hits_in(kept[number], block):
                    yield pa.RecordBatch.from_arrays([pa.array(h) for h in hits], names=["search_no", "row_no", "about"])

    return blocks.join(batches).select("batch", *_BLOCK_COLUMNS, "searches", "known").mapInArrow(scored, _FOUND)


class _Block:
    """A block's chunks by length, cut into parts, with the entries of each part by term; made once for all batches."""

    def __init__(self, block: dict[str, pa.Array], factor) -> None:
        self.rows = block["rows"]
        lengths, sizes = block["lengths"].to_numpy(), block["sizes"].to_numpy()
        coded = block["terms"].dictionary_encode()
        self.terms = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(lengths)), sizes)
        value = factor(block["tfs"].to_numpy().astype(np.float64), lengths[chunk].astype(np.float64))
        # chunks of about one length have parts that are alike, which makes the bounds tight
        by_length = np.argsort(lengths, kind="stable")
        place = np.empty(len(lengths), np.int64)
        place[by_length] = np.arange(len(lengths))
        at = place[chunk]
        order = np.argsort(at // PART_CHUNKS * (len(self.terms) + 1) + code, kind="stable")
        at, code, value = at[order], code[order], value[order]
        edges = np.searchsorted(at // PART_CHUNKS, np.arange(-(-len(lengths) // PART_CHUNKS) + 1))
        numbers = self.rows.to_numpy()[by_length]
        self.parts = [
            (numbers[n * PART_CHUNKS : (n + 1) * PART_CHUNKS], at[a:b] - n * PART_CHUNKS, code[a:b], value[a:b])
            for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
            if a < b
        ]


def _block_hits(batch: _Searches, block: dict[str, pa.Array], factor) -> Iterator[tuple[np.ndarray, ...]]:
    return _hits_in(batch, _Block(block, factor))


def _hits_in(batch: _Searches, block: _Block) -> Iterator[tuple[np.ndarray, ...]]:
    # the batch's number of each term of the block
    mine = pc.fill_null(pc.index_in(block.terms, value_set=batch.vocabulary), -1).to_numpy(zero_copy_only=False)
    for rows, chunk, code, value in block.parts:
        known = np.flatnonzero(mine[code] >= 0)
        if not len(known):
            continue
        chunk, code, part = chunk[known], code[known], value[known]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        counts = np.diff(starts, append=len(code))
        often = counts * _DENSE >= len(rows)
        dense = np.repeat(often, counts)
        terms = mine[code[starts]]
        factors = np.zeros((len(rows), int(often.sum())), np.float32)
        factors[chunk[dense], np.repeat(np.arange(factors.shape[1]), counts[often])] = part[dense]
        rare = (chunk[~dense], np.repeat(terms[~often], counts[~often]), part[~dense])
        yield from _part_hits(batch, factors, terms[often], rows, rare)


_SCORED = "search_no long, row_no long, chunk_id string, section string, score double, matched_terms array<string>"
# Pairs whose terms are matched together.
_PAIRS = 1024


def scored(pairs: DataFrame, part) -> DataFrame:
    """Scores and matched terms of (search_no, row_no, chunk_id, section, doc_len, terms, tfs, asked), a pair a row.

    ``asked`` are the search's (pos, idf, term); ``part(idf, tf, length)`` is a term's part, and
    parts are added one after the other in the order of ``asked``.  Pairs without a common term are left out.
    """
    names = [field.split()[0] for field in _SCORED.split(", ")]

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, _PAIRS):
                some = frame.slice(start, _PAIRS)
                at, place, entry, values, score = _added(some, part)
                terms = pc.list_flatten(some.column("asked")).field("term").take(pa.array(entry))
                first = np.searchsorted(place, np.arange(len(at) + 1)).astype(np.int32)
                columns = [some.column(c).take(pa.array(at)) for c in names[:4]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.ListArray.from_arrays(pa.array(first), terms)], names=names)

    return pairs.mapInArrow(added, _SCORED)


def _added(pairs: pa.RecordBatch, part) -> tuple[np.ndarray, ...]:
    """(pairs with a common term, then by match: place of the pair among them, place of the term asked, its part; scores)."""
    held, asked = pairs.column("terms"), pc.list_flatten(pairs.column("asked"))
    both = pa.concat_arrays([asked.field("term"), pc.list_flatten(held)]).dictionary_encode()
    code, codes = both.indices.to_numpy().astype(np.int64), max(1, len(both.dictionary))
    rows = np.arange(pairs.num_rows)
    row_asked = np.repeat(rows, pc.list_value_length(pairs.column("asked")).to_numpy())
    row_held = np.repeat(rows, pc.list_value_length(held).to_numpy())
    key_asked, key_held = row_asked * codes + code[: len(asked)], row_held * codes + code[len(asked) :]
    order = np.argsort(key_asked)
    entry = np.searchsorted(key_asked[order], key_held)
    entry[entry == len(order)] = 0
    entry = order[entry] if len(order) else entry
    known = np.flatnonzero(key_asked[entry] == key_held) if len(order) else np.zeros(0, np.int64)
    entry, row = entry[known], row_held[known]
    tf = pc.list_flatten(pairs.column("tfs")).to_numpy()[known].astype(np.float64)
    length = pairs.column("doc_len").to_numpy().astype(np.float64)[row]
    values = part(asked.field("idf").to_numpy()[entry], tf, length)
    order = np.lexsort((values, asked.field("pos").to_numpy()[entry], row))
    entry, row, values = entry[order], row[order], values[order]
    at, place = np.unique(row, return_inverse=True)
    rank = np.arange(len(place)) - np.searchsorted(place, place)
    lines = np.zeros((len(at), int(rank.max(initial=0)) + 1))
    lines[place, rank] = values
    return at, place, entry, values, np.cumsum(lines, axis=1)[:, -1]
