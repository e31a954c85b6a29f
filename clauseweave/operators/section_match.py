"""The best chunks for each item among the chunks of its section, without a pair for every two.

Items and chunks of a section are dealt into blocks of bounded size, a row each, and every
block of items meets every block of chunks of its section.  Labels are looked for together,
by one pass of a dictionary automaton over each text.  Token sets are compared as incidence
matrices, chunks of about one size together: sizes bound the similarity, and items whose
bound stays below their k-th best so far are left out.  What leaves a block is the ids and
counts of at most k chunks an item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 4096
PART_CHUNKS = 256
# A confidence is rounded to six digits; nearer than this two may be equal.
_MARGIN = 2e-6

_PAIRS = "qid string, chunk_id string, name_match boolean, shared int, n_item int, n_chunk int"


@dataclass(frozen=True)
class Weights:
    name: float
    overlap: float
    saturation: float

    def score(self, named, overlap):
        return self.name * named + np.minimum(overlap / self.saturation, 1.0) * self.overlap

    def rounded(self, named: bool, overlap: float) -> float:
        """The score as the result has it: the overlap's part is rounded first."""
        return self.name * named + round(min(overlap / self.saturation, 1.0) * self.overlap, 6)


def best_pairs(items: DataFrame, chunks: DataFrame, weights: Weights, k: int) -> DataFrame:
    """(qid, chunk_id, name_match, shared, n_item, n_chunk): of each item and block of chunks the ``k`` best.

    ``items`` is (section, qid, label, tokens, size), ``chunks`` (section, chunk_id, text, tokens, size);
    labels and texts are normalised, a size is a row's bytes, known without its tokens.  Equal scores go to the smaller chunk id.
    """
    left = _blocks(items, "qid", ["qid", "label", "tokens"], "items")
    right = _blocks(chunks, "chunk_id", ["chunk_id", "text", "tokens"], "chunks")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = batch.column("items")[i].values, batch.column("chunks")[i].values
                rows = list(_block_pairs(asked, held, weights, k))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
                names = ["qid", "chunk_id", "name_match", "shared", "n_item", "n_chunk"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return left.join(right, "section").select("items", "chunks").mapInArrow(matched, _PAIRS)


def _blocks(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """(section, rows of the section as one array): about ``BLOCK_BYTES`` or ``BLOCK_ROWS`` a block, which comes first."""
    by_bytes, by_rows = F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)
    blocks = rows.groupBy("section").agg(F.greatest(by_bytes, by_rows, F.lit(1)).alias("_blocks"))
    dealt = rows.join(broadcast_within(blocks), "section").withColumn("_block", F.pmod(F.xxhash64(key), "_blocks"))
    return dealt.groupBy("section", "_block").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("_block")


def _named(labels: list[str], texts: list[str]) -> np.ndarray:
    """Which text (column) holds which label (row); an empty label is in none."""
    import ahocorasick

    out = np.zeros((len(labels), len(texts)), bool)
    rows: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        if label:
            rows.setdefault(label, []).append(i)
    if rows:
        automaton = ahocorasick.Automaton()
        for label, at in rows.items():
            automaton.add_word(label, at)
        automaton.make_automaton()
        for j, text in enumerate(texts):
            for _, at in automaton.iter(text):
                out[at, j] = True
    return out


def _incidence(tokens: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the tokens that ``vocabulary`` holds."""
    code = pc.index_in(pc.list_flatten(tokens), value_set=vocabulary)
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())
    known = code.is_valid().to_numpy(zero_copy_only=False)
    return row[known], code.drop_null().to_numpy()


def _block_pairs(items: pa.StructArray, chunks: pa.StructArray, weights: Weights, k: int) -> Iterator[tuple]:
    item_ids, chunk_ids = items.field("qid").to_pylist(), chunks.field("chunk_id").to_pylist()
    item_tokens, chunk_tokens = items.field("tokens"), chunks.field("tokens")
    n_item, n_chunk = (pc.list_value_length(t).to_numpy().astype(np.float64) for t in (item_tokens, chunk_tokens))
    named = _named(items.field("label").to_pylist(), chunks.field("text").to_pylist())
    vocabulary = pc.unique(pc.list_flatten(item_tokens))
    item_row, item_code = _incidence(item_tokens, vocabulary)
    chunk_row, chunk_code = _incidence(chunk_tokens, vocabulary)
    best = np.full((len(item_ids), k), -1.0)
    kept: list[list[tuple[float, int, int]]] = [[] for _ in item_ids]
    order = np.argsort(n_chunk, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for start in range(0, len(order), PART_CHUNKS):
        part = order[start : start + PART_CHUNKS]
        # similarity is at most the smaller size over the larger
        small = np.minimum(n_item[:, None], n_chunk[part][None])
        large = np.maximum(np.maximum(n_item[:, None], n_chunk[part][None]), 1)
        reach = weights.score(named[:, part], small / large).max(1) + _MARGIN
        active = np.flatnonzero(reach >= best.min(1))
        inside = (place[chunk_row] >= start) & (place[chunk_row] < start + len(part))
        codes, column = np.unique(chunk_code[inside], return_inverse=True)
        right = np.zeros((len(part), len(codes)), np.float32)
        right[place[chunk_row[inside]] - start, column] = 1
        line = np.full(len(item_ids), -1)
        line[active] = np.arange(len(active))
        at = np.searchsorted(codes, item_code)
        found = (line[item_row] >= 0) & (at < len(codes))
        found[found] &= codes[at[found]] == item_code[found]
        left = np.zeros((len(active), len(codes)), np.float32)
        left[line[item_row[found]], at[found]] = 1
        shared = (left @ right.T).astype(np.float64)
        union = n_item[active][:, None] + n_chunk[part][None] - shared
        score = weights.score(named[np.ix_(active, part)], np.divide(shared, union, out=np.zeros_like(shared), where=union > 0))
        best[active] = np.partition(np.concatenate([best[active], score], axis=1), -k, axis=1)[:, -k:]
        for i, j in zip(*np.nonzero(score >= best[active].min(1)[:, None] - _MARGIN), strict=True):
            kept[active[i]].append((score[i, j], part[j], int(shared[i, j])))
    for i, rows in enumerate(kept):
        least = best[i].min() - _MARGIN
        near = []
        for j, shared in ((j, shared) for score, j, shared in rows if score >= least):
            union = n_item[i] + n_chunk[j] - shared
            near.append((-weights.rounded(bool(named[i, j]), shared / union if union else 0.0), chunk_ids[j], j, shared))
        for _, chunk_id, j, shared in sorted(near)[:k]:
            yield item_ids[i], chunk_id, bool(named[i, j]), shared, int(n_item[i]), int(n_chunk[j])
