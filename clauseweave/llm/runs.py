"""Periodic runs of words, found with suffix trees.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends keeping that period, and that holds at least ``LEAST_WORDS`` words and
``LEAST_PERIODS`` periods.  Every run has a Lyndon root: the longest Lyndon word that starts
somewhere in it, under the order of the words or under the reverse order.  So each place
gives two candidate roots (up to the next smaller suffix in either order), and a root is
extended right by the longest common extension of its start and its end, left by the one of
the reversal.  Both extensions are constant-time lowest common ancestors in Ukkonen suffix
trees of the words and of their reversal, read off the least parent place between two first
visits of the Euler tour.

Trees are built only for stretches in which every window of ``WINDOW`` words comes again
within a third of the stretch.  Any run lies inside such a stretch, so nothing is lost.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text;
words are compared byte by byte, with no folding of case; a text is worked on whole, however
long, in one row (memory grows with the longest stretch of one text, some 1.5 kB a word);
repeated rows each get their result; input columns stay as they are, but those called
``runs``, ``strongest`` and ``collapsed`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .common import row_of, unpacked

LEAST_WORDS = 24
LEAST_PERIODS = 3
WINDOW = 8

RUN = "struct<start:long,length:long,period:long>"
_FOUND = f"struct<runs:array<{RUN}>,strongest:{RUN},collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# --- suffix trees


def _ukkonen(s: list[int], letters: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Suffix tree of ``s``, whose last letter occurs nowhere else.

    For each node (0 is the root): start and end of its edge in ``s``, its parent and, for a
    leaf, the place where its suffix begins (-1 for inner nodes).
    """
    n = len(s)
    start, end, parent, leaf, link = [0], [0], [0], [-1], [0]
    child: dict[int, int] = {}
    node, edge, length, open_ = 0, 0, 0, 0
    for i, c in enumerate(s):
        last = 0
        open_ += 1
        while open_:
            if not length:
                edge = i
            key = node * letters + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i), end.append(n), parent.append(node), leaf.append(i - open_ + 1), link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[below]
                span = min(end[below], i + 1) - first
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if s[first + length] == c:
                    if last and node:
                        link[last] = node
                    length += 1
                    break
                split = len(start)
                child[key] = split
                start.append(first), end.append(first + length), parent.append(node), leaf.append(-1), link.append(0)
                start[below], parent[below] = first + length, split
                child[split * letters + s[first + length]] = below
                child[split * letters + c] = split + 1
                start.append(i), end.append(n), parent.append(split), leaf.append(i - open_ + 1), link.append(0)
                if last:
                    link[last] = split
                last = split
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_ + 1
    return start, end, parent, leaf


def _tour(order: np.ndarray, parent: np.ndarray) -> list[int]:
    """Nodes in the order of their first visit; ``order`` lists them by parent and rank among its children."""
    bounds = np.searchsorted(parent[order], np.arange(len(parent) + 1)).tolist()
    kids = order[::-1].tolist()  # reversed, so that slices come off a stack in order
    total = len(kids)
    visited, stack = [], [0]
    while stack:
        v = stack.pop()
        visited.append(v)
        a, b = bounds[v], bounds[v + 1]
        if a < b:
            stack += kids[total - b : total - a]
    return visited


class SuffixTree:
    """Longest common extensions and suffix order of a list of letters 1, 2, ... with a last letter 0 added."""

    def __init__(self, letters: list[int], ranks: bool = False) -> None:
        s = [*letters, 0]
        wide = max(s) + 1
        start, end, parent, leaf = (np.array(x, dtype=np.int64) for x in _ukkonen(s, wide))
        nodes = np.arange(1, len(start))
        first = np.array(s)[start]
        order = nodes[np.lexsort((first[1:], parent[1:]))]
        visited = np.array(_tour(order, parent))
        place = np.empty(len(visited), np.int64)
        place[visited] = np.arange(len(visited))
        self.leaf_place = np.empty(len(s), np.int64)
        leaves = leaf[visited]
        self.leaf_place[leaves[leaves >= 0]] = np.flatnonzero(leaves >= 0)
        # parents come before their children, so depths add up along the tour
        depth = np.zeros(len(visited), np.int64)
        up = place[parent[visited]]
        span = (end - start)[visited]
        for at, (above, more) in enumerate(zip(up.tolist(), span.tolist(), strict=True)):
            if at:
                depth[at] = depth[above] + more
        self.depth = depth
        self.least = [up.astype(np.int32)]
        width = 1
        while 2 * width <= len(up):
            row = self.least[-1]
            self.least.append(np.minimum(row[:-width], row[width:]))
            width *= 2
        if ranks:
            self.rank = self._ranks(leaves, len(s))
            reverse = np.where(first == 0, 0, wide - first)
            order = nodes[np.lexsort((reverse[1:], parent[1:]))]
            self.reverse_rank = self._ranks(leaf[np.array(_tour(order, parent))], len(s))

    @staticmethod
    def _ranks(leaves: np.ndarray, n: int) -> np.ndarray:
        rank = np.empty(n, np.int64)
        rank[leaves[leaves >= 0]] = np.arange(n)
        return rank

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common part from places ``i`` and ``j`` on; i differs from j."""
        a, b = self.leaf_place[i], self.leaf_place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.least[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k)) + 1])
        return self.depth[out]


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place but the last, the next place of smaller rank."""
    ranks = rank.tolist()
    out = [0] * len(ranks)
    for i in range(len(ranks) - 2, -1, -1):
        j = i + 1
        while ranks[j] > ranks[i]:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], dtype=np.int64)


def runs_of(letters: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of positive numbers, by start and period."""
    n = len(letters)
    if n < LEAST_WORDS:
        return []
    tree, back = SuffixTree(letters, ranks=True), SuffixTree(letters[::-1])
    found = set()
    for rank in (tree.rank, tree.reverse_rank):
        i, j = np.arange(n), _next_smaller(rank)
        short = (j - i) * LEAST_PERIODS <= n
        i, j = i[short], j[short]
        if not len(i):
            continue
        low = i - back.extension(n - i, n - j)
        high = j + tree.extension(i, j)
        kept = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * (j - i))
        found |= set(zip(low[kept].tolist(), (high - low)[kept].tolist(), (j - i)[kept].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


# --- texts


def _stretches(nearest: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) in windows of the parts whose windows all come again within a third of the part's words."""
    done, open_ = [], [(0, len(nearest))]
    while open_:
        a, b = open_.pop()
        if b - a + WINDOW - 1 < LEAST_WORDS:
            continue
        near = nearest[a:b] <= (b - a + WINDOW - 1) // LEAST_PERIODS
        if near.all():
            done.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype(np.int8)))
        open_ += [(a + x, a + y) for x, y in edges.reshape(-1, 2).tolist()]
    return sorted(done)


def _nearest(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each window of a slice of texts, the distance to the nearest equal one of its text (2**62: none).

    Windows that reach into the next text are given none.
    """
    windows = text_hash.chain(words, WINDOW)
    out = np.full(len(windows), 1 << 62, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(windows)]
    inside = np.flatnonzero(np.arange(len(windows)) + WINDOW <= first[1:][doc])
    key = text_hash.mix(windows[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    at, same = inside[order], np.diff(key[order]) == 0
    gap = np.where(same, np.diff(at), 1 << 62)
    out[at[:-1]] = gap
    out[at[1:]] = np.minimum(out[at[1:]], gap)
    return out


def _text_runs(text: list[bytes], nearest: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for a, b in _stretches(nearest):
        codes: dict[bytes, int] = {}
        letters = [codes.setdefault(word, len(codes) + 1) for word in text[a : b + WINDOW - 1]]
        out += [(a + start, length, period) for start, length, period in runs_of(letters)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in runs:  # by start, then period: the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        steps = np.zeros(len(text) + 1, np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        text = [text[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(text)


def column_runs(column: pa.Array) -> pa.Array:
    """The runs, the strongest of them and the collapsed text of every text of an Arrow column."""
    named = lambda r: r and {"start": r[0], "length": r[1], "period": r[2]}
    runs, strongest, collapsed = [], [], []
    for _, raw, offsets in text_hash.slices(column):
        hashes, first = text_hash.word_hashes(raw, offsets, fold=False)
        nearest = _nearest(hashes, first)
        data = raw.tobytes()
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = data[a:b].split()  # splits at 0x20 and 0x09 to 0x0D
            low, high = int(first[k]), max(int(first[k]), int(first[k + 1]) - WINDOW + 1)
            found = _text_runs(words, nearest[low:high]) if len(words) >= LEAST_WORDS else []
            runs.append([named(r) for r in found])
            strongest.append(named(_strongest(found)))
            collapsed.append(_collapsed(words, found).decode())
    return pa.StructArray.from_arrays(
        [pa.array(runs, pa.list_(_RUN)), pa.array(strongest, _RUN), pa.array(collapsed, pa.string())],
        ["runs", "strongest", "collapsed"],
    )


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with ``runs``, ``strongest`` (greatest length a period; ties by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that any run holds after its first period,
    single spaces between the words that stay.
    """
    find = F.arrow_udf(column_runs, _FOUND)
    packed = docs.select(row_of(docs).alias("row"), find(F.col(text).cast("string")).alias("found"))
    own = ("runs", "strongest", "collapsed")
    return packed.select(*unpacked(docs, "row", own), *[F.col("found")[c].alias(c) for c in own])
