"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A text is fed in stretches.  Pre-tokens are cut as soon as no later character can change
them; a pre-token of any length is itself streamed: its bytes go through a window, and the
tokens that end at least the *sufficient lookahead* before the window's end are emitted.

The sufficient lookahead follows from the merge list.  Text right of a cut can change the
token boundaries left of it only through a chain of merges of rising rank: the first one
joins a token ``a`` that ends at the cut to what follows, and each next one joins a token
on the left to one that starts with the left part of the merge before.  A chain reaches
left by the sum of its left parts, and the longest chain is found in one pass over the
merges in rank order.  Memory is a window of that size, whatever the text's length.

Defined cases: null and empty texts have no tokens and decode to an empty text; text that
spells a special token is that token, as the tokenizer file says; unknown ids decode to
nothing; bytes that are not UTF-8 decode to replacement characters; whole texts are
encoded; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import weakref
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import row_of, unpacked

# How byte-level BPE cuts texts into pre-tokens.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CLASSES = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")
# No cut depends on more characters than these after it.
_MARGIN = 4

STRETCH = 1 << 16
CACHED_CHARS = 48
CACHE_SIZE = 1 << 17
# tokenized at a time and handed on: characters of a batch
BATCH_CHARS = 1 << 21

_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NONE = 1 << 62
_SHORT = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Vocabulary, merges and lookahead of one byte-level tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        if not plain or model["type"] != "BPE" or spec["normalizer"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_alphabet()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"] if all(c in letters for c in token)}
        ids = {raw[token]: i for token, i in model["vocab"].items() if token in raw}
        self.bytes_of = _Pieces({i: piece for piece, i in ids.items()})
        self.first = [ids.get(bytes([b])) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}  # rank << _ID_BITS | token made
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {i for i in self.first if i is not None}
        reach: dict[bytes, int] = {}
        self.lookahead = 1
        for rank, (left, right) in enumerate(merges):
            a, b = raw[left], raw[right]
            if ids[a] not in made or ids[b] not in made:
                raise ValueError("a merge uses a token before it is made")
            self.pairs.setdefault((ids[a], ids[b]), rank << _ID_BITS | ids[a + b])
            made.add(ids[a + b])
            far = len(a) + max((reach.get(b[:n], 0) for n in range(1, len(b) + 1)), default=0)
            reach[a] = max(reach.get(a, 0), far)
            self.lookahead = max(self.lookahead, far)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that look at their surroundings are not supported")
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile(PRETOKENS)
        self.run_on = [regex.compile(c) for c in _CLASSES]
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.hold = max([0, *(len(m) - 1 for m in marks)])
        self.window = max(256, 4 * self.lookahead)
        self.cache = _Cache(self)

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a byte string: the lowest-ranked pair first, the leftmost of equals."""
        tokens, get = [self.first[b] for b in piece], self.pairs.get
        if len(tokens) > _SHORT:
            return self._merged_long(tokens)
        ranks = [get(pair, _NONE) for pair in zip(tokens, tokens[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            tokens[i : i + 2] = (best & _ID_MASK,)
            del ranks[i]
            if i:
                ranks[i - 1] = get((tokens[i - 1], tokens[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((tokens[i], tokens[i + 1]), _NONE)
        return tokens

    def _merged_long(self, tokens: list[int]) -> list[int]:
        get = self.pairs.get
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        waiting = [(found, i, pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if (found := get(pair))]  # noqa: B905
        heapq.heapify(waiting)
        while waiting:
            found, i, pair = heapq.heappop(waiting)
            j = after[i]
            if j >= len(tokens) or (tokens[i], tokens[j]) != pair:
                continue
            tokens[i], tokens[j] = found & _ID_MASK, -1
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(tokens) and (found := get(pair := (tokens[k], tokens[after[k]]))):
                    heapq.heappush(waiting, (found, k, pair))
        return [t for t in tokens if t >= 0]

    def tokens_of(self, pieces: list[str]):
        """Tokens of pre-tokens, one after the other."""
        return chain.from_iterable(map(self.cache.__getitem__, pieces))


class _Cache(dict):
    """Tokens of short pre-tokens, in two generations: when the new one is full, the old one goes."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        # a plain reference back would keep a dropped tokenizer until the collector of cycles comes by
        self.bpe, self.old = weakref.proxy(bpe), {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE:
                self.old = dict(self)
                self.clear()
            tokens = self[piece] = self.old.get(piece) or tuple(self.bpe.merged(piece.encode()))
            return tokens
        stream = PretokenStream(self.bpe)
        return (*stream.feed(piece.encode()), *stream.finish())


class PretokenStream:
    """Emits the tokens of one pre-token while its bytes arrive; holds a window at most."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, b""

    def feed(self, piece: bytes) -> list[int]:
        out = []
        size = self.bpe.window
        for start in range(0, len(piece), size):
            self.held += piece[start : start + size]
            if len(self.held) >= 2 * size:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        tokens, end, n = self.bpe.merged(self.held), 0, 0
        for token in tokens:
            if end + len(self.bpe.bytes_of[token]) > len(self.held) - self.bpe.lookahead:
                break
            end, n = end + len(self.bpe.bytes_of[token]), n + 1
        self.held = self.held[end:]
        return tokens[:n]

    def finish(self) -> list[int]:
        tokens, self.held = self.bpe.merged(self.held), b""
        return tokens


class TextStream:
    """Emits the tokens of a text while its characters arrive."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, ""
        self.run: tuple[regex.Pattern, PretokenStream] | None = None

    def feed(self, text: str) -> list[int]:
        self.held += text
        return self._advance(final=False)

    def finish(self) -> list[int]:
        return self._advance(final=True)

    def _advance(self, final: bool) -> list[int]:
        out: list[int] = []
        while self.bpe.marks and (m := self.bpe.marks.search(self.held)):
            before, rest = self.held[: m.start()], self.held[m.end() :]
            self.held = before
            out += self._plain(final=True, keep=0)
            out.append(self.bpe.special[m[0]])
            self.held = rest
        return out + self._plain(final, 0 if final else self.bpe.hold)

    def _plain(self, final: bool, keep: int) -> list[int]:
        """Tokens of the held text that its last ``keep`` characters and later ones cannot change."""
        usable = len(self.held) - keep
        out: list[int] = []
        start = 0
        if self.run:
            start, found = self._continue(usable, final)
            out += found
            if self.run:
                self.held = self.held[start:]
                return out
        # pre-tokens follow each other without gaps
        pieces, end = self.bpe.cut.findall(self.held, start), len(self.held)
        if not final:
            while pieces and end > usable - _MARGIN:
                end -= len(pieces.pop())
        start = max(start, end)
        out += self.bpe.tokens_of(pieces)
        self.held = self.held[start:]
        if not final and usable - start > 2 * STRETCH + 4 * _MARGIN:
            out += self._begin()
        return out

    def _begin(self) -> list[int]:
        """A pre-token longer than the buffer: from here on it is streamed."""
        kind = next(c for c in self.bpe.run_on if c.match(self.held, 1))
        stream = PretokenStream(self.bpe)
        self.run = (kind, stream)
        out = stream.feed(self.held[0].encode())
        self.held = self.held[1:]
        end, found = self._continue(len(self.held) - self.bpe.hold, False)
        self.held = self.held[end:]
        return out + found

    def _continue(self, usable: int, final: bool) -> tuple[int, list[int]]:
        kind, stream = self.run
        m = kind.match(self.held)
        end = m.end() if m else 0
        over = final or end < usable - _MARGIN
        if not over:
            end = max(0, min(end, usable - _MARGIN) - 1)
        elif kind is self.bpe.run_on[3] and end < len(self.held):
            end = max(0, end - 1)  # the last space before a word belongs to what follows
        found = stream.feed(self.held[:end].encode())
        if over:
            found += stream.finish()
            self.run = None
        return end, found


def encode(bpe: Bpe, text: str | None) -> list[int]:
    stream, out, text = TextStream(bpe), [], text or ""
    last = max(0, len(text) - 1) // STRETCH * STRETCH
    for start in range(0, last, STRETCH):
        out += stream.feed(text[start : start + STRETCH])
    stream.held += text[last:]
    return out + stream.finish()


class _Pieces(dict):
    def __missing__(self, token: int) -> bytes:
        return b""


def decode(bpe: Bpe, ids: list[int]) -> str:
    """Bytes of the tokens through a UTF-8 state machine, a stretch of tokens at a time."""
    machine, piece = codecs.getincrementaldecoder("utf-8")(errors="replace"), bpe.bytes_of.__getitem__
    out = [machine.decode(b"".join(map(piece, ids[start : start + STRETCH]))) for start in range(0, len(ids), STRETCH)]
    return "".join([*out, machine.decode(b"", True)])


_loaded: dict[str, Bpe] = {}


def _load(content: bytes) -> Bpe:
    """One parsed tokenizer for each Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(content)
    return _loaded[key]


def read_tokenizer(path: str) -> bytes:
    """The tokenizer file, a few megabytes: checked here, broadcast to the tasks by the columns below."""
    with open(path, "rb") as f:
        content = f.read()
    _load(content)
    return content


def _portions(column: pa.Array):
    """Stretches (first, length) of a text column of about ``BATCH_CHARS`` bytes, whole texts each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + BATCH_CHARS, "right")))
        yield first, end - first
        first = end


def encoded(docs: DataFrame, content: bytes, text: str = "text", decoded: bool = False, keep: bool = True) -> DataFrame:
    """``docs`` with the token ids of its texts, ``ids`` array<int>.

    With ``decoded``, also what the ids decode to, as the column ``decoded``.  Without ``keep``, a
    Python worker drops the tokenizer and its cache (some 85 MB) after each task.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(content)
    packed = docs.select(row_of(docs).alias("row"), F.col(text).cast("string").alias("text"))

    def tokenized(batches):
        bpe = _load(shared.value)
        try:
            for batch in batches:
                for first, length in _portions(batch.column(1)):
                    part = batch.slice(first, length)
                    found = [encode(bpe, t) for t in part.column(1).to_pylist()]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
                    columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                    if decoded:
                        columns.append(pa.array([decode(bpe, x) for x in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "decoded"][: len(columns)])
        finally:
            if not keep:
                _loaded.clear()

    own = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())][: 1 + decoded]
    out = packed.mapInArrow(tokenized, StructType([packed.schema["row"], *own]))
    names = [f.name for f in own]
    return out.select(*unpacked(docs, "row", names), *names)


def decoded(docs: DataFrame, content: bytes, ids: str = "ids") -> Column:
    """The text of token ids; null ids give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        bpe = _load(shared.value)
        return pd.Series([decode(bpe, i.tolist()) if i is not None else "" for i in column], dtype=object)

    return texts(F.col(ids))
