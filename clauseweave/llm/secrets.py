"""Secret scan: fixed rules first, then two character Markov models by log-likelihood ratio.

The rules find assigned passwords and tokens, access keys and long hexadecimal strings.
What they find is the labelled sample of random strings; everything else written in the
same characters is the sample of ordinary identifiers.  First-order transition counts of
both, over all texts, give two models.  Of a run of at least ``MIN_RUN`` such characters each
stretch that no rule covers is a secret if its log-likelihood ratio reaches ``MIN_RATIO``
nats; else its best part is if that does, with the rest of the words that it begins and ends in.

Defined cases: null and empty texts have no spans; whole texts are scanned whatever their
length; equal rows get equal spans; without any rule match the random model is uniform;
columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_hash import slices

# The rules, and the kinds in the order that breaks ties.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 20
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

MIN_RUN = 16
MIN_RATIO = 24.0
SPANS = "array<struct<kind:string,start:int,end:int>>"

_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
_JOINS = "/_.=-"
_OTHER = len(ALPHABET)
_CLASS = np.full(256, _OTHER, dtype=np.int32)
_CLASS[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_SIZE = len(ALPHABET) + 1
_KEYWORDS = ("password", "passwd", "secret", "token", "api")


def rule_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of every rule match, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _transitions(raw: np.ndarray) -> np.ndarray:
    """Counts of (previous class, class) pairs; the class of other characters stands for a start."""
    kinds = _CLASS[raw]
    before = np.empty_like(kinds)
    before[:1], before[1:] = _OTHER, kinds[:-1]
    return np.bincount(before * _SIZE + kinds, minlength=_SIZE * _SIZE)


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Transition counts [2, classes, classes] of ordinary and random strings over all texts."""

    def counted(batches):
        total = np.zeros((2, _SIZE * _SIZE), dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for _, raw, offsets in slices(column):
                total[0] += _transitions(raw)
                # two texts that meet in the buffer are not one string
                joint = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
                joint = np.unique(joint)
                np.subtract.at(total[0], _CLASS[raw[joint - 1]] * _SIZE + _CLASS[raw[joint]], 1)
                np.add.at(total[0], _OTHER * _SIZE + _CLASS[raw[joint]], 1)
            for value in column.to_pylist():
                reached = -1
                for start, _, end, own in rule_spans(value or ""):
                    if start >= reached:
                        secret = _transitions(np.frombuffer(value[own:end].encode(), np.uint8))
                        total[1] += secret
                        total[0] -= secret
                        reached = end
        at = np.arange(2 * _SIZE * _SIZE, dtype=np.int32)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at[flat != 0]), pa.array(flat[flat != 0])], names=["at", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(counted, "at int, n long")
    out = np.zeros(2 * _SIZE * _SIZE, dtype=np.float64)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():  # a fixed number of cells
        out[r.at] = max(0, r.n)
    return out.reshape(2, _SIZE, _SIZE)


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, random against ordinary."""
    plain, random = counts[:, :, :_OTHER]
    ordinary = (plain + 0.5) / (plain + 0.5).sum(1, keepdims=True)
    seen = (random + 0.05) / (random + 0.05).sum(1, keepdims=True)
    # half of the weight is on uniform strings: the labelled ones need not show every alphabet
    return np.log((seen + 1 / _OTHER) / 2) - np.log(ordinary)


def _likely(run: str, score: np.ndarray) -> list[tuple[int, int]]:
    """Where a stretch is random: all of it, or its best parts up to the ends of their words."""
    if score.sum() >= MIN_RATIO:
        return [(0, len(run))]
    out, waiting = [], [(0, len(run))]
    while waiting:
        low, high = waiting.pop()
        sums = np.concatenate([[0.0], np.cumsum(score[low:high])])
        b = int(np.argmax(sums - np.minimum.accumulate(sums)))
        a = int(np.argmin(sums[: b + 1]))
        if sums[b] - sums[a] < MIN_RATIO:
            continue
        a, b = a + low, b + low
        while a > low and run[a - 1] not in _JOINS:
            a -= 1
        while b < high and run[b] not in _JOINS:
            b += 1
        out.append((a, b))
        waiting += [(low, a), (b, high)]
    return out


def _all_spans(text: str, ratio: np.ndarray) -> list[dict]:
    rules = rule_spans(text)
    spans = [(start, kind, end) for start, kind, end, _ in rules]
    for m in _RUN.finditer(text):
        kinds = _CLASS[np.frombuffer(m[0].encode(), np.uint8)]
        score = ratio[np.concatenate([[_OTHER], kinds[:-1]]), kinds]
        at = m.start()
        for low, high in [(start, end) for start, _, end, _ in rules if start < m.end() and m.start() < end] + [(m.end(), m.end())]:
            if at < low:
                parts = _likely(m[0][at - m.start() : low - m.start()], score[at - m.start() : low - m.start()])
                spans += [(at + a, 3, at + b) for a, b in parts]
            at = max(at, high)
    return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in sorted(spans)]


def span_column(docs: DataFrame, counts: np.ndarray, text: str = "text") -> Column:
    """All secrets of a text: kind, start and end in code points (end exclusive), by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios(counts))

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([_all_spans(t or "", shared.value) for t in texts], dtype=object)

    return spans(F.col(text).cast("string"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``secrets``: the spans of the models trained on these texts."""
    return docs.withColumn("secrets", span_column(docs, train(docs, text), text))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; overlapping spans become one mark."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios(train(docs, text)))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _without(t, _all_spans(t, shared.value), mark) for t in texts], dtype=object)

    return docs.withColumn(text, cleaned(F.col(text).cast("string")))


def _without(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]]) if spans else text
