"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut
the score into grades: P(grade <= k) = sigmoid(threshold[k] - w.x).  A text's expected grade
and tail probability P(grade >= k) decide its selection.

Features of a whole text: presence of its hashed words (runs of letters and digits, A-Z
lower-cased), and the square roots of the shares of its character-class pairs, of repeated
neighbours, of repeated words and of repeated five-word shingles.

Fitting reads a sample of at most about ``SAMPLE_ROWS`` labelled rows (by a hash of the id),
which is the only bound here; scoring covers every row.

Defined cases: null and empty texts have no word and get the score of an empty text; rows
without a full rating teach nothing; without any rating every text gets the top grade;
equal texts get equal scores; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_hash import SHINGLE_WORDS, chain, slices, word_hashes

SAMPLE_ROWS = 20_000
WORD_BUCKETS = 1 << 17
LEAST_TEXTS = 4
WORD_SCORE = 4.0
ROUNDS = 400

# classes of bytes: each ASCII sign on its own, letters and digits pooled
_CLASSES = 40
_CLASS = np.full(256, 3, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 4, 5
for _i, _b in enumerate(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""):
    _CLASS[_b] = 6 + _i
_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SHAPES = _CLASSES * _CLASSES + 3
FEATURES = WORD_BUCKETS + _SHAPES


def _repeated(hashes: np.ndarray) -> float:
    return 1 - len(np.unique(hashes)) / len(hashes) if len(hashes) else 0.0


def features(column: pa.Array):
    """(feature numbers, values) of every text of a column, in order."""
    for _, raw, offsets in slices(column):
        wordy, wordy_at = word_hashes(raw, offsets, _WORDY[raw])
        plain, plain_at = word_hashes(raw, offsets)
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]]
            words, tokens = wordy[wordy_at[i] : wordy_at[i + 1]], plain[plain_at[i] : plain_at[i + 1]]
            present = np.unique((words >> np.uint64(47)).astype(np.int64))
            kinds = _CLASS[text]
            pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES) if len(text) > 1 else np.zeros(0)
            seen = np.flatnonzero(pairs)
            neighbours = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
            extra = np.array([neighbours, _repeated(words), _repeated(chain(tokens, SHINGLE_WORDS))])
            used = np.flatnonzero(extra)
            shape = np.sqrt(np.concatenate([pairs[seen] / max(1, len(text) - 1), extra[used]])) * 4
            at = np.concatenate([present, WORD_BUCKETS + seen, WORD_BUCKETS + _CLASSES * _CLASSES + used])
            yield at.astype(np.int32), np.concatenate([np.ones(len(present)), shape]).astype(np.float32)


@dataclass(frozen=True)
class Ordinal:
    """Weights and ordered thresholds of a fitted model."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, by row."""
        return _sigmoid(score[:, None] - self.thresholds[None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, ridge: float = 2e-4) -> Ordinal:
    """Maximum penalised likelihood by full-batch gradient steps (Adam), thresholds kept in order.

    Words in fewer than ``LEAST_TEXTS`` texts of the sample are left out, and so are words
    whose texts' mean grade is within ``WORD_SCORE`` standard errors of the mean of all.
    """
    lengths = np.array([len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    line = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    texts = np.bincount(at, minlength=FEATURES)
    mean, spread = grades.mean(), max(grades.std(), 1e-9)
    summed = np.bincount(at, grades[line].astype(np.float64), minlength=FEATURES)
    telling = np.abs(summed - texts * mean) >= WORD_SCORE * spread * np.sqrt(np.maximum(texts, 1))
    telling[WORD_BUCKETS:] = True
    common = (telling & (texts >= LEAST_TEXTS))[at]
    at, value, line = at[common], value[common].astype(np.float64), line[common]
    used, at = np.unique(at, return_inverse=True)
    w, first = np.zeros(len(used)), np.zeros(len(used))
    second = np.zeros(len(used))
    share = np.array([(grades < k).mean() for k in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    cut_first, cut_second = np.zeros(levels - 1), np.zeros(levels - 1)
    n = len(rows)
    for step in range(1, ROUNDS + 1):
        score = np.bincount(line, value * w[at], minlength=n)
        tail = _sigmoid(score[:, None] - cut[None])
        # likelihood of a grade: difference of neighbouring tails
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        own = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        slope = full * (1 - full)
        upper, lower = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        pull = (upper - lower) / own
        grad = -np.bincount(at, value * pull[line], minlength=len(used)) / n + ridge * w
        cut_grad = np.zeros(levels - 1)
        for k in range(levels - 1):
            cut_grad[k] = ((grades == k + 1) * upper / own - (grades == k) * lower / own).sum() / n
        rate = 0.1 * (1 - step / (ROUNDS + 1)) + 0.002
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        cut_first, cut_second = 0.9 * cut_first + 0.1 * cut_grad, 0.999 * cut_second + 0.001 * cut_grad**2
        cut = np.sort(cut - rate * (cut_first / (1 - 0.9**step)) / (np.sqrt(cut_second / (1 - 0.999**step)) + 1e-8))
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[used] = w
    return Ordinal(weights, cut)


def fit(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> Ordinal | None:
    """Fits on ``ratings`` (doc_id, grade from 0); None if there is no rating.

    At most about ``sample`` rated texts are read: those whose id's hash falls below the
    share that gives so many.
    """
    rated = ratings.select(F.col("doc_id").alias("_rated"), F.col("grade").cast("int").alias("_grade")).dropna().groupBy("_rated").agg(
        F.min("_grade").alias("_grade")
    )
    count, top = rated.agg(F.count("*"), F.max("_grade")).first()
    if not count or not top:
        return None
    share = min(1.0, sample / count)
    picked = rated.filter(F.pmod(F.xxhash64("_rated"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(picked, F.col("_id") == F.col("_rated"))

    def extracted(batches):
        for batch in batches:
            found = list(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([a for a, _ in found], pa.list_(pa.int32())),
                    pa.array([v for _, v in found], pa.list_(pa.float32())),
                ],
                names=["id", "grade", "at", "value"],
            )

    kept = texts.select(F.col("_id").cast("string"), "_text", "_grade").mapInArrow(
        extracted, "id string, grade int, at array<int>, value array<float>"
    )
    table = kept.toArrow().sort_by("id")
    if not table.num_rows:
        return None
    rows = list(zip(_lists(table["at"]), _lists(table["value"]), strict=True))
    return fit_rows(rows, table["grade"].to_numpy().astype(np.int64), int(top) + 1)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for part in column.chunks:
        at, flat = part.offsets.to_numpy(), part.values.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def graded(docs: DataFrame, model: Ordinal | None, text: str = "text") -> Column:
    """Struct (score, expected, tail): the linear score, the expected grade and P(grade is the top one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,expected:double,tail:double>")
    def grade(texts: pa.Array) -> pa.Array:
        fitted = shared.value
        if fitted is None:
            columns = [np.full(len(texts), x) for x in (0.0, 1.0, 1.0)]
        else:
            score = np.array([float(fitted.weights[at].astype(np.float64) @ value) for at, value in features(texts)])
            tails = fitted.tails(score) if len(score) else np.zeros((0, 1))
            columns = [score, tails.sum(1), tails[:, -1]]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in columns], names=["score", "expected", "tail"])

    return grade(F.col(text).cast("string"))


def selected(grade: Column, least: float = 0.5) -> Column:
    """Whether a document is kept: the top grade is at least ``least`` likely."""
    return grade["tail"] >= F.lit(least)
