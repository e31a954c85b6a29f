"""Language identification as inference in a mixture of languages.

Each language is a multinomial over hashed byte trigrams of lower-cased text, learned from
labelled texts.  A text is a mixture of languages: expectation-maximisation estimates the
proportions from the likelihoods of its trigrams.  The set of languages starts with the
best single one and grows while the log-likelihood, less half a log of the number of
trigrams for each more proportion, grows.

Defined cases: ``und`` with score 0 for a null text, one without a letter, or where no
language was learned; a null label teaches nothing; whole texts are read; equal texts get
equal results; ties go to the smaller language code; columns of the input named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ROUNDS = 30
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_STRETCH = 1 << 22


def _trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text between two spaces; everything but letters is a space."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw = np.where(letter, raw, np.uint32(32))
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = code[(code & np.uint32(0xFFFF)) != np.uint32(0x2020)]  # nothing but space after the first letter
    code = code[code != np.uint32(0x202020)]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _stretches(text: str) -> Iterator[np.ndarray]:
    """Trigrams of a text, a stretch at a time; a stretch ends after a space, so that no trigram is cut or added."""
    start = 0
    while start < len(text):
        end = start + _STRETCH
        if end < len(text):
            gap = text.find(" ", end)
            end = gap + 1 if gap >= 0 else len(text)
        yield _trigrams(text[start:end])
        start = end


def _counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for part in _stretches(text):
        total += np.bincount(part, minlength=BUCKETS)
    return total


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods [bucket, language] from all rows with a text and a label."""

    def counted(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in totals:
                    totals[name] = np.zeros(BUCKETS, dtype=np.int64)
                for part in _stretches(value):
                    if len(part) < BUCKETS // 8:
                        np.add.at(totals[name], part, 1)
                    else:
                        totals[name] += np.bincount(part, minlength=BUCKETS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "at", "n"]
            )

    known = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    summed = known.mapInArrow(counted, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    lines = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cells"))  # BUCKETS cells at most
    names, columns = [], []
    for r in lines.orderBy("lang").toLocalIterator():
        total = np.full(BUCKETS, 0.05)
        total[[c.at for c in r.cells]] += [c.n for c in r.cells]
        names.append(r.lang)
        columns.append(np.log(total / total.sum()))  # BUCKETS doubles a language
    return names, np.array(columns).T if columns else np.zeros((BUCKETS, 0))


def _maximised(weights: np.ndarray, density: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions; returns them and the log-likelihood."""
    total = weights.sum()
    for _ in range(ROUNDS):
        share = share * ((weights / (density @ share)) @ density) / total
    return share, float(weights @ np.log(density @ share))


def mixture(weights: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Proportions of the languages [language] for trigrams with ``weights`` and log-likelihoods [trigram, language].

    Languages outside the selected set have proportion 0.
    """
    total = weights.sum()
    penalty = 0.5 * np.log(max(total, 2.0))
    single = weights @ logs
    chosen = [int(single.argmax())]
    scaled = np.exp(logs - logs.max(1, keepdims=True))
    share, best = np.ones(1), float(weights @ np.log(scaled[:, chosen[0]]))
    while len(chosen) < logs.shape[1]:
        density = scaled[:, chosen] @ share
        # the log-likelihood is concave: a language cannot gain more than its slope at proportion 0
        slope = (weights / density) @ scaled - total
        slope[chosen] = -np.inf
        added = int(slope.argmax())
        if slope[added] <= penalty:
            break
        part, likelihood = _maximised(weights, scaled[:, [*chosen, added]], np.append(share * 0.8, 0.2))
        if likelihood - best <= penalty:
            break
        chosen, share, best = [*chosen, added], part, likelihood
    while len(chosen) > 2:  # a language taken on early may not be needed beside the later ones
        least = int(share.argmin())
        others = [c for i, c in enumerate(chosen) if i != least]
        part, likelihood = _maximised(weights, scaled[:, others], np.delete(share, least) / (1 - share[least]))
        if best - likelihood > penalty:
            break
        chosen, share, best = others, part, likelihood
    out = np.zeros(logs.shape[1])
    out[chosen] = share
    return out


def predicted(docs: DataFrame, names: list[str], logs: np.ndarray, text: str = "text") -> Column:
    """Struct (lang, score, languages): the main language, how sure, and the selected set with proportions."""
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))

    def one(value: str | None) -> dict:
        labels, table = shared.value
        if value is None or not labels or not _LETTER.search(value):
            return {"lang": UNKNOWN, "score": 0.0, "languages": []}
        if len(value) < _STRETCH:
            at, n = np.unique(_trigrams(value), return_counts=True)
        else:
            every = _counts(value)
            at = np.flatnonzero(every)
            n = every[at]
        weights, own = n.astype(np.float64), table[at]
        share = mixture(weights, own)
        top = int(share.argmax())
        single = weights @ own
        # among languages of their own: how much more likely the main one is than the rest
        rest = np.exp(np.minimum(0.0, np.delete(single, top) - single[top])).sum() if (share > 0).sum() == 1 else 0.0
        return {
            "lang": labels[top],
            "score": float(min(1.0, share[top] / (1 + rest))),
            "languages": [{"lang": labels[i], "share": float(share[i])} for i in np.argsort(-share) if share[i] > 0],
        }

    @F.pandas_udf("struct<lang:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["lang", "score", "languages"])

    return predict(F.col(text).cast("string"))
