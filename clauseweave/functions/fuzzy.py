"""The one similarity Spark has no built-in for: matching-blocks ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def length_bound(left: Column, right: Column) -> Column:
    """Upper bound of the ratio from the lengths alone."""
    total = F.char_length(left) + F.char_length(right)
    return 2.0 * F.least(F.char_length(left), F.char_length(right)) / total


def matching_ratio(query: str, label: Column, cutoff: float) -> Column:
    """Ratio of ``query`` to each non-null label, or null when below ``cutoff``.

    The cheap letter-count bound is tried first, so the quadratic matcher only
    runs for labels that can still reach the cutoff.
    """

    def ratio(value: str | None) -> float | None:
        if value is None:
            return None
        matcher = SequenceMatcher(None, query, value)
        if matcher.quick_ratio() < cutoff:
            return None
        score = matcher.ratio()
        return score if score >= cutoff else None

    @F.pandas_udf("double")
    def ratios(labels: pd.Series) -> pd.Series:
        return pd.Series([ratio(v) for v in labels], dtype="float64")

    return ratios(label)
