"""Numeric functions whose exact binary behaviour the results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1: splits a double into two 26-bit halves


def py_round(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value of a double.

    ``F.round`` rounds the decimal rendering half up, which differs on ties such
    as 1/128.  The scaled product and its exact rounding error together tell on
    which side of the tie the binary value lies.  Valid for |value|*10**digits
    below 2**52.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    big = value * F.lit(_SPLITTER)
    high = big - (big - value)
    error = (high * scale - product) + (value - high) * scale
    whole = F.floor(product).cast("double")
    beyond = (product - whole) - F.lit(0.5)
    up = (
        (beyond > 0)
        | ((beyond == 0) & (error > 0))
        | ((beyond == 0) & (error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    )
    return (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision, summed in index order."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / norm)
