"""Vector functions on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(EPS))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def mean_pool(tokens: Column) -> Column:
    """Mean of an array of equally long arrays."""
    n = F.size(tokens)
    sums = F.aggregate(F.slice(tokens, 2, n), F.transform(tokens[0], lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(sums, lambda x: x / n)


def pad_with_mask(values: Column, size: int) -> Column:
    """An array padded with nulls to ``size``, and a mask of what is real."""
    short = F.greatest(F.lit(size) - F.size(values), F.lit(0))
    padded = F.concat(values, F.array_repeat(F.lit(None), short))
    return F.transform(padded, lambda v, i: F.struct(v.alias("value"), (i < F.size(values)).alias("real")))
