"""Vector mathematics as folds within arrays: single precision where models have it, double where scores need it, and
always from left to right, so that results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Double dot product of two vectors. Vectors of different lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once a row though use's own folds refer to it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """Unit vector in single precision; the zero vector stays as it is."""
    return bound(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float"))))


def mean_pool(hidden: Column, mask: Column, dimensions: int) -> Column:
    """Mean of the token vectors where mask is 1. hidden: token after token, ``dimensions`` values each; sums are single
    precision in token order. Without such a token the vector is zero."""
    zero = F.lit(0.0).cast("float")
    counting = F.filter(F.sequence(F.lit(0), F.greatest(F.size(mask) - 1, F.lit(0))), lambda t: F.coalesce(F.get(mask, t) == 1, F.lit(False)))

    def mean(on: Column) -> Column:
        n = F.size(on)
        total = lambda d: F.aggregate(on, zero, lambda acc, t: (acc + F.get(hidden, t * dimensions + d)).cast("float"))
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.when(n == 0, zero).otherwise((total(d) / F.greatest(n, F.lit(1)).cast("float")).cast("float")))

    pooled = bound(counting, mean)
    fits = F.size(hidden) == F.size(mask) * dimensions
    return F.when(fits, pooled).when(hidden.isNull() | mask.isNull(), F.lit(None).cast("array<float>")).otherwise(F.raise_error(F.lit("hidden state and mask don't fit the dimensions")).cast("array<float>"))
