"""Vector functions on arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column, least: float = 1e-9) -> Column:
    """Of length one; as it is if shorter than `least`."""
    n = norm(a)
    return F.when(n > least, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def local_quota(share: Column | float, k: Column | int) -> Column:
    """How many of k places are local: half goes to the even number, as Python rounds."""
    share, k = (x if isinstance(x, Column) else F.lit(x) for x in (share, k))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share.cast("double"))) * k).cast("int")
