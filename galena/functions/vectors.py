"""Vector arithmetic on array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: a lambda's argument is bound, an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, floor: float = 1e-12) -> Column:
    """Unit length; a zero vector stays zero."""
    unit = lambda b: F.transform(b["v"], lambda x: x / b["n"])
    return let(doubles(v), lambda d: let(F.struct(d.alias("v"), F.greatest(norm(d), F.lit(floor)).alias("n")), unit))


def generalized_mean(v: Column, p: float, floor: float = 1e-6) -> Column:
    """(mean of x^p)^(1/p) over entries of at least floor."""
    total = F.aggregate(F.transform(doubles(v), lambda x: F.pow(F.greatest(x, F.lit(floor)), F.lit(p))), F.lit(0.0), lambda s, x: s + x)
    return F.pow(total / F.size(v), F.lit(1 / p))
