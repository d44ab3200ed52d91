"""Vector distance column builders (pgvector-style operators as Columns).

All arithmetic is done in double from float inputs; vectors of different
length give NULL (``zip_with`` pads with NULL), so callers check dimension
first (``dimension_ok``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "inner_product")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    """a / ||a|| (NaN for a zero vector).  The norm is a fold result bound to a
    lambda variable, so it is computed once per row, not once per element."""
    nan = F.lit(float("nan"))
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"),
                       lambda s: F.transform(a, lambda x: F.when(s > 0, x.cast("double") / F.sqrt(s))
                                             .otherwise(nan)))


def l2(a: Column, b: Column) -> Column:
    """``a <-> b``: Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def cosine_distance(a: Column, b: Column) -> Column:
    """``a <=> b``: 1 - cos(a, b).  NaN when either vector has zero norm."""
    den = norm(a) * norm(b)
    # pgvector returns NaN for a zero vector; ANSI division would raise instead
    return F.when(den == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot(a, b) / den)


def neg_inner_product(a: Column, b: Column) -> Column:
    """``a <#> b``: negative inner product (ascending order = most similar first)."""
    return -dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == "l2":
        return l2(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "inner_product":
        return neg_inner_product(a, b)
    raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")


def is_valid(v: Column) -> Column:
    """``vector IS NOT NULL AND vector <> '[]'``."""
    return v.isNotNull() & (F.size(v) > 0)


def dimension_ok(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == F.lit(dim))


def as_scaled_ints(v: Column, digits: int = 4) -> Column:
    """Render a float vector as comma-joined round(x * 10^digits) integers.

    A stable, engine-independent text form used where results are compared
    with the SQL oracle.
    """
    scale = float(10 ** digits)
    return F.array_join(
        F.transform(v, lambda x: F.round(x.cast("double") * F.lit(scale)).cast("long").cast("string")), ",")
