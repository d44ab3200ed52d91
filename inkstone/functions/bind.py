"""Per-row value binding for higher-order array expressions.

An expression referenced inside a lambda (``transform``, ``filter`` ...) is
evaluated once per array element.  ``let(value, body)`` evaluates ``value``
once per row and hands it to ``body`` as a lambda variable:
``aggregate(array(0), value, (acc, _) -> acc, body)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Bind two values (as one struct) once per row."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))


def running_sums(numbers: Column) -> Column:
    """[x1, x1+x2, ...] of an array of ints, as array<int>.

    A fold that appends to its result copies it at every step.  The numbers are
    therefore summed in runs of about sqrt(n), 64 at least, and the runs' totals
    in a fold of their own, so n numbers cost n * sqrt(n) small copies at most.
    """
    empty = F.array().cast("array<int>")

    def appended(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(empty.alias("out"), F.lit(0).alias("sum")),
                           lambda acc, x: F.struct(F.concat(acc["out"], F.array((acc["sum"] + x).cast("int"))).alias("out"),
                                                   (acc["sum"] + x).cast("int").alias("sum")),
                           lambda acc: acc["out"])

    def runs(s: Column) -> Column:
        xs, width = s["a"], s["b"]
        starts = F.sequence(F.lit(1), F.size(xs), width)
        return F.transform(starts, lambda k: appended(F.slice(xs, k, width)))

    def joined(parts: Column) -> Column:
        totals = appended(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = F.concat(F.array(F.lit(0)), totals)
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(
            p, lambda x: (x + F.element_at(b, k + 1)).cast("int")))))

    def build(xs: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        pieces = let(F.struct(xs.alias("a"), width.alias("b")), runs)
        return F.when(F.size(xs) > 0, let(pieces, joined)).otherwise(F.when(xs.isNotNull(), empty))

    return let(numbers, build)
