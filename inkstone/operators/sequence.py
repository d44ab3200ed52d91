"""Per-key ordinal and previous-row lookups that do not put a key in one task.

A ``Window.partitionBy(key)`` sends every row of a key to one task; with a
key holding a third of the rows that task holds a third of the data.  Here
rows are numbered globally in (key, order) order with ``sequential_ids``
(range partitioning splits a hot key across many partitions), so:

* ordinal within key = global seq - first seq of the key + 1, where the first
  seq per key is a partial aggregate joined back (one row per key);
* previous row = the row with seq - 1 (an equi-join on a unique key), kept
  only when it belongs to the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators.tables import sequential_ids


def rank_within(df: DataFrame, key: str, order: list, out: str = "ordinal") -> DataFrame:
    """Adds ``out`` = 1, 2, ... within each key in ``order`` (order must be a total order)."""
    seq = sequential_ids(df, [key, *order], "_seq")
    first = seq.groupBy(key).agg(F.min("_seq").alias("_first"))
    return seq.join(first, key).withColumn(out, F.col("_seq") - F.col("_first") + 1).drop("_seq", "_first")


def with_previous(df: DataFrame, key: str, order: list, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds ``prefix + c`` for each c: the value on the previous row of the same key (NULL for the first)."""
    seq = sequential_ids(df, [key, *order], "_seq")
    prev = seq.select((F.col("_seq") + 1).alias("_seq"), F.col(key).alias("_pkey"),
                      *[F.col(c).alias(prefix + c) for c in cols])
    j = seq.join(prev, "_seq", "left")
    same = F.col("_pkey") == F.col(key)
    out = j
    for c in cols:
        out = out.withColumn(prefix + c, F.when(same, F.col(prefix + c)))
    return out.drop("_seq", "_pkey")
