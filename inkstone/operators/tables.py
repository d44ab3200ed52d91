"""Corpus table maintenance as DataFrame operations.

Insert-if-absent, dense id allocation, unique/foreign-key checks, cascading
deletes, latest-per-key and paged listings.  Nothing here collects rows to
the driver; the only broadcast is the per-partition offset table of
``sequential_ids`` whose size is bounded by the partition count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def sequential_ids(df: DataFrame, order_cols: list, id_col: str = "id", start_after: Column | int = 0) -> DataFrame:
    """Dense ids ``start_after + 1, +2, ...`` in ``order_cols`` order (a total order).

    No single-partition window: the data is range-partitioned and sorted
    (``orderBy``), each row gets its index inside its partition from
    ``monotonically_increasing_id`` (partition id in the upper bits), and a
    tiny table of per-partition counts (one row per partition) becomes
    offsets.  Range bounds come from sampling rows whose order after a
    shuffle is not fixed, so two evaluations could partition differently:
    the numbered rows are therefore materialised once with a reliable
    ``checkpoint()`` (under ``spark.checkpoint.dir``) and both the counts and
    the ids read that copy — consistent, and safe against executor loss.
    """
    from inkstone.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    ordered = (df.orderBy(*order_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_local", F.monotonically_increasing_id()
                           - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    local = ordered.checkpoint(eager=True)
    counts = local.groupBy("_pid").agg(F.count("*").alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    base = start_after if isinstance(start_after, Column) else F.lit(start_after)
    # offsets has one row per partition of ``local``: a bounded broadcast.
    out = local.join(F.broadcast(offsets), "_pid")
    return (out.withColumn(id_col, (base + F.col("_off") + F.col("_local") + 1).cast("long"))
            .drop("_pid", "_local", "_off"))


def key_offsets(counts: DataFrame, key: str, n_col: str = "n", out: str = "offset") -> DataFrame:
    """The offsets of ``numbered_keys``."""
    return numbered_keys(counts, key, n_col, out)[0]


def numbered_keys(counts: DataFrame, key: str, n_col: str = "n", out: str = "offset") -> tuple[DataFrame, int]:
    """((key, out), all rows): how many rows come before each key's, in key order; ``counts``: one row (key, n) per key.

    Numbers rows that already have an ordinal within their key (chunks of an
    article) as offset + ordinal: only keys and counts are sorted, never the
    rows.  Same scheme as ``sequential_ids``: range partitions, running sums
    inside each, and one total per partition.
    """
    from inkstone.session import checkpoint_dir

    checkpoint_dir(counts.sparkSession)
    ordered = counts.select(key, F.col(n_col).alias("_n")).orderBy(key).withColumn("_pid", F.spark_partition_id())
    local = ordered.checkpoint(eager=True)
    totals = local.groupBy("_pid").agg(F.sum("_n").alias("_total"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of ``local``: a bounded broadcast
    before = totals.select("_pid", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    run = local.withColumn("_run", F.sum("_n").over(inside) - F.col("_n"))
    total = local.agg(F.sum("_n")).first()[0] or 0
    return run.join(F.broadcast(before), "_pid").select(key, (F.col("_off") + F.col("_run")).cast("long").alias(out)), total


def insert_if_absent(new: DataFrame, existing: DataFrame, key: list[str], first_by: list | None = None,
                     keys: DataFrame | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING``: rows of ``new`` whose key is absent.

    Of rows that share a key the first by ``first_by`` stays (default: the
    smallest by all other columns), so reruns keep the same one.  The stored
    table is only probed for the batch's keys: with a batch below Spark's broadcast
    threshold it is scanned without a shuffle, with a larger one a filter of
    the batch's keys thins it out first (runtime Bloom filter of a semi join).
    ``keys``: the batch's keys, where they are at hand without its rows (rows that cost much are then made once).
    """
    rest = [c for c in new.columns if c not in key]
    if not rest:
        one = new.distinct()
    else:
        order = F.struct(*(first_by or [c for c in rest if not isinstance(new.schema[c].dataType, MapType)]))
        one = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(
            *key, *[F.col("_row")[c].alias(c) for c in rest]).select(*new.columns)
    known = existing.select(*key).join((new if keys is None else keys).select(*key), key, "left_semi").distinct()
    return one.join(known, key, "left_anti")


def insert_returning_ids(new: DataFrame, existing: DataFrame, key: list[str], order_cols: list,
                         id_col: str = "id") -> DataFrame:
    """Insert-if-absent plus ids after ``max(existing.id)`` (``RETURNING id``)."""
    fresh = insert_if_absent(new, existing, key)
    max_id = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    return sequential_ids(fresh, order_cols, id_col, start_after=max_id)


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Column defaults applied as ``coalesce(col, default)``; missing columns get the default."""
    for c, v in defaults.items():
        lit = v if isinstance(v, Column) else F.lit(v)
        df = df.withColumn(c, F.coalesce(F.col(c), lit) if c in df.columns else lit)
    return df


def unique_violations(df: DataFrame, key: list[str], constraint: str) -> DataFrame:
    """(constraint, key_value, n) for every key that occurs more than once."""
    kv = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return (df.groupBy(kv.alias("key_value")).agg(F.count("*").alias("n"))
            .filter(F.col("n") > 1).select(F.lit(constraint).alias("constraint"), "key_value", "n"))


def fk_orphans(child: DataFrame, child_key: list[str], parent: DataFrame, parent_key: list[str],
               edge: str, times: str | None = None) -> DataFrame:
    """(edge, key_value) for child rows whose key has no parent row.

    The parent is not made distinct first: an anti join needs no unique keys, and parents are unique as a rule.
    ``times``: a column that says how many child rows a row stands for, so that a child with many rows per key (chunks
    of an article) is joined once a key.
    """
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(parent_key, child_key)])
    kv = F.concat_ws("|", *[F.col(c).cast("string") for c in child_key])
    orphans = child.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_key])).join(p, child_key, "left_anti")
    if times:
        orphans = orphans.filter(F.col(times) > 0).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    return orphans.select(F.lit(edge).alias("edge"), kv.alias("key_value"))


def cascade_delete(child: DataFrame, deleted_parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows of ``child`` that survive deleting ``deleted_parents`` (ON DELETE CASCADE)."""
    gone = deleted_parents.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(gone, child_key, "left_anti")


def latest_by(df: DataFrame, key: str, ts: str = "published_at", tie: str = "id") -> DataFrame:
    """Newest row per ``key`` (``ORDER BY ts DESC LIMIT 1`` for every key at once).

    A ``max_by`` aggregate rather than a per-key window: it combines
    map-side, so a key holding a third of the rows is reduced in every task
    before the shuffle instead of landing in one task.
    """
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(tie)))
    return df.groupBy(key).agg(best.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in cols])


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """``ORDER BY ... LIMIT n OFFSET m`` (a top-k report: bounded by limit+offset)."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)
