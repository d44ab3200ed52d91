"""Exact duplicates through an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text.  The directory starts with one
bucket; a bucket that holds more than ``capacity`` keys splits on the next
leading bit, and the directory doubles whenever a split needs a bit that it
does not have yet.  A bucket's keys therefore form one key range, which one
owner task sorts and writes as its own files.  Within a key, entries are
chained: the build groups by key *and* normalised text, so two texts share an
entry only if their bytes are equal, however the hash behaves.  Copies of a text
are first combined within ``SALTS`` shares of the input, so a text that fills a
third of the table reaches its owner as a few entries; the directory sends these
to their buckets, and only there do groups, sizes and the ids to keep come about.  At
``max_depth`` buckets stop splitting and simply grow (the exact way past the
limit).  Only DataFrame functions are used.

Edge cases: a null text is an empty text, and all empty texts are equal; an
empty table gives an empty result; a null doc_id never wins over another id;
rows that repeat a doc_id are members like any other, and all rows that carry
the winning id are kept.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import SPACE, code_points, shared_path, stored, texts

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 16_384
#: Shares of the input within which copies are combined before they go to their bucket.
SALTS = 16
#: Bits of the largest directory: 65,536 entries, the proven bound of the broadcast below.
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _key(norm: Column, key_bits: int) -> Column:
    key = F.xxhash64(norm)
    return key if key_bits == 64 else key.bitwiseAND(F.lit(-1 << (64 - key_bits)).cast("long"))


def _lead(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """Directory (slot, bucket, depth) over ``keys`` (key: long) and its global depth.

    Splitting until every bucket fits has a unique end state: the shortest
    prefixes whose load is at most ``capacity``.  It is taken from the loads of
    all prefixes, at most ``2 ** (max_depth + 1)`` rows however large the input.
    """
    cells = keys.select("key").distinct().groupBy(_lead(F.col("key"), max_depth).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"))
    level = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    load = stored(level.groupBy(
        "depth", F.expr(f"shiftrightunsigned(cell, {max_depth} - depth)").alias("prefix")).agg(
        F.sum("n").alias("n")), "loads")
    parent = load.where(F.col("n") > capacity).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    fits = load.where((F.col("n") <= capacity) | (F.col("depth") == max_depth)).withColumn(
        "up", F.shiftrightunsigned("prefix", 1))
    # a bucket is a prefix that fits (or cannot split) below a prefix that does not
    buckets = fits.where("depth > 0").join(parent, ["depth", "up"], "left_semi").unionByName(
        fits.where("depth = 0")).select("depth", "prefix")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    slots = buckets.select(
        "depth",
        F.expr(f"shiftleft(prefix, {depth} - depth)").alias("bucket"),
        F.explode(F.expr(
            f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")).alias("slot"))
    return slots, depth


def _keyed(docs: DataFrame, key_bits: int, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    plain = texts(docs, id_col, text_col) if row_col is None else texts(docs, id_col, text_col, docs[row_col].alias("row"))
    norm = plain.select(
        "doc_id", code_points(F.col("text")).alias("n"), normalised(F.col("text")).alias("norm"),
        *(["row"] if row_col else []))
    return norm.withColumn("key", _key(F.col("norm"), key_bits))


def build_index(docs: DataFrame, keys: DataFrame, path: str, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH,
                key_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of ``docs`` to ``path`` and return it as stored.

    One entry per distinct normalised text: bucket, key, sha (of the text),
    size (rows), keep_id.
    """
    # longest original text first, then smallest id, as one number that partial aggregation can hold
    step = F.lit(Decimal(10 ** 20))
    no_id = F.lit(Decimal(10 ** 19))  # beyond every long
    rank = F.col("n").cast("decimal(12,0)") * step - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), no_id)
    rows = _keyed(docs, key_bits, id_col, text_col).withColumn("rank", rank).withColumn(
        "share", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    local = rows.groupBy("share", "key", "norm").agg(
        F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.max("rank").alias("rank"))
    slots, depth = directory(keys, capacity, max_depth)
    # at most 2 ** max_depth directory entries
    sent = local.withColumn("slot", _lead(F.col("key"), depth)).join(F.broadcast(slots), "slot").drop("slot", "share")
    # the owner of a bucket chains the entries of a key: equal bytes are one entry (no shuffle, the bucket is here whole)
    chained = sent.repartition("bucket").groupBy("bucket", "depth", "key", "norm").agg(
        F.sum("size").alias("size"), F.max("n").alias("n"), F.max("rank").alias("rank"))
    keep = F.col("n").cast("decimal(12,0)") * step - F.col("rank")
    entries = chained.select("key", F.sha2("norm", 256).alias("sha"), "size",
                             F.when(keep < no_id, keep).cast("long").alias("keep_id"), "depth", "bucket")
    entries.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
    return docs.sparkSession.read.schema("key long, sha string, size long, keep_id long, depth int, bucket long").parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                max_depth: int = MAX_DEPTH, key_bits: int = 64, index_path: str | None = None,
                row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with ``row_col`` also row (its value) and n.

    ``key_bits`` below 64 weakens the hash (tests use it to force collisions).
    """
    spark = docs.sparkSession
    extra = [F.col("row"), F.col("n")] if row_col else []
    keys = stored(_keyed(docs, key_bits, id_col, text_col, row_col).select(
        "doc_id", "key", F.sha2("norm", 256).alias("sha"), *extra), "keys")
    index = build_index(docs, keys, index_path or shared_path(spark, "index"), capacity, max_depth, key_bits,
                        id_col, text_col)
    return keys.join(index, ["key", "sha"]).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), *extra)


def kept_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(row): one row of every group of equal texts, by the unique numbers in ``row_col``.

    The row is that of ``exact_dedup``; where several rows carry its id and an
    equal text, the one with the most code points, then the smallest number.
    """
    step = F.lit(Decimal(10 ** 20))
    decided = exact_dedup(docs, id_col, text_col, row_col=row_col, **options).where("kept")
    rank = F.col("n").cast("decimal(12,0)") * step - F.col("row").cast("decimal(20,0)")
    best = decided.groupBy("keep_id", "text_sha256").agg(F.max("n").alias("n"), F.max(rank).alias("rank"))
    return best.select((F.col("n").cast("decimal(12,0)") * step - F.col("rank")).cast("long").alias("row"))
