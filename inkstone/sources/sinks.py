"""Sinks: appends, partition-scoped overwrites, the press-release record files.

Writes go to shared storage paths given by the caller; appends are
idempotent only through keys (use ``operators.tables.insert_if_absent``
first), overwrites are scoped to the partitions present in the batch
(dynamic partition overwrite), so a retried job rewrites exactly its own
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Rewrite only the partitions present in ``df`` (e.g. a cascade delete's survivors)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def write_records(records: DataFrame, path: str) -> None:
    """2.1.10: one JSON record per page, partitioned by date; each record carries
    its ``date_md5(link).json`` name so the skip set can be rebuilt from the files."""
    records.write.mode("append").partitionBy("date").json(path)


def known_keys(spark: SparkSession, path: str) -> DataFrame:
    """2.1.11: skip set (32-hex link keys) from the records already written."""
    return (spark.read.json(path).select(F.regexp_extract("file_name", r"(\w{32})\.json", 1).alias("key"))
            .filter(F.col("key") != "").distinct())
