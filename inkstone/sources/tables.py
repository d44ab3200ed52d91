"""Parquet table readers.

Every reader returns a lazy DataFrame so Catalyst can push filters and
column pruning into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


#: Setting for local runs on small files: partitions that every scan is dealt into.
SCAN_PARTITIONS = "spark.inkstone.scanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan into as many partitions as ``spark.inkstone.scanPartitions`` says; unset, leave it alone.

    A small file with one row group is one task, whatever its text operators
    cost.  Local sessions (``session.build``) set the number; on a cluster it
    is unset and ``spark.sql.files.maxPartitionBytes`` with properly written
    row groups decides.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Expose every raw table as a temp view for ``spark.sql`` users."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
