"""Corpus tables laid out by day: time ranges read the folders of their days and list no others.

``write_by_day`` puts rows into one folder per UTC day of a time column; a day
with many rows is split over tasks and files (a rebalancing shuffle), days with
few share tasks.  ``in_interval`` filters on the day, which prunes folders
before any file is listed, and on the time itself within them.  Rows without a
time lie in a folder of their own and are in no interval.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"


def write_by_day(df: DataFrame, path: str, time_col: str = "published_at", mode: str = "error") -> None:
    """Write ``df`` below ``path``, a folder per day of ``time_col`` (column ``day``)."""
    dated = df.withColumn(DAY, F.to_date(time_col))
    dated.hint("rebalance", DAY).write.mode(mode).partitionBy(DAY).parquet(path)


def in_interval(spark: SparkSession, path: str, start: datetime, end: datetime, time_col: str = "published_at") -> DataFrame:
    """Rows with ``start <= time <= end``, without the column ``day``."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    rows = spark.read.parquet(path)
    return rows.where(F.col(DAY).between(F.lit(start.date()), F.lit(end.date()))).where(
        F.col(time_col).between(low, high)).drop(DAY)
