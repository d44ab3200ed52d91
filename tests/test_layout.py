"""Tables by day: time ranges list and read the folders of their days only."""
import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from inkstone.operators import layout as L
from inkstone.sources import adapters as A


def test_intervals_prune_days(spark, sf):
    path = tempfile.mkdtemp(prefix="days-", dir="/tmp") + "/articles"
    arts = A.articles(spark, sf).select("id", "title", "published_at")
    odd = spark.createDataFrame([(-1, "none", None)], "id long, title string, published_at timestamp_ntz")
    L.write_by_day(arts.unionByName(odd), path)
    assert len([d for d in os.listdir(path) if d.startswith("day=")]) == arts.select(F.to_date("published_at")).distinct().count() + 1
    start, end = datetime(2024, 1, 2, 5), datetime(2024, 1, 4, 7)
    got = L.in_interval(spark, path, start, end)
    want = arts.where(F.col("published_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 51
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters" in plan and "published_at" in plan
    read = {f.rsplit("/", 2)[1] for f in got.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {"day=2024-01-02", "day=2024-01-03", "day=2024-01-04"}
    assert L.in_interval(spark, path, datetime(2030, 1, 1), datetime(2030, 1, 2)).count() == 0


def test_a_hot_day_is_several_files(spark):
    path = tempfile.mkdtemp(prefix="days-", dir="/tmp") + "/hot"
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.timestamp_add(
            "HOUR", F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 100), F.lit("2024-01-01").cast("timestamp_ntz")).alias("published_at"))
        L.write_by_day(df.repartition(8), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(f"{path}/day=2024-01-01") if f.endswith(".parquet")]
    assert len(files) > 2 and spark.read.parquet(path).count() == 60_000
