"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, so a
lost executor costs a re-run of its tasks and never a recomputation of the
whole lineage.  Nothing here collects rows; the driver only sees scalars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.session import checkpoint_dir

#: Rows per Arrow batch handed to Python kernels: 500 texts of 20,000 words stay near 50 MB.
ARROW_ROWS = 500
#: White space of the word rules of most operators: blank and x09 to x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """(doc_id, text, extra) with null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *extra)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/inkstone-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long) as (id, component = smallest id).

    Alternating large-star and small-star rounds: each takes the smallest
    neighbour per node (combined before the shuffle) and re-hangs the others
    on it, so the largest group costs one aggregate row per task and an
    equi-join that adaptive execution may split.  Stops when the edges no
    longer change.  Null ends and self loops are ignored.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stored(e, "edges")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["k"]).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        hung = large.join(low, large["u"] == low["k"]).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
