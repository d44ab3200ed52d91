"""Structured Streaming forms of the task-event jobs.

Source: JSON wire messages (``subject``, ``data``) from a file directory —
a Kafka source is a drop-in replacement (same columns after
``CAST(value AS STRING)``).  Every query is checkpointed under the session's
checkpoint directory, so a restarted driver or lost executor resumes from
the last committed offsets.  Sinks write per-epoch directories with
overwrite, which makes replays of an epoch idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkstone import session as S
from inkstone.sources import messages as M
from inkstone.streaming import commands as CM
from inkstone.streaming import state as ST

WIRE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("data", T.StringType()),
])

DEDUPE_HORIZON = "3 hours"   # redelivery horizon (cache TTL of the reference)
LATE_HORIZON = "10 minutes"  # how late an event may arrive for the rollups


def read_wire(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Message source: one JSON object per line with event_id, subject, data; all new files per micro-batch unless limited."""
    reader = spark.readStream.schema(WIRE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def read_messages(spark: SparkSession, log: str, consumer: str | None = None, deliver: str = "all",
                  max_messages: int | None = None) -> DataFrame:
    """Message source: the log at ``log`` (``sources.messages``) with seq, event_id, subject, data."""
    M.register(spark)
    reader = spark.readStream.format(M.NAME).option("deliver", deliver)
    for key, value in (("consumer", consumer), ("maxMessagesPerBatch", max_messages)):
        if value is not None:
            reader = reader.option(key, value)
    return reader.load(log)


def consume_job(spark: SparkSession, log: str, consumer: str, handle: Callable[[DataFrame, int], None], deliver: str = "all",
                max_messages: int | None = None, name: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Hand every micro-batch of the log to ``handle(batch, epoch)`` and acknowledge it when that returns.

    If ``handle`` fails, the query stops without an acknowledgement and the same messages come again at its restart.
    """
    def run(batch: DataFrame, epoch_id: int) -> None:
        handle(batch, epoch_id)
        last = batch.agg(F.max("seq")).first()[0]
        if last is not None:
            M.acknowledge(log, consumer, last + 1)

    stream = read_messages(spark, log, consumer, deliver, max_messages)
    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_for(spark, name or f"consume-{consumer}"))
            .trigger(**(trigger or {"availableNow": True})).start())


def publish(commands: DataFrame, log: str, name: str = "publish-log", trigger: dict | None = None) -> StreamingQuery:
    """Message sink: append (event_id, subject, data) to a log, every message once, with retried publishes."""
    M.register(commands.sparkSession)
    return (commands.select("event_id", "subject", "data").writeStream.format(M.NAME)
            .option("checkpointLocation", checkpoint_for(commands.sparkSession, name))
            .trigger(**(trigger or {"availableNow": True})).start(log))


def with_event_time(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("event_at", F.timestamp_seconds(F.col("m")["event_at"]).cast("timestamp"))


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return f"{S.checkpoint_dir(spark).rstrip('/')}/stream-{name}"


def _epoch_sink(out_path: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")
    return write


def dead_letter_job(wire: DataFrame, good_path: str, dead_path: str, name: str = "dead-letters",
                    trigger: dict | None = None) -> StreamingQuery:
    """Split commands into good / dead-letter outputs inside each micro-batch."""
    spark = wire.sparkSession

    def split(batch: DataFrame, epoch_id: int) -> None:
        parsed = CM.parse(batch).persist()  # two outputs, parsed once
        try:
            good, dead = CM.dead_letters(parsed)
            good.select("event_id", "subject", "data").write.mode("overwrite").parquet(f"{good_path}/epoch={epoch_id}")
            dead.write.mode("overwrite").parquet(f"{dead_path}/epoch={epoch_id}")
        finally:
            parsed.unpersist()

    return (wire.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


#: Epochs after which the task table is folded into one.
FOLD = 16


def task_state_job(wire: DataFrame, out_path: str, name: str = "task-state",
                   trigger: dict | None = None, fold: int = FOLD) -> StreamingQuery:
    """Latest status per task and day: dedupe redeliveries within the horizon, then a streaming ``max_by``
    aggregate in update mode.

    State is one row per task and day of events and goes when the watermark
    passes the day, so it never grows with the tasks of the past.  Every
    ``fold`` epochs what they wrote is folded into one table of task days, and
    ``latest_tasks`` reads the last of these and the epochs since.
    """
    spark = wire.sparkSession
    parsed = with_event_time(CM.parse(wire)).filter(F.col("reason").isNull())
    ev = (parsed.withWatermark("event_at", DEDUPE_HORIZON).dropDuplicatesWithinWatermark(["event_id"])
          .filter(F.col("subject").isin(CM.TASK_UPDATE_STATUS, CM.TASK_CREATED, CM.TASK_FAILED)))
    status = (F.when(F.col("subject") == CM.TASK_CREATED, "pending")
              .when(F.col("subject") == CM.TASK_FAILED, "failed").otherwise(F.col("m")["status"]))
    order, failed = F.struct("event_at", "event_id"), F.col("subject") == CM.TASK_FAILED
    agg = ev.groupBy(F.window("event_at", "1 day"), F.col("m")["task_id"].alias("task_id")).agg(
        F.max_by(status, order).alias("status"), F.max(order).alias("last"),
        F.max_by(F.when(failed, F.col("m")["errors"]), F.when(failed, order)).alias("error_message"),
        F.max(F.when(failed, order)).alias("last_error"),
        F.min("event_at").alias("created_at"), F.max("event_at").alias("updated_at"), F.count("*").alias("n_events"))
    agg = agg.withColumn("day", F.col("window.start")).drop("window")
    write = _epoch_sink(out_path)

    def merge(batch: DataFrame, epoch_id: int) -> None:
        write(batch, epoch_id)
        if epoch_id % fold == fold - 1:
            _task_days(batch.sparkSession, out_path, epoch_id).write.mode("overwrite").parquet(f"{_folded(out_path)}/upto={epoch_id}")

    return (agg.writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


def _folded(path: str) -> str:
    return f"{path.rstrip('/')}-folded"


def _numbers(spark: SparkSession, path: str, label: str) -> list[int]:
    """The numbers in the folder names ``label=<n>`` below ``path`` that hold finished output."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{label}=*/_SUCCESS")
    status = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in status or [])


def _task_days(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Newest row per task and day: the last folded table and the epochs after it, nothing older."""
    bases = [n for n in _numbers(spark, _folded(path), "upto") if upto is None or n < upto]
    since = bases[-1] if bases else -1
    epochs = [n for n in _numbers(spark, path, "epoch") if n > since and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{path}/epoch={n}").withColumn("epoch", F.lit(n)) for n in epochs]
    if bases:
        parts.append(spark.read.parquet(f"{_folded(path)}/upto={since}").withColumn("epoch", F.lit(since)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("task_id", "day").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (
        "task_id", "day", "epoch")]), "epoch").alias("r")).select("task_id", "day", "r.*")


def latest_tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row per task from what ``task_state_job`` wrote: the newest row of each day, then days merged.

    Reads the last folded table and the epochs after it, ``FOLD`` at most.
    """
    return _task_days(spark, path).groupBy("task_id").agg(
        F.max_by("status", "last").alias("status"), F.max_by("error_message", "last_error").alias("error_message"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.sum("n_events").alias("n_events"))


def log_rollup_job(wire: DataFrame, out_path: str, name: str = "log-rollup",
                   trigger: dict | None = None) -> StreamingQuery:
    """Tumbling 10-minute counts of log messages per level; windows close at the watermark (append)."""
    spark = wire.sparkSession
    ev = with_event_time(CM.parse(wire)).filter(F.col("reason").isNull() & (F.col("subject") == CM.TASK_LOG))
    agg = (ev.withWatermark("event_at", LATE_HORIZON)
           .groupBy(F.window("event_at", "10 minutes"), F.col("m")["level"].alias("level")).agg(F.count("*").alias("n")))
    return (agg.select(F.col("window.start").alias("window_start"), "level", "n")
            .writeStream.outputMode("append").foreachBatch(_epoch_sink(out_path))
            .option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


def message_sink(commands: DataFrame, path: str, name: str = "publish", trigger: dict | None = None) -> StreamingQuery:
    """Message sink: JSON payload per subject (directory partitioned by subject)."""
    spark = commands.sparkSession
    out = commands.select("subject", F.to_json(F.struct("event_id", "data")).alias("value"))
    return (out.writeStream.format("json").partitionBy("subject").option("path", path)
            .option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


CACHE_TTL = "60 minutes"  # submitted-text cache lifetime; scraped contents live 3 hours


def content_cache_hits(wire: DataFrame, ttl: str = CACHE_TTL) -> DataFrame:
    """Processing steps whose task cached its content within ``ttl`` before them.

    A stream-stream left-semi join: both sides carry a watermark of ``ttl``,
    so the join state holds at most one TTL of cache entries and steps.
    """
    parsed = with_event_time(CM.parse(wire)).filter(F.col("reason").isNull())
    cache = (parsed.filter(F.col("subject") == CM.TASK_CREATED)
             .select(F.col("m")["task_id"].alias("c_task"), F.col("event_at").alias("cached_at"))
             .withWatermark("cached_at", ttl))
    steps = (parsed.filter((F.col("subject") == CM.TASK_UPDATE_STATUS) & (F.col("m")["status"] == "processing"))
             .select("event_id", F.col("m")["task_id"].alias("task_id"), "event_at")
             .withWatermark("event_at", ttl))
    cond = F.expr(f"c_task = task_id AND cached_at <= event_at AND cached_at >= event_at - INTERVAL {ttl}")
    return steps.join(cache, cond, "left_semi")


def content_cache_job(wire: DataFrame, out_path: str, name: str = "content-cache",
                      trigger: dict | None = None, ttl: str = CACHE_TTL) -> StreamingQuery:
    spark = wire.sparkSession
    return (content_cache_hits(wire, ttl).writeStream.outputMode("append").foreachBatch(_epoch_sink(out_path))
            .option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


def routed_commands(wire: DataFrame) -> DataFrame:
    """Next commands for valid events, as wire messages (event_id, subject, data)."""
    good = CM.parse(wire).filter(F.col("reason").isNull())
    routed = CM.route(good)
    data = F.to_json(F.struct(F.lit(CM.MESSAGE_VERSION).alias("version"), F.col("task_id"),
                              F.col("event").alias("caused_by")))
    return routed.select("event_id", F.col("command").alias("subject"), data.alias("data"))


def route_job(wire: DataFrame, out_path: str, name: str = "route", trigger: dict | None = None) -> StreamingQuery:
    """2.12.3 as a stream: route every valid event and publish the next command."""
    return message_sink(routed_commands(wire), out_path, name=name, trigger=trigger)


RETRY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("delay_ms", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("next_at", T.TimestampType()),
])


def retry_job(wire: DataFrame, out_path: str, policy=(500, 10_000, 3), name: str = "retry",
              trigger: dict | None = None) -> StreamingQuery:
    """2.12.7 as a stream: attempt number per failed task in event order, capped exponential delay, time of the next
    delivery (the redelivery table), dead letter after the maximum.  A late failure renumbers those after it: the
    newest epoch's row of an event holds (``latest_retries``).  State: the failures younger than the watermark and a
    count of the older ones, dropped after a horizon without failures (event-time timer)."""
    spark = wire.sparkSession
    base, cap, max_attempts = policy
    failed = (with_event_time(CM.parse(wire)).filter(F.col("reason").isNull() & (F.col("subject") == CM.TASK_FAILED))
              .select("event_id", F.col("m")["task_id"].alias("task_id"), "event_at")
              .withWatermark("event_at", DEDUPE_HORIZON).dropDuplicatesWithinWatermark(["event_id"]))
    out = failed.groupBy("task_id").transformWithStateInPandas(
        ST.Retries(base, cap, max_attempts, idle_ms=3 * 3600 * 1000), RETRY_SCHEMA, "Append", "EventTime")
    return (out.writeStream.outputMode("append").foreachBatch(_epoch_sink(out_path))
            .option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_retries(spark: SparkSession, path: str) -> DataFrame:
    """One row per failure from the epochs of ``retry_job``: its newest number."""
    epochs = spark.read.option("basePath", path).parquet(path)
    cols = [c for c in epochs.columns if c not in ("event_id", "epoch")]
    return epochs.groupBy("event_id").agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select("event_id", "r.*")


def content_reads(wire: DataFrame, table: DataFrame, ttl: str = CACHE_TTL) -> DataFrame:
    """2.12.6 as a stream: every processing step with the content it reads, from the cache within ``ttl`` of its task's
    entry, else from ``table`` (task_id, content; a stream-static join), else null.

    (event_id, task_id, event_at, served_from, content); served_from: cache or db.
    """
    parsed = with_event_time(CM.parse(wire)).filter(F.col("reason").isNull())
    entry = F.col("subject") == CM.TASK_CREATED
    step = (F.col("subject") == CM.TASK_UPDATE_STATUS) & (F.col("m")["status"] == "processing")
    events = parsed.filter(entry | step).select(
        "event_id", F.col("m")["task_id"].alias("task_id"), "event_at", entry.alias("is_entry"),
        F.when(entry, F.col("m")["original_input"]).alias("content")).withWatermark("event_at", ttl)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    read = events.groupBy("task_id").transformWithStateInPandas(
        ST.ContentCache(ttl_ms), "event_id long, task_id string, event_at timestamp, hit boolean, cached string", "Append", "EventTime")
    rows = table.select(F.col("task_id").alias("t_task"), F.col("content").alias("stored"))
    joined = read.join(rows, F.col("task_id") == F.col("t_task"), "left")
    return joined.select("event_id", "task_id", "event_at", F.when(F.col("hit"), "cache").otherwise("db").alias("served_from"),
                         F.when(F.col("hit"), F.col("cached")).otherwise(F.col("stored")).alias("content"))


def content_reads_job(wire: DataFrame, table: DataFrame, out_path: str, name: str = "content-reads",
                      trigger: dict | None = None, ttl: str = CACHE_TTL) -> StreamingQuery:
    spark = wire.sparkSession
    return (content_reads(wire, table, ttl).writeStream.outputMode("append").foreachBatch(_epoch_sink(out_path))
            .option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(**(trigger or {"availableNow": True})).start())
