"""Task messages on the wire: render, parse/validate, dead-letter, route.

Every function takes and returns DataFrames, so the same code serves a
batch table and a streaming DataFrame (``readStream``): parsing is a
``from_json`` with an explicit schema in PERMISSIVE mode, routing is a
broadcast equi-join with a fixed-size routing table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.sources.adapters import LOG_LEVELS, SOURCE_TYPES, TASK_STATUSES
from inkstone.streaming.tasks import uuid_of

MESSAGE_VERSION = "1.0"

# Subjects.
TASK_CREATED = "task.created"
ARTICLE_SCRAPED = "article.scraped"
KEYWORDS_EXTRACTED = "article.keywords.extracted"
EMBEDDING_CREATED = "article.embedding.created"
TASK_FAILED = "task.failed"
TASK_SCRAPE = "task.scrape"
TASK_GENERATE_TITLE = "task.generate_title"
TASK_EXTRACT_KEYWORDS = "task.extract.keyword"
TASK_CREATE_EMBEDDING = "task.create.embedding"
TASK_UPDATE_STATUS = "task.update.status"
TASK_LOG = "task.logs"

# Embed types.
EMBED_TYPES = ["query", "passage"]

# Event -> next commands (subject, source or '' for any).
ROUTES = [
    (TASK_CREATED, "url", TASK_SCRAPE),
    (TASK_CREATED, "text", TASK_GENERATE_TITLE),
    (ARTICLE_SCRAPED, "", TASK_EXTRACT_KEYWORDS),
    (ARTICLE_SCRAPED, "", TASK_CREATE_EMBEDDING),
]

COMMAND_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("user_id", T.IntegerType()),
    T.StructField("cache_key", T.StringType()),
    T.StructField("event_at", T.LongType()),
    T.StructField("elapsed_ms", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("original_input", T.StringType()),
    T.StructField("article_id", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("errors", T.StringType()),
    T.StructField("embed_type", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def render(messages: DataFrame) -> DataFrame:
    """(event_id, subject, data) wire messages for the task event table.

    Fixture rules: events with value < 1 carry a string user_id (malformed
    JSON types); status updates with value >= 400 carry an unknown status; log
    levels follow the event id.
    """
    s, v = F.col("subject"), F.col("value")
    wire = (F.when(s == "pending", TASK_CREATED).when(s.isin("processing", "done"), TASK_UPDATE_STATUS)
            .when(s == "failed", TASK_FAILED).when(s == "log", TASK_LOG))
    status = F.when(v >= 400, F.lit("unknown")).otherwise(s)

    def body(user_id: Column) -> Column:
        return F.to_json(F.struct(
            F.lit(MESSAGE_VERSION).alias("version"),
            uuid_of(F.col("task_id")).alias("task_id"),
            user_id.alias("user_id"),
            F.unix_seconds(F.col("event_at").cast("timestamp")).alias("event_at"),
            F.when(s == "pending", F.when(v >= 50, "url").otherwise("text")).alias("source"),
            F.when(s == "pending", F.col("payload")).alias("original_input"),
            F.when(s.isin("processing", "done"), status).alias("status"),
            F.when(s == "log", F.element_at(F.array(*[F.lit(x) for x in LOG_LEVELS]),
                                            (F.col("event_id") % len(LOG_LEVELS) + 1).cast("int"))).alias("level"),
            F.when(s == "log", F.col("payload")).alias("message"),
            F.when(s == "failed", F.col("payload")).alias("errors"),
        ))

    data = F.when(v < 1, body(F.concat(F.lit("u"), F.col("task_id").cast("string")))) \
        .otherwise(body(F.col("task_id").cast("int")))
    return messages.select("event_id", wire.alias("subject"), data.alias("data"))


def parse(raw: DataFrame, data_col: str = "data") -> DataFrame:
    """Typed commands; ``reason`` is NULL for valid rows, else why it was rejected."""
    p = raw.withColumn("m", F.from_json(F.col(data_col), COMMAND_SCHEMA,
                                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    m = lambda c: F.col("m")[c]
    subj = F.col("subject")
    reason = (F.when(F.col("m").isNull() | m("_corrupt").isNotNull(), F.lit("malformed"))
              .when(m("task_id").isNull() | ~m("task_id").rlike(UUID_RE), F.lit("bad task_id"))
              .when((subj == TASK_UPDATE_STATUS) & ~m("status").isin(TASK_STATUSES), F.lit("bad status"))
              .when((subj == TASK_CREATED) & ~m("source").isin(SOURCE_TYPES), F.lit("bad source"))
              .when((subj == TASK_LOG) & ~m("level").isin(LOG_LEVELS), F.lit("bad level"))
              .when((subj == TASK_CREATE_EMBEDDING) & ~m("embed_type").isin(EMBED_TYPES), F.lit("bad embed_type")))
    return p.withColumn("reason", reason)


def dead_letters(parsed: DataFrame, data_col: str = "data") -> tuple[DataFrame, DataFrame]:
    """(good commands, dead letters).  A dead letter is a ``task.failed`` message
    carrying the error and the original bytes (base64, encoded once)."""
    good = parsed.filter(F.col("reason").isNull())
    bad = parsed.filter(F.col("reason").isNotNull()).select(
        "event_id", F.lit(TASK_FAILED).alias("subject"), F.col("reason").alias("error"),
        F.base64(F.encode(F.col(data_col), "UTF-8")).alias("data_b64"))
    return good, bad


def routing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "event string, source string, command string")


def route(events: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Next commands for each event (task.created by source; article.scraped fans out).

    The routing table is a fixed literal of len(ROUTES) rows: broadcast.
    """
    spark = spark or events.sparkSession
    rt = F.broadcast(routing_table(spark))
    e = events.withColumn("_src", F.coalesce(F.col("m")["source"], F.lit("")))
    j = e.join(rt, (e["subject"] == rt["event"]) & ((rt["source"] == "") | (rt["source"] == e["_src"])))
    return j.select("event_id", F.col("subject").alias("event"), "command", F.col("m")["task_id"].alias("task_id"))


def backoff_ms(attempt: Column, base_ms: int, max_ms: int) -> Column:
    """delay = min(max, base * 2^attempt)."""
    return F.least(F.lit(max_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), attempt)).cast("long")
