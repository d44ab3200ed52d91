"""Canonical corpus views derived from the fixture tables.

The same definitions exist as DuckDB SQL in ``inkstone.plans.oracle`` so the
oracle and Spark see identical inputs.  Everything is a projection over one
scan (no shuffles), so Catalyst prunes unused derived columns away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import keys
from inkstone.functions.bind import running_sums
from inkstone.sources.tables import table

# Party enum, in declaration order; doc_id % 4 picks one.
PARTIES = ["none", "KMT", "DPP", "TPP"]
# Task status enum and source type enum, in declaration order.
TASK_STATUSES = ["pending", "processing", "done", "failed"]
SOURCE_TYPES = ["url", "text"]

EPOCH = "2024-01-01 00:00:00"
URL_MOD = 97


def paragraphs_of(text: Column) -> Column:
    """Non-empty, space-trimmed lines of a text, in order."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def running_byte_cuts(paragraphs: Column) -> Column:
    """Cumulative UTF-8 byte length after each paragraph (reference ``cuts``).

    Running sums inside the row: no shuffle, near linear in the paragraphs of a document.
    """
    return running_sums(F.transform(paragraphs, lambda p: F.octet_length(p)))


def _hours_after_epoch(n: Column) -> Column:
    return F.timestamp_add("HOUR", n, F.lit(EPOCH).cast("timestamp_ntz"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles(id, title, url, source, party, paragraphs, content, cuts, md5, published_at, lang)."""
    d = table(spark, sf_dir, "documents")
    paras = paragraphs_of(F.col("text"))
    party = F.element_at(F.array(*[F.lit(p) for p in PARTIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/article/"),
                   (F.col("doc_id") % URL_MOD).cast("string"))
    out = d.select(
        F.col("doc_id").alias("id"),
        F.trim(F.substring_index(F.col("text"), "\n", 1)).alias("title"),
        url.alias("url"),
        F.col("source"),
        party.alias("party"),
        paras.alias("paragraphs"),
        F.col("lang"),
        _hours_after_epoch(F.col("doc_id")).alias("published_at"),
        F.col("text"),
    )
    return out.select(
        "id", "title", "url", "source", "party", "paragraphs",
        F.array_join("paragraphs", "").alias("content"),
        running_byte_cuts(F.col("paragraphs")).alias("cuts"),
        keys.article_key(F.col("title"), F.col("url"), F.col("published_at")).alias("md5"),
        "published_at", "lang", "text",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings(id, article_id, chunk_id, model_id, vector)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.expr("vec_id div 5").cast("long").alias("article_id"),  # integer division, exact for any id
        F.col("vec_id").alias("chunk_id"),
        (F.col("label") % 2).cast("int").alias("model_id"),
        F.col("embedding").alias("vector"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """models(id, name, created_at): one row per distinct model id."""
    ids = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("int").alias("id")).distinct()
    return ids.select(
        "id",
        F.concat(F.lit("model-"), F.col("id").cast("string")).alias("name"),
        F.timestamp_add("DAY", F.col("id"), F.lit(EPOCH).cast("timestamp_ntz")).alias("created_at"),
    )


def press(spark: SparkSession, sf_dir: str) -> DataFrame:
    """press(id, content) from the benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))


# event_type -> task subject used by the messages view.
EVENT_SUBJECT = {
    "signup": "pending",
    "view": "processing",
    "purchase": "done",
    "error": "failed",
    "click": "log",
}


def subject_of(event_type: Column) -> Column:
    expr = None
    for k, v in EVENT_SUBJECT.items():
        expr = (F.when(event_type == k, v) if expr is None else expr.when(event_type == k, v))
    return expr


def messages(spark: SparkSession, sf_dir: str, subjects: list[str] | None = None) -> DataFrame:
    """messages(event_id, task_id, subject, event_at, payload, value).

    ``subjects`` filters on the stored event type, so the filter reaches the scan.
    """
    ev = table(spark, sf_dir, "events")
    if subjects is not None:
        ev = ev.filter(F.col("event_type").isin([k for k, v in EVENT_SUBJECT.items() if v in subjects]))
    return ev.select(
        "event_id",
        F.col("user_id").alias("task_id"),
        subject_of(F.col("event_type")).alias("subject"),
        F.col("ts").alias("event_at"),
        F.col("props").alias("payload"),
        "value",
        "event_type",
    )


# Log levels in declaration order; event_id % 7 picks one.
LOG_LEVELS = ["Debug", "Info", "Warn", "Error", "Fatal", "Panic", "Trace"]


def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_messages(event_id, task_id, event_at, level): valid log messages, times in whole seconds as on the wire.

    The same rules as the wire messages: a value below 1 is a malformed message.
    """
    level = F.element_at(F.array(*[F.lit(x) for x in LOG_LEVELS]), (F.col("event_id") % len(LOG_LEVELS) + 1).cast("int"))
    m = messages(spark, sf_dir, ["log"]).filter(~F.coalesce(F.col("value") < 1, F.lit(False)))
    return m.select("event_id", "task_id", F.date_trunc("second", "event_at").alias("event_at"), level.alias("level"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
