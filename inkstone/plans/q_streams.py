"""Registered task-event queries (2.12, batch forms of the streaming jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import dates as D
from inkstone.operators import pages as PG
from inkstone.operators import sequence as SQ
from inkstone.plans.registry import register
from inkstone.sources import adapters as A
from inkstone.streaming import commands as CM
from inkstone.streaming.tasks import uuid_of

_WIRE_SQL = """
, wire AS (
  SELECT event_id, task_id, event_at, value, subject AS ev_subject, payload,
         CASE subject WHEN 'pending' THEN 'task.created' WHEN 'processing' THEN 'task.update.status'
              WHEN 'done' THEN 'task.update.status' WHEN 'failed' THEN 'task.failed' WHEN 'log' THEN 'task.logs' END
           AS subject,
         CASE WHEN value < 1 THEN 'malformed'
              WHEN subject IN ('processing', 'done') AND value >= 400 THEN 'bad status' END AS reason,
         CASE WHEN subject = 'pending' THEN CASE WHEN value >= 50 THEN 'url' ELSE 'text' END END AS source
  FROM messages)
"""


def wire(spark, sf_dir):
    return CM.render(A.messages(spark, sf_dir))


def parsed(spark, sf_dir):
    return CM.parse(wire(spark, sf_dir))


@register("parse_commands", _WIRE_SQL + "SELECT event_id, subject, reason FROM wire", views=("messages",))
def parse_commands(spark, sf_dir):
    """2.12.1: typed commands from the wire; wrong JSON types or enum values rejected."""
    return parsed(spark, sf_dir).select("event_id", "subject", "reason")


@register("dead_letters", _WIRE_SQL + """
SELECT event_id, 'task.failed' AS subject, reason AS error, true AS bytes_kept FROM wire WHERE reason IS NOT NULL
""", views=("messages",))
def dead_letters(spark, sf_dir):
    """2.12.2: malformed / invalid messages become task.failed with the original bytes."""
    p = parsed(spark, sf_dir)
    _, dead = CM.dead_letters(p)
    orig = p.select("event_id", "data")
    return dead.join(orig, "event_id").select(
        "event_id", "subject", "error",
        (F.decode(F.unbase64("data_b64"), "UTF-8") == F.col("data")).alias("bytes_kept"))


@register("route_events", _WIRE_SQL + r"""
SELECT 'event-' || CAST(event_id AS VARCHAR) AS event_key, subject AS event,
       CASE WHEN source = 'url' THEN 'task.scrape' ELSE 'task.generate_title' END AS command
FROM wire WHERE subject = 'task.created' AND reason IS NULL
UNION ALL
SELECT 'page-' || CAST(page_id AS VARCHAR), 'article.scraped', 'task.extract.keyword'
FROM pages WHERE regexp_matches(html, '(?s)<article>.*?<p>')
UNION ALL
SELECT 'page-' || CAST(page_id AS VARCHAR), 'article.scraped', 'task.create.embedding'
FROM pages WHERE regexp_matches(html, '(?s)<article>.*?<p>')
""", views=("messages",))
def route_events(spark, sf_dir):
    """2.12.3: next command per event: task.created by source, article.scraped fans out to two.

    article.scraped events come from the pages whose extraction produced content.
    """
    good, _ = CM.dead_letters(parsed(spark, sf_dir))
    tasks_ev = good.select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("event_key"),
                           "subject", "m")
    ex = PG.extract(A.raw_pages(spark, sf_dir)).filter(F.col("error").isNull())
    scraped = ex.select(F.concat(F.lit("page-"), F.col("id").cast("string")).alias("event_key"),
                        F.lit(CM.ARTICLE_SCRAPED).alias("subject"),
                        F.struct(uuid_of(F.col("id")).alias("task_id"), F.lit(None).cast("string").alias("source"))
                        .alias("m"))
    ev = tasks_ev.select("event_key", "subject", F.struct(F.col("m")["task_id"].alias("task_id"),
                                                          F.col("m")["source"].alias("source")).alias("m"))
    r = CM.route(ev.unionByName(scraped).withColumnRenamed("event_key", "event_id"))
    return r.select(F.col("event_id").alias("event_key"), "event", "command")


def deliveries(spark, sf_dir):
    """Delivery log: every message once, failed-task messages delivered again 10 s later (NAK)."""
    m = A.messages(spark, sf_dir).select("event_id", "task_id", "subject", "event_at")
    again = m.filter(F.col("subject") == "failed").withColumn("event_at", F.col("event_at") + F.expr("INTERVAL 10 SECONDS"))
    return m.withColumn("delivery", F.lit(1)).unionByName(again.withColumn("delivery", F.lit(2)))


@register("dedupe_events", """
, d AS (SELECT event_id, event_at AS arrived FROM messages
        UNION ALL SELECT event_id, event_at + INTERVAL 10 SECOND FROM messages WHERE subject = 'failed')
SELECT event_id, count(*) AS n_deliveries, min(arrived) AS first_arrival FROM d GROUP BY event_id
""", views=("messages",))
def dedupe_events(spark, sf_dir):
    """2.12.5: redelivered messages collapse to one per event id (batch form of
    ``dropDuplicatesWithinWatermark``), keeping the first arrival."""
    d = deliveries(spark, sf_dir)
    return d.groupBy("event_id").agg(F.count("*").alias("n_deliveries"), F.min("event_at").alias("first_arrival"))


# Retry policies (base ms, max ms, max attempts).
RETRY_MODEL = (500, 10_000, 3)
RETRY_PUBLISH = (500, 10_000, 5)
RETRY_FETCH = (1_000, 60_000, None)


@register("retry_backoff", """
SELECT event_id, task_id, attempt,
       CAST(least(10000, 500 * pow(2, attempt)) AS BIGINT) AS delay_ms,
       CASE WHEN attempt >= 3 THEN 'dead_letter' ELSE 'retry' END AS action
FROM (SELECT event_id, task_id,
             row_number() OVER (PARTITION BY task_id ORDER BY event_at, event_id) - 1 AS attempt
      FROM messages WHERE subject = 'failed')
""", views=("messages",))
def retry_backoff(spark, sf_dir):
    """2.12.7: attempt number per task failure, capped exponential delay, dead letter after max attempts.

    The attempt ordinal comes from ``rank_within`` (no per-task window, so a
    task with a third of the failures is still spread over many tasks).
    """
    base, cap, max_attempts = RETRY_MODEL
    f = A.messages(spark, sf_dir, ["failed"]).select("event_id", "task_id", "event_at")
    r = SQ.rank_within(f, "task_id", ["event_at", "event_id"], "ordinal").withColumn("attempt", F.col("ordinal") - 1)
    return r.select("event_id", "task_id", "attempt", CM.backoff_ms(F.col("attempt"), base, cap).alias("delay_ms"),
                    F.when(F.col("attempt") >= max_attempts, "dead_letter").otherwise("retry").alias("action"))


@register("log_rollup", _WIRE_SQL + """
SELECT time_bucket(INTERVAL 10 MINUTE, date_trunc('second', event_at)) AS window_start,
       ['Debug', 'Info', 'Warn', 'Error', 'Fatal', 'Panic', 'Trace'][1 + event_id % 7] AS level, count(*) AS n
FROM wire WHERE subject = 'task.logs' AND reason IS NULL GROUP BY 1, 2
""", views=("messages",))
def log_rollup(spark, sf_dir):
    """2.12.8: tumbling 10-minute counts of log messages per level (batch form of the windowed stream)."""
    m = A.log_messages(spark, sf_dir)
    return (m.groupBy(F.window("event_at", "10 minutes"), "level").agg(F.count("*").alias("n"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "level", "n"))


#: Percentiles are exact for groups of fewer rows, and within one in so many ranks beyond.
PERCENTILE_ACCURACY = 100_000


@register("stage_latency", """
SELECT subject, count(*) AS n, round(avg(ms), 1) AS avg_ms, max(ms) AS max_ms,
       quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM (
  SELECT subject, epoch_us(event_at) // 1000 - epoch_us(prev_at) // 1000 AS ms FROM (
    SELECT subject, event_at,
           lag(event_at) OVER (PARTITION BY task_id ORDER BY event_at, event_id) AS prev_at FROM messages))
WHERE ms IS NOT NULL GROUP BY subject
""", views=("messages",))
def stage_latency(spark, sf_dir):
    """2.12.9: elapsed ms from a task's previous event to each event, per subject.

    Previous event via ``with_previous`` (equi-join on the global sequence),
    then partial aggregates per subject.
    """
    m = A.messages(spark, sf_dir).select("event_id", "task_id", "subject", "event_at")
    p = SQ.with_previous(m, "task_id", ["event_at", "event_id"], ["event_at"])
    ms = D.elapsed_ms(F.col("prev_event_at"), F.col("event_at"))
    return (p.withColumn("ms", ms).filter(F.col("ms").isNotNull()).groupBy("subject")
            .agg(F.count("*").alias("n"), F.round(F.avg("ms"), 1).alias("avg_ms"), F.max("ms").alias("max_ms"),
                 F.percentile_approx("ms", 0.5, PERCENTILE_ACCURACY).alias("p50_ms"),
                 F.percentile_approx("ms", 0.95, PERCENTILE_ACCURACY).alias("p95_ms")))


# Cache lifetimes in minutes: submitted texts, scraped contents.
CACHE_TTL, CONTENT_TTL = 60, 180


def _cache_sql(minutes: int) -> str:
    return f"""
SELECT p.event_id,
       CASE WHEN EXISTS (SELECT 1 FROM messages c WHERE c.subject = 'pending' AND c.task_id = p.task_id
                         AND c.event_at <= p.event_at AND c.event_at >= p.event_at - INTERVAL {minutes} MINUTE)
            THEN 'cache' ELSE 'db' END AS served_from
FROM messages p WHERE p.subject = 'processing'
"""


def _served_from(spark, sf_dir, minutes: int):
    """Range join keyed by (task, bucket): buckets are as wide as the TTL, so an entry can serve only its own and
    the next one.  One left join; the newest entry per step decides, combined before any shuffle of its own."""
    m = A.messages(spark, sf_dir, ["pending", "processing"])
    bucket = F.floor(F.unix_seconds(F.col("event_at").cast("timestamp")) / (60 * minutes))
    cache = (m.filter(F.col("subject") == "pending")
             .select(F.col("task_id").alias("c_task"), F.col("event_at").alias("cached_at"),
                     F.explode(F.array(bucket, bucket + 1)).alias("c_bucket")))
    steps = m.filter(F.col("subject") == "processing").select("event_id", "task_id", "event_at", bucket.alias("bucket"))
    hit = ((F.col("task_id") == F.col("c_task")) & (F.col("bucket") == F.col("c_bucket"))
           & (F.col("cached_at") <= F.col("event_at"))
           & (F.col("cached_at") >= F.col("event_at") - F.make_dt_interval(mins=F.lit(minutes))))
    return steps.join(cache, hit, "left").groupBy("event_id").agg(
        F.when(F.count("cached_at") > 0, "cache").otherwise("db").alias("served_from"))


@register("content_cache", _cache_sql(CACHE_TTL), views=("messages",))
def content_cache(spark, sf_dir):
    """2.12.6: a processing step reads the text its task cached at creation if the entry is younger than the
    TTL of 60 minutes, else the table."""
    return _served_from(spark, sf_dir, CACHE_TTL)


@register("content_cache_scraped", _cache_sql(CONTENT_TTL), views=("messages",))
def content_cache_scraped(spark, sf_dir):
    """2.12.6: the same for scraped contents, which live 3 hours."""
    return _served_from(spark, sf_dir, CONTENT_TTL)


@register("redeliveries", _WIRE_SQL + """
SELECT event_id, reason AS error, d AS attempt, CASE WHEN d < 5 THEN 'redeliver' ELSE 'drop' END AS action,
       CASE WHEN d < 5 THEN event_at + to_milliseconds(CAST(least(10000, 500 * pow(2, d)) AS BIGINT)) END AS next_at
FROM (SELECT *, unnest(range(0, 6)) AS d FROM wire WHERE reason IS NOT NULL) WHERE d <= event_id % 6
""", views=("messages",))
def redeliveries(spark, sf_dir):
    """2.12.2: redelivery table of rejected messages: attempt, action, time of the next delivery.

    Rejected messages come back ``event_id % 6`` times (the fixture's rule);
    after five attempts they are dropped.
    """
    base, cap, most = RETRY_PUBLISH
    p = parsed(spark, sf_dir).filter(F.col("reason").isNotNull()).select("event_id", F.col("reason").alias("error"))
    at = A.messages(spark, sf_dir).select("event_id", "event_at")
    p = p.join(at, "event_id").withColumn("attempt", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 6).cast("int"))))
    delay = CM.backoff_ms(F.col("attempt"), base, cap)
    again = F.col("attempt") < most
    return p.select("event_id", "error", "attempt", F.when(again, "redeliver").otherwise("drop").alias("action"),
                    F.when(again, F.col("event_at") + F.make_dt_interval(secs=(delay / 1000).cast("decimal(18,6)"))).alias("next_at"))
