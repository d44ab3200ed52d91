"""Registered date/time queries (2.9.17-2.9.21).

The fixture has no site date strings, so each event's timestamp is rendered
in the site formats (JVM-side) and parsed back by the operators; the oracle
computes the expected instants directly from the timestamp.  Some strings,
chosen by event id, are broken or missing and must give NULL or the next step
of a cascade; RFC 3339 strings carry fractions of a second.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import dates as D
from inkstone.plans.registry import register
from inkstone.sources.tables import table

AS_OF = "2024-06-01 00:00:00"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type")


@register("site_dates", """
SELECT event_id,
       CASE WHEN event_id % 7 NOT IN (1, 2) THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR END AS d_dash,
       CASE WHEN event_id % 7 <> 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR END AS d_slash,
       CASE WHEN event_id % 7 = 4 THEN NULL WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts)
            ELSE date_trunc('second', ts) END - INTERVAL 8 HOUR AS d_rfc3339
FROM events
""")
def site_dates(spark, sf_dir):
    """2.9.18: '2006-01-02', '2006/01/02' (Asia/Taipei) and RFC3339 with offset; anything else is no date."""
    e = _events(spark, sf_dir)
    ts, kind = F.col("ts"), F.col("event_id") % 7
    dash = F.when(kind == 1, F.date_format(ts, "yyyy-MM-'31x'")).when(kind != 2, F.date_format(ts, "yyyy-MM-dd"))
    slash = F.when(kind == 3, F.date_format(ts, "yyyy/'13'/dd")).otherwise(F.date_format(ts, "yyyy/MM/dd"))
    rfc = F.when(kind == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(_rfc(ts), F.lit("+08:00")))
    return e.select("event_id", D.site_date(dash).alias("d_dash"), D.site_date(slash).alias("d_slash"),
                    D.site_date(rfc).alias("d_rfc3339"))


def _rfc(ts):
    """Even events with milliseconds, odd ones without."""
    return F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))


@register("roc_date", """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'click'
            THEN CAST(date_trunc('month', ts) AS TIMESTAMP) - INTERVAL 8 HOUR
            ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR END AS published
FROM events
""")
def roc_date(spark, sf_dir):
    """2.9.19: ROC 'YYY.MM.DD' in the first paragraph, else '/YYYY/MM/blog-post' in the link.

    Click events carry only the link form, error events neither; the others carry the ROC text.
    """
    e = _events(spark, sf_dir)
    ts = F.col("ts")
    roc = F.format_string("公告 %d.%s.%s 發布", F.year(ts) - 1911, F.date_format(ts, "MM"), F.date_format(ts, "dd"))
    link = F.concat(F.lit("https://www.kmt.org.tw/"), F.date_format(ts, "yyyy/MM"),
                    F.when(F.col("event_type") == "error", "/about.html").otherwise("/blog-post_1.html"))
    text = F.when(F.col("event_type").isin("click", "error"), F.lit("無日期 13.5.7")).otherwise(roc)
    return e.select("event_id", D.roc_date(text, link).alias("published"))


@register("taiwan_datetime", """
SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN date_trunc('minute', ts) END AS parsed FROM events
""")
def taiwan_datetime(spark, sf_dir):
    """2.9.20: '2006年1月2日 週一 下午3:04' rendered from each timestamp and parsed back."""
    e = _events(spark, sf_dir)
    text = F.when(F.col("event_id") % 6 == 5, F.date_format("ts", "yyyy年M月d日")).otherwise(D.format_taiwan(F.col("ts")))
    return e.select("event_id", D.taiwan_datetime(text).alias("parsed"))


@register("publish_date_cascade", f"""
SELECT event_id,
       CASE WHEN event_type IN ('purchase', 'view') OR (event_type = 'click' AND event_id % 3 <> 0)
              THEN CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END - INTERVAL 8 HOUR
            WHEN event_type IN ('signup', 'click') THEN date_trunc('minute', ts)
            ELSE TIMESTAMP '{AS_OF}' END AS published
FROM events
""")
def publish_date_cascade(spark, sf_dir):
    """2.9.17: JSON-LD -> datetime attribute -> Taiwanese text -> as_of.

    purchase events carry JSON-LD, view events the attribute, signup events the
    text, click events a broken JSON-LD date, an attribute that is broken for
    every third, and the text; the rest carry broken strings only and fall back to ``as_of``.
    """
    e = _events(spark, sf_dir)
    ts, et = F.col("ts"), F.col("event_type")
    rfc = F.concat(_rfc(ts), F.lit("+08:00"))
    bad = F.date_format(ts, "yyyy-MM-dd'T'HH:mm")
    jsonld = F.when(et == "purchase", rfc).when(et.isin("click", "error"), bad)
    attr = F.when((et == "view") | ((et == "click") & (F.col("event_id") % 3 != 0)), rfc).when(et.isin("click", "error"), bad)
    text = F.when(et.isin("signup", "click"), D.format_taiwan(ts)).when(et == "error", "昨天")
    return e.select("event_id", D.publish_date(jsonld, attr, text, F.lit(AS_OF).cast("timestamp_ntz"))
                    .alias("published"))


@register("event_time", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS event_at,
       make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS event_ts,
       epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000 AS elapsed_ms
FROM events
""")
def event_time(spark, sf_dir):
    """2.9.21: unix seconds <-> timestamp, elapsed milliseconds since the epoch of the fixture."""
    e = _events(spark, sf_dir)
    sec = D.unix_seconds(F.col("ts"))
    return e.select("event_id", sec.alias("event_at"), D.from_unix_seconds(sec).alias("event_ts"),
                    D.elapsed_ms(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("elapsed_ms"))
