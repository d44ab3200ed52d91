"""Date/time parsing cascades used by the page jobs and event streams.

All results are UTC ``timestamp_ntz`` values; site-local formats are read
in Asia/Taipei.  Parsers use ``try_to_timestamp`` so bad input gives NULL
(and the caller decides the fallback: ``as_of`` plus a warning), never an
exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_TZ = "Asia/Taipei"


def _local(s: Column, fmt: str) -> Column:
    """Parse a zone-less local string in the site zone -> UTC ntz."""
    ts = F.try_to_timestamp(s, F.lit(fmt))
    return F.to_utc_timestamp(ts, SITE_TZ).cast("timestamp_ntz")


def rfc3339(s: Column) -> Column:
    """RFC3339 with offset or Z -> UTC ntz (NULL when not RFC3339)."""
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$")
    # Session time zone is UTC, so the instant prints as UTC wall time; fractions count to the microsecond.
    return F.when(ok, F.try_to_timestamp(s).cast("timestamp_ntz"))


def site_date(s: Column) -> Column:
    """2.9.18: '2006-01-02' | '2006/01/02' (Asia/Taipei) | RFC3339, first that parses."""
    day1 = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), _local(s, "yyyy-MM-dd"))
    day2 = F.when(s.rlike(r"^\d{4}/\d{2}/\d{2}$"), _local(s, "yyyy/MM/dd"))
    return F.coalesce(day1, day2, rfc3339(s))


def roc_date(first_paragraph: Column, url: Column) -> Column:
    """2.9.19: ROC 'YYY.MM.DD' (+1911) in text, else '/YYYY/MM/blog-post...html' in the
    link (first of month), Asia/Taipei midnight -> UTC; NULL when neither is present."""
    m = r"(\d{2,3})\.(\d{2})\.(\d{2})"
    has = first_paragraph.rlike(m)
    y = F.regexp_extract(first_paragraph, m, 1).cast("int") + 1911
    mo = F.regexp_extract(first_paragraph, m, 2).cast("int")
    d = F.regexp_extract(first_paragraph, m, 3).cast("int")
    from_text = F.when(has, F.try_make_timestamp_ntz(y, mo, d, F.lit(0), F.lit(0), F.lit(0)))
    u = r"(\d{4})/(\d{2})/blog-post.+\.html"
    from_url = F.when(url.rlike(u), F.try_make_timestamp_ntz(
        F.regexp_extract(url, u, 1).cast("int"), F.regexp_extract(url, u, 2).cast("int"),
        F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    local = F.coalesce(from_text, from_url)
    return F.to_utc_timestamp(local, SITE_TZ).cast("timestamp_ntz")


# Weekday names of the Taiwanese layout, Sunday first.
WEEKDAYS_TW = ["週日", "週一", "週二", "週三", "週四", "週五", "週六"]
_TW = r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*週[日一二三四五六]\s*(上午|下午)(\d{1,2}):(\d{2})"


def taiwan_datetime(s: Column) -> Column:
    """2.9.20: '2006年1月2日 週一 下午3:04' -> timestamp (the layout has no zone: UTC)."""
    g = lambda i: F.regexp_extract(s, _TW, i)
    h = g(5).cast("int") % 12 + F.when(g(4) == "下午", 12).otherwise(0)
    return F.when(s.rlike(_TW), F.try_make_timestamp_ntz(
        g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), h, g(6).cast("int"), F.lit(0)))


def format_taiwan(ts: Column) -> Column:
    """Inverse of ``taiwan_datetime`` (used to render fixture strings)."""
    wd = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS_TW]), F.dayofweek(ts))
    h = F.hour(ts)
    ampm = F.when(h >= 12, "下午").otherwise("上午")
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(F.year(ts).cast("string"), F.lit("年"), F.month(ts).cast("string"), F.lit("月"),
                    F.dayofmonth(ts).cast("string"), F.lit("日 "), wd, F.lit(" "), ampm, h12.cast("string"),
                    F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"))


def publish_date(jsonld: Column, attr: Column, text: Column, as_of: Column) -> Column:
    """2.9.17: JSON-LD RFC3339 -> datetime attribute RFC3339 -> Taiwanese text -> as_of."""
    return F.coalesce(rfc3339(jsonld), rfc3339(attr), taiwan_datetime(text), as_of)


def unix_seconds(ts_ntz: Column) -> Column:
    return F.unix_seconds(ts_ntz.cast("timestamp"))


def from_unix_seconds(sec: Column) -> Column:
    return F.timestamp_seconds(sec).cast("timestamp_ntz")


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
