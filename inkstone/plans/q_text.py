"""Registered string-function and validation queries (2.2.10-2.2.13, 2.9.1-2.9.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import keys
from inkstone.functions import text as TX
from inkstone.plans.registry import register
from inkstone.sources import adapters as A
from inkstone.sources.tables import table
from inkstone.streaming.commands import EMBED_TYPES, LOG_LEVELS

_GO_SPACE_RE2 = TX.GO_SPACE  # same class body is valid RE2


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- 2.9 strings

@register("normalize_text", r"""
SELECT doc_id,
       regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\t\n\f\r ]+', ' ', 'g'),
                      '[\x00-\x1F\x7F-\x9F\x{3000} ]', '', 'g') AS normalized,
       regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\t\n\f\r ]+', ' ', 'g'),
                      '[\x00-\x1F\x7F-\x9F\x{3000}]', '', 'g') AS normalized_spaced
FROM documents
""")
def normalize_text(spark, sf_dir):
    """2.9.1: reference normalisation (all spaces removed) and the space-keeping variant."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.normalize(F.col("text")).alias("normalized"),
                    TX.normalize(F.col("text"), keep_spaces=True).alias("normalized_spaced"))


_FW_FROM, _FW_TO = TX.fullwidth_tables()


@register("fullwidth_to_ascii", f"""
SELECT doc_id, translate(text, {_sql_str(_FW_FROM)}, {_sql_str(_FW_TO)}) AS converted FROM documents
""")
def fullwidth_to_ascii(spark, sf_dir):
    """2.9.2: full-width punctuation and letters to ASCII."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.fullwidth_to_ascii(F.col("text")).alias("converted"))


_SECRET_RE = r'token = "([0-9A-Za-z_\-]+)"'


@register("mask_secret", r"""
SELECT doc_id, pos, length(secret) AS n,
       CASE WHEN length(secret) <= 10 THEN repeat('●', length(secret))
            ELSE "left"(secret, 5) || repeat('●', least(length(secret) - 10, 10)) || "right"(secret, 5) END AS masked,
       CASE WHEN length(secret) <= 10 THEN repeat('*', length(secret))
            ELSE "left"(secret, 5) || repeat('*', length(secret) - 10) || "right"(secret, 5) END AS hidden
FROM (SELECT doc_id, unnest(s) AS secret, generate_subscripts(s, 1) - 1 AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, 'token = "([0-9A-Za-z_\-]+)"', 1) AS s FROM documents))
""")
def mask_secret(spark, sf_dir):
    """2.9.4: mask every ``token = "..."`` secret found in the documents."""
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_SECRET_RE), 1)).alias("pos", "secret"))
    return s.select("doc_id", "pos", F.length("secret").alias("n"),
                    TX.mask_secret(F.col("secret")).alias("masked"),
                    TX.mask_secret(F.col("secret"), mark="*", cap=None).alias("hidden"))


@register("article_key", """
SELECT id, md5, to_base64(unhex(md5(title || source || strftime(published_at, '%Y-%m-%d')))) AS user_md5
FROM articles
""", views=("articles",))
def article_key(spark, sf_dir):
    """2.9.5: base64(md5(title||url||date)); user articles pass the source in the url slot."""
    a = A.articles(spark, sf_dir)
    return a.select("id", keys.article_key(F.col("title"), F.col("url"), F.col("published_at")).alias("md5"),
                    keys.article_key(F.col("title"), F.col("source"), F.col("published_at")).alias("user_md5"))


@register("link_key", """
SELECT page_id, md5(regexp_replace(url, '^https://', '')) AS link_key FROM pages
""")
def link_key(spark, sf_dir):
    """2.9.7: canonical hex md5 of the link without ``https://``."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", keys.link_key(F.col("url")).alias("link_key"))


_TRIM = f"'^[{_GO_SPACE_RE2}]+|[{_GO_SPACE_RE2}]+$'"


@register("title_from_text", f"""
SELECT doc_id, title, len(body) AS n_lines, array_to_string(body, chr(10)) AS body FROM (
  SELECT doc_id,
         CASE WHEN starts_with(lines[1], '#') THEN regexp_replace(substr(lines[1], 2), {_TRIM}, '', 'g') ELSE '' END AS title,
         list_filter(list_transform(CASE WHEN starts_with(lines[1], '#') THEN lines[2:] ELSE lines END,
                                    lambda x: regexp_replace(x, {_TRIM}, '', 'g')),
                     lambda x: length(x) > 0) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
""")
def title_from_text(spark, sf_dir):
    """2.9.8: '#' first line is the title; remaining lines trimmed, empties dropped."""
    d = table(spark, sf_dir, "documents")
    tb = TX.title_and_body(F.col("text"))
    return d.select("doc_id", tb["title"].alias("title"), F.size(tb["lines"]).alias("n_lines"),
                    F.array_join(tb["lines"], "\n").alias("body"))


@register("description_fallback", """
SELECT id, CASE WHEN id % 3 = 0 THEN title || ' (summary)' WHEN length(j) > 100 THEN substring(j, 1, 100) || '...' ELSE j END AS description
FROM (SELECT id, title, array_to_string(paragraphs, ' ') AS j FROM articles)
""", views=("articles",))
def description_fallback(spark, sf_dir):
    """2.9.9: no description -> first 100 code points of the space-joined contents + '...'.

    Every third article has a description, every third an empty one, the rest none.
    """
    a = A.articles(spark, sf_dir)
    given = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" (summary)"))).when(F.col("id") % 3 == 1, "")
    return a.select("id", TX.description_fallback(given, F.col("paragraphs")).alias("description"))


def _log_line(event_id, task_id, payload):
    """JSON log lines: levels of all kinds and spacings, empty ones, other types and none, by event id."""
    kinds = ['"level":"Info",', '"level" : "Warn",', '"level":\t"Error",', '"level":"",', '"level":3,', '', '"loglevel":"Debug",',
             '"level":"Trace_2",']
    pick = F.element_at(F.array(*[F.lit(k) for k in kinds]), (event_id % len(kinds) + 1).cast("int"))
    return F.concat(F.lit("{"), pick, F.lit('"task_id":'), task_id.cast("string"), F.lit(',"payload":'), payload, F.lit("}"))


@register("log_level", r"""
SELECT event_id,
       coalesce(nullif(regexp_extract(line, '"level"\s*:\s*"([A-Za-z0-9_]+)"', 1), ''), 'unknown') AS level
FROM (SELECT event_id,
             '{' || ['"level":"Info",', '"level" : "Warn",', '"level":' || chr(9) || '"Error",', '"level":"",', '"level":3,', '',
                     '"loglevel":"Debug",', '"level":"Trace_2",'][1 + event_id % 8] ||
             '"task_id":' || CAST(task_id AS VARCHAR) || ',"payload":' || payload || '}' AS line
      FROM messages)
""", views=("messages",))
def log_level(spark, sf_dir):
    """2.9.13: level of a JSON log line ('unknown' when absent); log lines rendered from messages."""
    m = A.messages(spark, sf_dir)
    return m.select("event_id", TX.log_level(_log_line(F.col("event_id"), F.col("task_id"), F.col("payload")))
                    .alias("level"))


INSTRUCT = "Given a news article, retrieve related news articles"


@register("prompt_render", f"""
SELECT conv_id, turn,
       CASE WHEN role = 'user' THEN 'Instruct: ' || {_sql_str(INSTRUCT)} || chr(10) || 'Query: ' || text
            ELSE 'passage: ' || text END AS prompt
FROM conversations
""")
def prompt_render(spark, sf_dir):
    """2.9.14: query turns rendered with the instruct template; others with a passage prefix."""
    c = A.chat(spark, sf_dir)
    return c.select("conv_id", "turn", F.when(
        F.col("role") == "user", TX.instruct_query(F.lit(INSTRUCT), F.col("text"))
    ).otherwise(TX.prefixed(F.lit("passage: "), F.col("text"))).alias("prompt"))


@register("message_flatten", """
SELECT conv_id, turn, part_no, role AS ollama_role,
       CASE WHEN role = 'user' THEN 'user' WHEN role IN ('system', 'assistant') THEN 'model' END AS gemini_role,
       CASE WHEN role IN ('assistant', 'system') THEN 'system' ELSE 'user' END AS openai_role,
       part
FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS part,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part_no
      FROM conversations)
""")
def message_flatten(spark, sf_dir):
    """2.9.16: one row per content part (line) with each provider's role mapping."""
    c = A.chat(spark, sf_dir)
    parts = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("part_no", "part"))
    r = F.col("role")
    return parts.select(
        "conv_id", "turn", "part_no", r.alias("ollama_role"),
        F.when(r == "user", "user").when(r.isin("system", "assistant"), "model").alias("gemini_role"),
        F.when(r.isin("assistant", "system"), "system").otherwise("user").alias("openai_role"),
        "part")


# ---------------------------------------------------------------- 2.2 validation

# Enum domains.
ROLES = ["system", "user", "assistant"]
MODEL_TYPES = ["generate", "embedding"]


@register("enum_validation", """
SELECT 'party' AS field, party AS value, party IN ('none', 'KMT', 'DPP', 'TPP') AS valid, count(*) AS n
FROM articles GROUP BY party
UNION ALL
SELECT 'task_status', subject, subject IN ('pending', 'processing', 'done', 'failed'), count(*)
FROM messages GROUP BY subject
UNION ALL
SELECT 'role', role, role IN ('system', 'user', 'assistant'), count(*) FROM conversations GROUP BY role
UNION ALL
SELECT 'source_type', v, v IN ('url', 'text'), count(*) FROM (
  SELECT CASE user_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'text' ELSE 'file' END AS v FROM events) GROUP BY v
UNION ALL
SELECT 'embed_type', v, v IN ('query', 'passage'), count(*) FROM (
  SELECT CASE label % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'passage' ELSE 'title' END AS v FROM embeddings) GROUP BY v
UNION ALL
SELECT 'log_level', v, v IN ('Debug', 'Info', 'Warn', 'Error', 'Fatal', 'Panic', 'Trace'), count(*) FROM (
  SELECT ['Debug', 'Info', 'Warn', 'Error', 'Fatal', 'Panic', 'Trace', 'info'][1 + event_id % 8] AS v FROM events) GROUP BY v
UNION ALL
SELECT 'model_type', v, v IN ('generate', 'embedding'), count(*) FROM (
  SELECT CASE label % 4 WHEN 0 THEN 'embedding' WHEN 1 THEN 'generate' WHEN 2 THEN 'rerank' END AS v FROM embeddings) GROUP BY v
""", views=("articles", "messages"))
def enum_validation(spark, sf_dir):
    """2.2.10: enum membership report (field, value, valid, n) of all seven enums; the tables lack four of them,
    so their values, some invalid, are dealt by ids."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id")
    em = table(spark, sf_dir, "embeddings").select("label")
    def rep(df, col, field, domain):
        return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).select(
            F.lit(field).alias("field"), "value", F.col("value").isin(domain).alias("valid"), "n")
    return (rep(A.articles(spark, sf_dir), "party", "party", A.PARTIES)
            .unionByName(rep(A.messages(spark, sf_dir), "subject", "task_status", A.TASK_STATUSES))
            .unionByName(rep(A.chat(spark, sf_dir), "role", "role", ROLES))
            .unionByName(rep(ev.select(_dealt("user_id", ["url", "text", "file"]).alias("v")), "v", "source_type", A.SOURCE_TYPES))
            .unionByName(rep(em.select(_dealt("label", ["query", "passage", "title"]).alias("v")), "v", "embed_type", EMBED_TYPES))
            .unionByName(rep(ev.select(_dealt("event_id", [*LOG_LEVELS, "info"]).alias("v")), "v", "log_level", LOG_LEVELS))
            .unionByName(rep(em.select(_dealt("label", ["embedding", "generate", "rerank", None]).alias("v")), "v",
                             "model_type", MODEL_TYPES)))


def _dealt(column, values):
    """A value by the remainder of an integer column (fixture rule)."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(column) % len(values) + 1).cast("int"))


# Submission host and per-site crawl filters.
ALLOWED_HOST = "tw.news.yahoo.com"
CRAWL_FILTERS = [
    r"^https://www\.dpp\.org\.tw/(?:media|anti_rumor)",
    r"^https://www\.kmt\.org\.tw/search/label/%E6%96%B0%E8%81%9E%E7%A8%BF",
    r"^https://www\.kmt\.org\.tw/\d{4}/\d{2}/.*\.html",
    r"^https://www\.tpp\.org\.tw/newsdetail/\d{4}$",
    r"^https://www\.tpp\.org\.tw/news.*",
]
SOCIAL_HOSTS = ["www.facebook.com", "www.youtube.com", "www.instagram.com", "x.com"]

_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)"
_WELL_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+[^\s]*$"


@register("url_allowlist", f"""
SELECT page_id, regexp_extract(url, {_sql_str(_HOST_RE)}, 1) AS host,
       regexp_matches(url, {_sql_str(_WELL_RE)}) AS well_formed,
       regexp_extract(url, {_sql_str(_HOST_RE)}, 1) = {_sql_str(ALLOWED_HOST)} AS allowed,
       ({' OR '.join(f"regexp_matches(url, {_sql_str(p)})" for p in CRAWL_FILTERS)}) AS crawl_match,
       ({' OR '.join(f"contains(url, {_sql_str(h)})" for h in SOCIAL_HOSTS)}) AS social
FROM pages
""")
def url_allowlist(spark, sf_dir):
    """2.2.11: URL checks: well formed, allowed host, crawl filters, social links."""
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    crawl = None
    for pat in CRAWL_FILTERS:
        c = u.rlike(pat)
        crawl = c if crawl is None else (crawl | c)
    social = None
    for h in SOCIAL_HOSTS:
        c = u.contains(h)
        social = c if social is None else (social | c)
    return p.select("page_id", TX.url_host(u).alias("host"), TX.url_well_formed(u).alias("well_formed"),
                    (TX.url_host(u) == ALLOWED_HOST).alias("allowed"), crawl.alias("crawl_match"),
                    social.alias("social"))


@register("length_bounds", """
SELECT doc_id, length(text) AS n,
       CASE WHEN length(text) BETWEEN 10 AND 3000 THEN 'OK' ELSE 'ERR_CONTENT_LENGTH' END AS status
FROM documents
""")
def length_bounds(spark, sf_dir):
    """2.2.12: submitted text length must be within [10, 3000]."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text")
    return d.select("doc_id", n.alias("n"),
                    F.when(n.between(10, 3000), "OK").otherwise("ERR_CONTENT_LENGTH").alias("status"))


@register("uuid_validation", """
SELECT event_id, u AS task_uuid,
       regexp_matches(u, '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS valid
FROM (SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
             substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u
      FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events))
""")
def uuid_validation(spark, sf_dir):
    """2.2.13: task ids must be version-4 UUIDs (ids as submitted: md5-shaped, any version)."""
    e = table(spark, sf_dir, "events")
    h = F.md5(F.col("event_id").cast("string"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                    F.substring(h, 17, 4), F.substring(h, 21, 12))
    return e.select("event_id", u.alias("task_uuid"), TX.is_uuid_v4(u).alias("valid"))
