"""DuckDB twins of ``inkstone.sources.adapters`` used by the SQL oracle.

Each oracle query is ``WITH <views> <body>``; only the raw fixture tables are
registered in the oracle, so the canonical views are spelled out here.
"""

from __future__ import annotations

VIEWS = {
    "articles": r"""
articles AS (
  SELECT id, title, url, source, party, paragraphs,
         array_to_string(paragraphs, '') AS content,
         list_transform(generate_series(1, len(paragraphs)),
                        lambda i: CAST(strlen(array_to_string(paragraphs[1:i], '')) AS BIGINT)) AS cuts,
         to_base64(unhex(md5(title || url || strftime(published_at, '%Y-%m-%d')))) AS md5,
         published_at, lang, text
  FROM (
    SELECT doc_id AS id,
           trim(split_part(text, chr(10), 1)) AS title,
           'https://' || source || '.example.com/article/' || CAST(doc_id % 97 AS VARCHAR) AS url,
           source,
           ['none', 'KMT', 'DPP', 'TPP'][CAST(doc_id % 4 AS BIGINT) + 1] AS party,
           list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS paragraphs,
           lang,
           TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published_at,
           text
    FROM documents
  )
)""",
    "vecs": r"""
vecs AS (
  SELECT vec_id AS id, CAST(vec_id // 5 AS BIGINT) AS article_id, vec_id AS chunk_id,
         CAST(label % 2 AS BIGINT) AS model_id, embedding AS vector
  FROM embeddings
)""",
    "models": r"""
models AS (
  SELECT id, 'model-' || CAST(id AS VARCHAR) AS name,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(id) AS created_at
  FROM (SELECT DISTINCT CAST(label % 2 AS BIGINT) AS id FROM embeddings)
)""",
    "press": r"""
press AS (SELECT item_id AS id, text AS content FROM benchmark)""",
    "messages": r"""
messages AS (
  SELECT event_id, user_id AS task_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing'
              WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'log' END AS subject,
         ts AS event_at, props AS payload, value, event_type
  FROM events
)""",
    "raw_pages": r"""
raw_pages AS (SELECT page_id AS id, url, html FROM pages)""",
}


def with_views(body: str, *names: str) -> str:
    body = body.strip()
    if not names:
        # a body that opens with its own CTEs (", x AS (...)") still needs WITH
        return "WITH " + body[1:].lstrip() if body.startswith(",") else body
    return "WITH " + ",\n".join(VIEWS[n].strip() for n in names) + "\n" + body
