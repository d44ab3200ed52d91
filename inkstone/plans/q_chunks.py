"""Registered chunking / paragraph-offset queries (sections 2.5, 2.6, 2.3.1, 2.9.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import chunking as C
from inkstone.plans.registry import register
from inkstone.sources import adapters as A

SIZE, OVERLAP = 256, 32  # reference fixture loader settings

# DuckDB: paragraphs exploded with 1-based index and exclusive running start.
_PARAS = """
, p AS (
  SELECT id AS article_id, pidx, para,
         CAST(coalesce(sum(length(para)) OVER (PARTITION BY id ORDER BY pidx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
         lag(para) OVER (PARTITION BY id ORDER BY pidx) AS prev,
         lead(para) OVER (PARTITION BY id ORDER BY pidx) AS nxt
  FROM (SELECT id, unnest(paragraphs) AS para, generate_subscripts(paragraphs, 1) AS pidx FROM articles))
"""

_PARA_OFFSETS = _PARAS + """
, q AS (SELECT article_id, pidx, s, length(para) AS n, unnest(range(0, length(para), 224)) AS i FROM p)
, chunks AS (
  SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY pidx, i) - 1 AS chunk_no,
         s + greatest(0, i - 16) AS start, i - greatest(0, i - 16) AS offset_left,
         least(n, i + 224) - greatest(0, i - 16) AS offset_right, s + least(n, i + 240) AS "end"
  FROM q)
"""


def _chunks(spark, sf_dir):
    return C.paragraph_offsets(A.articles(spark, sf_dir), size=SIZE, overlap=OVERLAP)


@register("chunk_offsets", """
, q AS (SELECT id AS article_id, length(content) AS n, unnest(range(0, length(content), 224)) AS i FROM articles)
SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY i) - 1 AS chunk_no,
       greatest(0, i - 16) AS start, i - greatest(0, i - 16) AS offset_left,
       least(n, i + 224) - greatest(0, i - 16) AS offset_right, least(n, i + 240) AS "end"
FROM q
""", views=("articles",))
def chunk_offsets(spark, sf_dir):
    """2.6.1: offsets over the whole content (256/32)."""
    return C.offsets(A.articles(spark, sf_dir), size=SIZE, overlap=OVERLAP)


@register("chunk_paragraph_offsets", _PARA_OFFSETS + "SELECT * FROM chunks", views=("articles",))
def chunk_paragraph_offsets(spark, sf_dir):
    """2.6.2: offsets inside paragraphs, in article coordinates (256/32)."""
    return _chunks(spark, sf_dir)


@register("extract_chunks", _PARA_OFFSETS + """
SELECT c.article_id, c.chunk_no, substring(a.content, c.start + 1, c."end" - c.start) AS content
FROM articles a JOIN chunks c ON a.id = c.article_id
WHERE a.content IS NOT NULL
""", views=("articles",))
def extract_chunks(spark, sf_dir):
    """2.3.1: articles joined to chunks, chunk text by code-point substring."""
    p = C.parts(_chunks(spark, sf_dir), A.articles(spark, sf_dir))
    return p.select("article_id", "chunk_no", F.col("chunk").alias("content"))


@register("chunk_parts", _PARA_OFFSETS + """
SELECT c.article_id, c.chunk_no, c.start, c."end",
       substring(a.content, c.start + 1, c."end" - c.start) AS chunk,
       CASE WHEN c.offset_left > 0 THEN substring(a.content, c.start + 1, c.offset_left) ELSE '' END AS left_overlap,
       substring(a.content, c.start + c.offset_left + 1, c.offset_right - c.offset_left) AS "unique",
       CASE WHEN c.offset_right < c."end" - c.start
            THEN substring(a.content, c.start + c.offset_right + 1, c."end" - c.start - c.offset_right)
            ELSE '' END AS right_overlap
FROM articles a JOIN chunks c ON a.id = c.article_id
""", views=("articles",))
def chunk_parts(spark, sf_dir):
    """2.6.3: chunk, left overlap, unique part, right overlap (cut inside each paragraph)."""
    return C.paragraph_chunks(A.articles(spark, sf_dir), size=SIZE, overlap=OVERLAP).select(
        "article_id", "chunk_no", "start", "end", "chunk", "left_overlap", "unique", "right_overlap")


@register("chunk_text", """
, q AS (SELECT id AS article_id, content AS t, length(content) AS n,
               unnest(CASE WHEN length(content) > 0 THEN range(0, length(content), 224) ELSE [0] END) AS lhs
        FROM articles)
SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY lhs) - 1 AS chunk_no,
       substring(t, greatest(lhs - 16, 0) + 1, lhs - greatest(lhs - 16, 0)) AS "left",
       substring(t, lhs + 1, least(lhs + 224, n) - lhs) AS body,
       substring(t, least(lhs + 224, n) + 1, least(least(lhs + 224, n) + 16, n) - least(lhs + 224, n)) AS "right"
FROM q
""", views=("articles",))
def chunk_text(spark, sf_dir):
    """2.6.4: direct (left, body, right) triples over the whole content."""
    return C.text_triples(A.articles(spark, sf_dir), size=SIZE, overlap=OVERLAP)


@register("context_chunks", _PARAS + """
, t AS (
  SELECT article_id, pidx, para, prev, nxt, length(para) AS n,
         unnest(CASE WHEN length(para) <= 224 THEN [-1] ELSE range(0, length(para), 224) END) AS lhs
  FROM p WHERE length(para) > 0)
SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY pidx, lhs) - 1 AS chunk_no,
  CASE WHEN lhs = -1 OR (lhs = 0 AND pidx > 1) THEN coalesce("right"(prev, 16), '')
       ELSE substring(para, greatest(lhs - 16, 0) + 1, lhs - greatest(lhs - 16, 0)) END AS "left",
  CASE WHEN lhs = -1 THEN para ELSE substring(para, lhs + 1, least(lhs + 224, n) - lhs) END AS body,
  CASE WHEN lhs = -1 THEN coalesce("left"(nxt, 16), '')
       WHEN lhs + 224 >= n AND nxt IS NOT NULL THEN "left"(nxt, 16)
       ELSE substring(para, least(lhs + 224, n) + 1, least(least(lhs + 224, n) + 16, n) - least(lhs + 224, n))
  END AS "right"
FROM t
""", views=("articles",))
def context_chunks(spark, sf_dir):
    """2.5.3: per-paragraph triples with neighbour context (fixed left-context rule)."""
    return C.context_triples(A.articles(spark, sf_dir), size=SIZE, overlap=OVERLAP)


def _int_list(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@register("paragraph_cuts", """
SELECT id, len(paragraphs) AS n_paragraphs, array_to_string(cuts, ',') AS cuts FROM articles
""", views=("articles",))
def paragraph_cuts(spark, sf_dir):
    """2.5.1: running UTF-8 byte length after every paragraph."""
    a = A.articles(spark, sf_dir)
    return a.select("id", F.size("paragraphs").alias("n_paragraphs"), _int_list(C.byte_cuts(F.col("paragraphs"))).alias("cuts"))


@register("paragraph_starts", """
SELECT id, array_to_string(list_transform(generate_series(1, len(paragraphs)),
         lambda i: length(array_to_string(paragraphs[1:i - 1], ''))), ',') AS starts
FROM articles
""", views=("articles",))
def paragraph_starts(spark, sf_dir):
    """2.5.2: code-point start of every paragraph."""
    a = A.articles(spark, sf_dir)
    return a.select("id", _int_list(C.paragraph_starts(F.col("paragraphs"))).alias("starts"))


@register("join_split_paragraphs", """
SELECT id, CASE WHEN len(paragraphs) = 0 THEN 1 ELSE len(paragraphs) END AS n_pieces,
       len(paragraphs) > 0 AS roundtrip_ok, strlen(content) AS n_bytes
FROM articles
""", views=("articles",))
def join_split_paragraphs(spark, sf_dir):
    """2.9.3: join paragraphs with byte cuts, split back by the cuts, check identity."""
    a = A.articles(spark, sf_dir)
    pieces = C.split_by_cuts(F.col("content"), F.col("cuts"))
    return a.select("id", F.size(pieces).alias("n_pieces"),
                    (pieces == F.col("paragraphs")).alias("roundtrip_ok"),
                    F.octet_length("content").alias("n_bytes"))
