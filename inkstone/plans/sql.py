"""SQL surface: canonical views for ``spark.sql`` users.

``register(spark, sf_dir)`` exposes the raw tables and the canonical views
(articles, vecs, models, press, messages, raw_pages, chat, chunks,
avg_embedding) so the
operators' results can be queried with plain Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.operators import chunking as C
from inkstone.operators import vector_agg as VA
from inkstone.sources import adapters as A
from inkstone.sources.tables import register_all


# SQL-bodied functions: inlined by the analyzer, so they stay JVM-side.
FUNCTIONS = {
    "l2_distance": """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))""",
    "neg_inner_product": """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN -aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)""",
    "cosine_distance": """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) = 0
                    THEN double('NaN')
                    ELSE 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
                         / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))
               END""",
    "article_key": """(title STRING, url STRING, published TIMESTAMP_NTZ) RETURNS STRING
        RETURN base64(unhex(md5(concat(coalesce(title, ''), coalesce(url, ''), date_format(published, 'yyyy-MM-dd')))))""",
    "link_key": """(link STRING) RETURNS STRING RETURN md5(regexp_replace(link, '^https://', ''))""",
    # raw string: the SQL text itself carries the regex escapes (\\t, \\x00 ...)
    "normalize_text": r"""(s STRING) RETURNS STRING
        RETURN regexp_replace(regexp_replace(replace(s, char(160), ' '), '[\\t\\n\\f\\r ]+', ' '),
                              '[\\x00-\\x1F\\x7F-\\x9F\\x{3000} ]', '')""",
    "mask_secret": """(s STRING) RETURNS STRING
        RETURN CASE WHEN octet_length(s) <= 10 THEN repeat('●', octet_length(s))
                    ELSE concat(string(substring(binary(s), 1, 5)), repeat('●', least(octet_length(s) - 10, 10)),
                                string(substring(binary(s), octet_length(s) - 4, 5))) END""",
}


# Table functions, used with LATERAL: one row per chunk of a text.
TABLE_FUNCTIONS = {
    "chunk_offsets": """(body STRING, size INT, overlap INT)
        RETURNS TABLE(chunk_no INT, start INT, offset_left INT, offset_right INT, `end` INT)
        RETURN SELECT pos, c.s, c.i - c.s, least(c.n, c.i + c.u) - c.s, least(c.n, c.i + c.z - c.h)
               FROM (SELECT posexplode(CASE WHEN length(body) > 0 AND assert_true(size > 0 AND overlap > 1 AND overlap < size AND overlap % 2 = 0, 'bad chunk size or overlap') IS NULL
                                            THEN transform(sequence(0, length(body) - 1, size - overlap), x -> named_struct(
                                              'i', x, 's', greatest(0, x - overlap div 2), 'n', length(body), 'u', size - overlap,
                                              'z', size, 'h', overlap div 2)) END) AS (pos, c))""",
    "chunk_texts": """(body STRING, size INT, overlap INT)
        RETURNS TABLE(chunk_no INT, chunk STRING)
        RETURN SELECT o.chunk_no, substring(body, o.start + 1, o.`end` - o.start) FROM chunk_offsets(body, size, overlap) o""",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions for the pgvector operators, the key/text helpers and the chunker."""
    for name, body in {**FUNCTIONS, **TABLE_FUNCTIONS}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted([*FUNCTIONS, *TABLE_FUNCTIONS])


def register_avg_embedding(spark: SparkSession, embeddings: DataFrame, name: str = "avg_embedding") -> str:
    """``name(aid, mid)``: mean vector of an article under a model over ``embeddings`` (article_id, model_id, vector),
    NULL without rows.

    The means are the view ``<name>_means``; a call is a lookup in it, which the
    optimizer turns into a left join, however many rows call it.
    """
    VA.mean_by(embeddings, ["article_id", "model_id"]).createOrReplaceTempView(f"{name}_means")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(aid BIGINT, mid INT) RETURNS ARRAY<DOUBLE>
        RETURN (SELECT any_value(m.avg_vector) FROM {name}_means m WHERE m.article_id = aid AND m.model_id = mid)""")
    return name


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    register_all(spark, sf_dir)
    register_functions(spark)
    views = {
        "articles": A.articles(spark, sf_dir),
        "vecs": A.vectors(spark, sf_dir),
        "models": A.models(spark, sf_dir),
        "press": A.press(spark, sf_dir),
        "messages": A.messages(spark, sf_dir),
        "raw_pages": A.raw_pages(spark, sf_dir),
        "chat": A.chat(spark, sf_dir),
    }
    views["chunks"] = C.paragraph_offsets(views["articles"])
    register_avg_embedding(spark, views["vecs"])
    # the means as a relation, too
    views["avg_embedding"] = VA.mean_by(views["vecs"], ["article_id", "model_id"])
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
