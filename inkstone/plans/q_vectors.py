"""Registered vector queries: k-NN (exact, batched, approximate) and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import vectors as V
from inkstone.operators import knn as K
from inkstone.operators import vector_agg as VA
from inkstone.plans.q_chunks import _PARA_OFFSETS as _PARA_OFFSETS_SQL
from inkstone.plans.registry import register
from inkstone.session import checkpoint_dir
from inkstone.sources import adapters as A

K_NN = 10
K_JOIN = 5


def _centroid_knn(spark, sf_dir, metric):
    """k nearest to each model's centroid: one query vector per model, looked up by model."""
    vecs = A.vectors(spark, sf_dir)
    cent = VA.mean_by(vecs, ["model_id"], out_col="query_vector").drop("n")
    r = K.knn_per_key(vecs, cent, K_NN, metric)
    return r.select("model_id", "rank", "id", "article_id", F.round("distance", 4).alias("distance"))


_CENTROID_SQL = """
, valid AS (SELECT * FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
, cent AS (
  SELECT model_id, list(m ORDER BY pos) AS qv FROM (
    SELECT model_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT model_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM valid)
    GROUP BY model_id, pos)
  GROUP BY model_id)
, d AS (
  SELECT v.model_id, v.id, v.article_id, {dist} AS distance
  FROM valid v JOIN cent c USING (model_id))
SELECT model_id, rank, id, article_id, round(distance, 4) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY distance, id) AS rank FROM d)
WHERE rank <= 10
"""


def _centroid_sql(dist):
    return "WITH " + _VECS + _CENTROID_SQL.format(dist=dist)


_VECS = """vecs AS (
  SELECT vec_id AS id, CAST(vec_id // 5 AS BIGINT) AS article_id, vec_id AS chunk_id,
         CAST(label % 2 AS BIGINT) AS model_id, embedding AS vector
  FROM embeddings)"""

_DV = "CAST(v.vector AS DOUBLE[])"


@register("knn_l2", _centroid_sql(f"list_distance({_DV}, c.qv)"))
def knn_l2(spark, sf_dir):
    """2.7.3: k nearest by L2 to each model's centroid."""
    return _centroid_knn(spark, sf_dir, "l2")


@register("knn_cosine", _centroid_sql(f"list_cosine_distance({_DV}, c.qv)"))
def knn_cosine(spark, sf_dir):
    """2.7.4: k nearest by cosine distance (the reference names it 'similarity')."""
    return _centroid_knn(spark, sf_dir, "cosine")


@register("knn_inner_product", _centroid_sql(f"list_negative_inner_product({_DV}, c.qv)"))
def knn_inner_product(spark, sf_dir):
    """2.7.5: k nearest by negative inner product."""
    return _centroid_knn(spark, sf_dir, "inner_product")


def knn_join_df(spark, sf_dir, k=K_JOIN, metric="cosine"):
    vecs = A.vectors(spark, sf_dir)
    queries = vecs.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    hits = K.knn_join(queries, vecs, k, metric, exclude_self=True)
    arts = A.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "title", "party")
    return (hits.join(arts, "article_id", "left")
            .select("query_id", "rank", "id", "article_id", F.round("distance", 4).alias("distance"),
                    "title", "party"))


@register("knn_join", """
, valid AS (SELECT * FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
, d AS (
  SELECT q.id AS query_id, v.id, v.article_id,
         list_cosine_distance(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) AS distance
  FROM valid q JOIN valid v ON q.model_id = v.model_id AND q.id <> v.id)
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT r.query_id, r.rank, r.id, r.article_id, round(r.distance, 4) AS distance, a.title, a.party
FROM r LEFT JOIN articles a ON a.id = r.article_id
WHERE r.rank <= 5
""", views=("vecs", "articles"))
def knn_join(spark, sf_dir):
    """2.3.6 (flagship): every vector's 5 nearest others (cosine), with article columns."""
    return knn_join_df(spark, sf_dir)


@register("avg_embedding_by_article", """
SELECT article_id, model_id, n,
       array_to_string(list_transform(avg_vector, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS avg_vector
FROM (
  SELECT article_id, model_id, max(n) AS n, list(m ORDER BY pos) AS avg_vector FROM (
    SELECT article_id, model_id, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM (
      SELECT article_id, model_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos
      FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
    GROUP BY article_id, model_id, pos)
  GROUP BY article_id, model_id)
""", views=("vecs",))
def avg_embedding_by_article(spark, sf_dir):
    """2.4.1: element-wise mean vector per (article, model)."""
    m = VA.mean_by(A.vectors(spark, sf_dir), ["article_id", "model_id"])
    return m.select("article_id", "model_id", "n", V.as_scaled_ints(F.col("avg_vector")).alias("avg_vector"))


@register("avg_embedding", """
, means AS (
  SELECT article_id, model_id, list(m ORDER BY pos) AS avg_vector FROM (
    SELECT article_id, model_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT article_id, model_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos
      FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
    GROUP BY article_id, model_id, pos)
  GROUP BY article_id, model_id)
SELECT r.article_id, r.model_id,
       array_to_string(list_transform(m.avg_vector, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS avg_vector
FROM (SELECT id AS article_id, CAST(id % 2 AS BIGINT) AS model_id FROM articles) r
LEFT JOIN means m USING (article_id, model_id)
""", views=("vecs", "articles"))
def avg_embedding(spark, sf_dir):
    """2.4.2: avg_embedding(aid, mid) per requested key; NULL when absent.

    Requests: every article asks for model ``id % 2``.
    """
    req = A.articles(spark, sf_dir).select(F.col("id").alias("article_id"),
                                           (F.col("id") % 2).cast("int").alias("model_id"))
    r = VA.avg_embedding(req, A.vectors(spark, sf_dir))
    return r.select("article_id", "model_id", V.as_scaled_ints(F.col("avg_vector")).alias("avg_vector"))


@register("avg_embedding_function", """
, means AS (
  SELECT article_id, model_id, list(m ORDER BY pos) AS avg_vector FROM (
    SELECT article_id, model_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT article_id, model_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos
      FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
    GROUP BY article_id, model_id, pos)
  GROUP BY article_id, model_id)
SELECT a.id AS article_id, CASE WHEN a.party = 'none' THEN 'public' ELSE 'parties' END AS scope,
       array_to_string(list_transform(m.avg_vector, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS avg_vector
FROM articles a LEFT JOIN means m ON m.article_id = a.id AND m.model_id = a.id % 2
""", views=("vecs", "articles"))
def avg_embedding_function(spark, sf_dir):
    """2.13: avg_embedding(aid, mid) as a SQL function in either scope: news articles and party releases
    have embeddings, and a function, of their own; every article asks the function of its scope for model ``id % 2``."""
    from inkstone.plans import sql as SQL
    arts = A.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "party")
    scoped = A.vectors(spark, sf_dir).join(arts, "article_id")
    SQL.register_avg_embedding(spark, scoped.filter(F.col("party") == "none"), "avg_embedding_public")
    SQL.register_avg_embedding(spark, scoped.filter(F.col("party") != "none"), "avg_embedding_parties")
    arts.createOrReplaceTempView("avg_embedding_requests")
    r = spark.sql("""
        SELECT article_id, 'public' AS scope, avg_embedding_public(article_id, CAST(article_id % 2 AS INT)) AS v
        FROM avg_embedding_requests WHERE party = 'none'
        UNION ALL
        SELECT article_id, 'parties', avg_embedding_parties(article_id, CAST(article_id % 2 AS INT))
        FROM avg_embedding_requests WHERE party <> 'none'""")
    return r.select("article_id", "scope", V.as_scaled_ints(F.col("v")).alias("avg_vector"))


@register("valid_vectors", """
SELECT id, article_id, model_id, len(vector) AS dim FROM vecs
WHERE vector IS NOT NULL AND len(vector) > 0 AND model_id = 1
""", views=("vecs",))
def valid_vectors(spark, sf_dir):
    """2.2.8: non-null, non-empty vectors of one model."""
    v = A.vectors(spark, sf_dir)
    return (v.filter(V.is_valid(F.col("vector")) & (F.col("model_id") == 1))
            .select("id", "article_id", "model_id", F.size("vector").alias("dim")))


DIM = 64


@register("dimension_check", """
SELECT id, CAST(coalesce(len(vector), -1) AS BIGINT) AS dim,
       CASE WHEN vector IS NOT NULL AND len(vector) = 64 THEN 'ok' ELSE 'rejected' END AS status
FROM vecs
""", views=("vecs",))
def dimension_check(spark, sf_dir):
    """2.2.9: split vectors into ok / rejected by dimension."""
    v = A.vectors(spark, sf_dir)
    return v.select("id", F.coalesce(F.size("vector"), F.lit(-1)).cast("int").alias("dim"),
                    F.when(V.dimension_ok(F.col("vector"), DIM), "ok").otherwise("rejected").alias("status"))


# ---------------------------------------------------------------- approximate / embedding jobs

@register("knn_approx", """
, valid AS (SELECT * FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
, n AS (SELECT model_id, count(*) AS n FROM valid GROUP BY model_id)
SELECT v.model_id, count(*) AS n_queries, CAST(sum(least(5, n.n - 1)) AS BIGINT) AS n_rows, true AS recall_ok, true AS share_ok,
       CAST(0 AS BIGINT) AS n_wrong_distance, CAST(0 AS BIGINT) AS n_foreign
FROM valid v JOIN n USING (model_id) GROUP BY v.model_id
""", views=("vecs",))
def knn_approx(spark, sf_dir):
    """2.7.6: lists with multi-probe and sign codes + exact distances, reported per model.

    The neighbours themselves depend on the fitted lists; what must hold for any is reported: every
    query has its full list, recall against the exact join is at least 0.9, at most a fifth of all pairs
    was scored (centres included), distances are exact, and no neighbour comes from another model.
    """
    vecs = A.vectors(spark, sf_dir)
    queries = vecs.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    found = K.knn_approx(queries, vecs, K_JOIN, "cosine", exclude_self=True)
    exact = K.knn_join(queries, vecs, K_JOIN, "cosine", exclude_self=True)
    truth = exact.select("query_id", "id", F.lit(1).alias("near"))
    side = vecs.select(F.col("id").alias("v_id"), F.col("model_id").alias("v_model"), F.col("vector").alias("v_vec"))
    r = found.join(truth, ["query_id", "id"], "full_outer")
    r = r.join(queries.withColumnRenamed("query_vector", "q_vec"), "query_id").join(
        side, F.col("id") == F.col("v_id"), "left")
    off = F.abs(V.cosine_distance(F.col("v_vec"), F.col("q_vec")) - F.col("distance")) > 1e-9
    hit = F.col("rank").isNotNull()
    return r.groupBy("model_id").agg(
        F.count_distinct("query_id").alias("n_queries"), F.count(F.when(hit, 1)).alias("n_rows"),
        (F.count(F.when(hit & F.col("near").isNotNull(), 1)) >= 0.9 * F.count("near")).alias("recall_ok"),
        (F.sum(F.when(F.col("rank") == 1, F.col("scored")))
         <= 0.2 * F.count_distinct("query_id") * F.count_distinct("query_id")).alias("share_ok"),
        F.count(F.when(hit & off, 1)).alias("n_wrong_distance"),
        F.count(F.when(hit & ~F.col("v_model").eqNullSafe(F.col("model_id")), 1)).alias("n_foreign"))


def _chunk_texts(spark, sf_dir):
    from inkstone.operators import chunking as C
    p = C.paragraph_chunks(A.articles(spark, sf_dir))
    return p.select("article_id", "chunk_no", "start", F.col("chunk").alias("text"))


_EMBED_SQL = r"""
, texts AS (
  SELECT c.article_id, c.chunk_no, c.start, substring(a.content, c.start + 1, c."end" - c.start) AS text
  FROM chunks c JOIN articles a ON a.id = c.article_id)
, idx AS (
  SELECT article_id, chunk_no, start,
         list_transform(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}]{2,}'),
                        lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64) AS ix
  FROM texts)
, cnt AS (
  SELECT article_id, chunk_no, start,
         list_transform(range(64), lambda j: CAST(len(list_filter(ix, lambda x: x = j)) AS DOUBLE)) AS c
  FROM idx)
, nrm AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM cnt)
, emb AS (
  SELECT article_id, chunk_no, start,
         CASE WHEN n > 0 THEN list_transform(c, lambda x: x / n) ELSE c END AS v
  FROM nrm)
"""


@register("embed_chunks", _PARA_OFFSETS_SQL + _EMBED_SQL + """
SELECT article_id, chunk_no, '' AS state,
       array_to_string(list_transform(v, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS vector
FROM emb
""", views=("articles",))
def embed_chunks(spark, sf_dir):
    """2.11.4: embed every chunk text (offline default: hashed bag of tokens, JVM-side)."""
    from inkstone.operators import embed as EM
    e = EM.embed_hashed(_chunk_texts(spark, sf_dir), "text", DIM)
    return e.select("article_id", "chunk_no", "state", V.as_scaled_ints(F.col("vector")).alias("vector"))


@register("article_pipeline", _PARA_OFFSETS_SQL + _EMBED_SQL + """
, ids AS (SELECT row_number() OVER (ORDER BY article_id, start) AS chunk_id, article_id, start FROM chunks)
, new_emb AS (SELECT i.article_id, i.chunk_id, 0 AS model_id FROM emb e JOIN ids i USING (article_id, start))
, ins AS (SELECT * FROM new_emb n WHERE NOT EXISTS (
            SELECT 1 FROM vecs v WHERE v.article_id = n.article_id AND v.chunk_id = n.chunk_id AND v.model_id = 0))
SELECT a.id AS article_id, count(DISTINCT i.chunk_id) AS n_chunks, count(DISTINCT s.chunk_id) AS n_inserted
FROM articles a JOIN ids i ON i.article_id = a.id LEFT JOIN ins s ON s.chunk_id = i.chunk_id
GROUP BY a.id
""", views=("articles", "vecs"))
def article_pipeline(spark, sf_dir):
    """2.11.5: paragraphs -> chunks (256/32) -> texts -> embeddings -> insert-if-absent.

    Returns per article the chunk count and the embeddings actually inserted
    (keys already present in the embeddings table are skipped).
    """
    from inkstone.operators import embed as EM
    from inkstone.operators import tables as TB
    from inkstone.operators import chunking as C
    arts = A.articles(spark, sf_dir)
    checkpoint_dir(spark)
    per_chunk = C.paragraph_offsets(arts).groupBy("article_id").agg(F.count("*").alias("n_chunks")).checkpoint()
    offsets = TB.key_offsets(per_chunk, "article_id", "n_chunks")  # ids without sorting any text
    chunks = C.paragraph_chunks(arts).join(offsets, "article_id").withColumn(
        "chunk_id", F.col("offset") + F.col("chunk_no") + 1)
    emb = EM.embed_hashed(chunks.select("article_id", "chunk_id", F.col("chunk").alias("text")), "text", DIM)
    new = emb.select("article_id", "chunk_id", F.lit(0).alias("model_id"), "vector")
    # the stored table is probed with numbers alone, so nothing is embedded twice
    keys = per_chunk.join(offsets, "article_id").select("article_id", F.lit(0).alias("model_id"), F.explode(
        F.sequence(F.col("offset") + 1, F.col("offset") + F.col("n_chunks"))).alias("chunk_id"))
    ins = TB.insert_if_absent(new, A.vectors(spark, sf_dir), ["article_id", "chunk_id", "model_id"], keys=keys)
    per_ins = ins.groupBy("article_id").agg(F.count("*").alias("n_inserted"))
    return (per_chunk.join(per_ins, "article_id", "left")
            .select("article_id", "n_chunks", F.coalesce("n_inserted", F.lit(0)).alias("n_inserted")))
