"""Registered keyword-analytics queries (2.3.5, 2.4.3, 2.9.22-2.9.28, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import vectors as V
from inkstone.operators import keywords as KW
from inkstone.operators import knn as K
from inkstone.operators import tables as TB
from inkstone.operators import vector_agg as VA
from inkstone.plans.registry import register
from inkstone.session import checkpoint_dir
from inkstone.sources import adapters as A
from inkstone.sources.tables import table

TOP = 5

# ---------------------------------------------------------------- shared pieces


def terms(spark, sf_dir):
    """Top-5 terms per article, materialised once (reliable checkpoint).

    The table is small (<= 5 rows per article) and is read by several
    actions of the same query (broadcast blocks, id numbering, the main
    job); without the checkpoint each action would re-tokenise the corpus.
    """
    from inkstone.session import checkpoint_dir
    checkpoint_dir(spark)
    return KW.topk_terms(A.articles(spark, sf_dir), "id", "text", TOP).checkpoint(eager=True)


def themes_by_doc(spark, sf_dir):
    """(doc_id, themes array<string> in rank order)."""
    t = terms(spark, sf_dir)
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_r"))
    return g.select("doc_id", F.transform("_r", lambda x: x["term"]).alias("themes"))


def keyword_docs(spark, sf_dir):
    """(doc_id, title, kw struct) for every article."""
    a = A.articles(spark, sf_dir).select(F.col("id").alias("doc_id"), "title", "text")
    th = themes_by_doc(spark, sf_dir)
    j = a.join(th, "doc_id", "left")
    themes = F.coalesce(F.col("themes"), F.array().cast("array<string>"))
    return j.select("doc_id", "title", themes.alias("themes"),
                    KW.keyword_struct(themes, KW.capitalised(F.col("text"))).alias("kw"))


_TERMS_SQL = r"""
, toks AS (SELECT id AS doc_id, unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}]{2,}')) AS term FROM articles)
, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term)
, dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
, scored AS (SELECT doc_id, term, tf, df, tf * ln((SELECT count(*) FROM articles) / df) AS score
             FROM tf JOIN dfs USING (term))
, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored)
, top AS (SELECT * FROM ranked WHERE rank <= 5)
, themes AS (SELECT a.id AS doc_id, coalesce(list(t.term ORDER BY t.rank) FILTER (WHERE t.term IS NOT NULL), [])
                    AS themes
             FROM articles a LEFT JOIN top t ON t.doc_id = a.id GROUP BY a.id)
, ent_raw AS (SELECT id AS doc_id, unnest(e) AS ent, generate_subscripts(e, 1) AS pos
              FROM (SELECT id, regexp_extract_all(text, '\p{Lu}\p{Ll}{2,}') AS e FROM articles))
, ents AS (SELECT a.id AS doc_id,
                  coalesce(list(ent ORDER BY first_pos) FILTER (WHERE ent IS NOT NULL), []) AS entities
           FROM articles a LEFT JOIN (SELECT doc_id, ent, min(pos) AS first_pos FROM ent_raw GROUP BY doc_id, ent) e
             ON e.doc_id = a.id
           GROUP BY a.id)
, kw AS (SELECT t.doc_id, t.themes, e.entities[1:5] AS ents, e.entities AS all_ents FROM themes t JOIN ents e USING (doc_id))
"""


# ---------------------------------------------------------------- 2.11.1

@register("keyword_topk", _TERMS_SQL + """
SELECT doc_id, rank, term, tf, df, round(score, 6) AS score FROM top
""", views=("articles",))
def keyword_topk(spark, sf_dir):
    """2.11.1: five tf-idf keywords per article (deterministic stand-in for the model)."""
    top = KW.topk_terms(A.articles(spark, sf_dir), "id", "text", TOP)  # read once: no checkpoint
    return top.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- 2.9.22 / 2.9.23 / 2.4.3

@register("flatten_keywords", _TERMS_SQL + """
SELECT doc_id,
       array_to_string(list_concat(list_transform(themes, lambda x: 'theme:' || x),
                                   list_transform(ents, lambda x: 'entity:' || x)), '|') AS flat
FROM kw
""", views=("articles",))
def flatten_keywords(spark, sf_dir):
    """2.9.22: prefixed, category-ordered keyword list."""
    d = keyword_docs(spark, sf_dir)
    return d.select("doc_id", F.array_join(KW.flatten(F.col("kw")), "|").alias("flat"))


@register("relations", _TERMS_SQL + """
SELECT doc_id, i - 1 AS pos, all_ents[i] AS entity1, 'co_occurs' AS relation, all_ents[i + 1] AS entity2
FROM (SELECT doc_id, all_ents, unnest(generate_series(1, len(all_ents) - 1)) AS i FROM kw WHERE len(all_ents) > 1)
""", views=("articles",))
def relations(spark, sf_dir):
    """2.9.23: relation triples as edge rows; they come from a text's own words, so themes are not worked out."""
    a = A.articles(spark, sf_dir)
    kw = KW.keyword_struct(F.array().cast("array<string>"), KW.capitalised(F.col("text")))
    return KW.relations(a.select(F.col("id").alias("doc_id"), kw.alias("kw")), "kw", "doc_id")


@register("keyword_counts", _TERMS_SQL + """
SELECT doc_id, len(themes) + len(ents) AS n_keywords, greatest(len(all_ents) - 1, 0) AS n_relations FROM kw
""", views=("articles",))
def keyword_counts(spark, sf_dir):
    """2.4.3: number of flattened keywords and of relations per article."""
    d = keyword_docs(spark, sf_dir)
    return d.select("doc_id", F.size(KW.flatten(F.col("kw"))).alias("n_keywords"),
                    F.size(F.col("kw")["relations"]).alias("n_relations"))


# ---------------------------------------------------------------- 2.9.24 - 2.9.28

def _extract_json(s):
    start = F.instr(s, "{")
    last = F.length(s) - F.instr(F.reverse(s), "}") + 1
    err = (F.when(start == 0, "could not find opening brace")
           .when(F.instr(s, "}") == 0, "could not find closing brace")
           .when(last < start, "closing brace before opening brace"))
    return F.when(err.isNull(), F.substring(s, start, last - start + 1)), err


@register("extract_json", _TERMS_SQL + r"""
SELECT 'doc' AS source, doc_id AS id, CAST(NULL AS VARCHAR) AS error, len(themes) AS n_themes FROM kw
UNION ALL
SELECT 'chat', conv_id * 1000 + turn,
       CASE WHEN strpos(text, '{') = 0 THEN 'could not find opening brace'
            WHEN strpos(text, '}') = 0 THEN 'could not find closing brace'
            WHEN length(text) - strpos(reverse(text), '}') + 1 < strpos(text, '{')
              THEN 'closing brace before opening brace' END,
       NULL
FROM conversations
""", views=("articles",))
def extract_json(spark, sf_dir):
    """2.9.24: first '{' to last '}' of model replies, parsed with the output schema.

    Replies: the keyword JSON wrapped in prose for every article, and the
    chat turns (which carry no JSON and become error rows).
    """
    d = keyword_docs(spark, sf_dir).select(
        F.lit("doc").alias("source"), F.col("doc_id").alias("id"),
        F.concat(F.lit("Here is the JSON:\n"), F.to_json("kw"), F.lit("\nDone.")).alias("reply"))
    c = A.chat(spark, sf_dir).select(F.lit("chat").alias("source"),
                                     (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                     F.col("text").alias("reply"))
    u = d.unionByName(c)
    js, err = _extract_json(F.col("reply"))
    parsed = F.from_json(js, KW.KEYWORDS_SCHEMA)
    return u.select("source", "id", err.alias("error"),
                    F.when(err.isNull(), F.size(parsed["keywords"]["themes"])).alias("n_themes"))


@register("jsonld_fields", _TERMS_SQL + """
SELECT a.id AS doc_id, a.title AS description, array_to_string(k.themes, '|') AS keywords,
       a.published_at AS date_published
FROM articles a JOIN kw k ON k.doc_id = a.id
""", views=("articles",))
def jsonld_fields(spark, sf_dir):
    """2.9.25: JSON-LD description, keywords (comma string or array) and date.

    Each article is rendered as JSON-LD (KMT/DPP articles carry keywords as a
    comma string, the others as an array) and read back.
    """
    a = A.articles(spark, sf_dir).select(F.col("id").alias("doc_id"), "title", "party", "published_at")
    j = a.join(themes_by_doc(spark, sf_dir), "doc_id", "left")
    themes = F.coalesce(F.col("themes"), F.array().cast("array<string>"))
    as_csv = F.col("party").isin("KMT", "DPP")
    date_s = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ld = F.when(as_csv, F.to_json(F.struct(F.col("title").alias("description"),
                                           F.array_join(themes, ",").alias("keywords"),
                                           date_s.alias("datePublished")))) \
        .otherwise(F.to_json(F.struct(F.col("title").alias("description"), themes.alias("keywords"),
                                      date_s.alias("datePublished"))))
    doc = j.select("doc_id", ld.alias("ld"))
    kw_arr = F.from_json(F.get_json_object("ld", "$.keywords"), "array<string>")
    kw_str = F.get_json_object("ld", "$.keywords")
    keywords = F.when(F.substring(F.trim(kw_str), 1, 1) == "[", kw_arr).otherwise(
        F.when(kw_str == "", F.array().cast("array<string>")).otherwise(F.split(kw_str, ",")))
    from inkstone.functions import dates as D
    return doc.select("doc_id", F.get_json_object("ld", "$.description").alias("description"),
                      F.array_join(keywords, "|").alias("keywords"),
                      D.rfc3339(F.get_json_object("ld", "$.datePublished")).alias("date_published"))


@register("distinct_keywords", _TERMS_SQL + """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(themes, list_transform(themes, lambda x: ' ' || x)))), '|')
       AS keywords
FROM kw
""", views=("articles",))
def distinct_keywords(spark, sf_dir):
    """2.9.26: comma-separated keywords (with duplicates and untrimmed variants) -> sorted distinct."""
    th = themes_by_doc(spark, sf_dir)
    a = A.articles(spark, sf_dir).select(F.col("id").alias("doc_id")).join(th, "doc_id", "left")
    themes = F.coalesce(F.col("themes"), F.array().cast("array<string>"))
    csv = F.concat_ws(",", F.array_join(themes, ","), F.array_join(F.transform(themes, lambda x: F.concat(F.lit(" "), x)), ","))
    out = F.when(F.size(themes) == 0, F.array().cast("array<string>")).otherwise(KW.distinct_keywords(csv))
    return a.select("doc_id", F.array_join(out, "|").alias("keywords"))


@register("relevance_band", _TERMS_SQL + r"""
, sc AS (
  SELECT k.doc_id,
         CASE WHEN len(k.themes) = 0 THEN NULL ELSE
           len(list_filter(k.themes, lambda t: list_contains(regexp_extract_all(lower(a.title), '\p{L}[\p{L}\p{N}]{2,}'), t)))
           / len(k.themes) END AS score
  FROM kw k JOIN articles a ON a.id = k.doc_id)
SELECT doc_id, round(score, 4) AS score,
       CASE WHEN score IS NULL OR score < 0 OR score > 1 THEN NULL
            WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'moderate'
            WHEN score >= 0.3 THEN 'limited' ELSE 'irrelevant' END AS band,
       score >= 0.5 AS relevant
FROM sc
""", views=("articles",))
def relevance_band(spark, sf_dir):
    """2.9.28: relevance score bands; score = share of an article's keywords found in its title."""
    a = A.articles(spark, sf_dir).select(F.col("id").alias("doc_id"), "title")
    j = a.join(themes_by_doc(spark, sf_dir), "doc_id", "left")
    themes = F.coalesce(F.col("themes"), F.array().cast("array<string>"))
    from inkstone.functions.bind import let
    hit = let(KW.tokens(F.col("title")),
              lambda toks: F.size(F.filter(themes, lambda t: F.array_contains(toks, t))))
    score = F.when(F.size(themes) == 0, F.lit(None)).otherwise(hit / F.size(themes))
    return j.select("doc_id", F.round(score, 4).alias("score"), KW.relevance_band(score).alias("band"),
                    (score >= 0.5).alias("relevant"))


# ---------------------------------------------------------------- 2.11.3 / 2.3.5

def keyword_tables(spark, sf_dir):
    """(existing keywords, inserted keywords, bridge rows)."""
    t = terms(spark, sf_dir).filter(F.length("term") <= KW.MAX_TERM_LEN)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id")).distinct()
    existing = TB.sequential_ids(t.join(lab, "doc_id", "left_semi").select("term").distinct(), ["term"])
    inserted = TB.insert_returning_ids(t.select("term"), existing, ["term"], ["term"])
    allk = existing.unionByName(inserted)
    bridge = t.select(F.col("doc_id").alias("article_id"), "term").distinct().join(allk, "term") \
        .select("article_id", F.col("id").alias("keyword_id"))
    return existing, inserted, allk, bridge


_KWSTORE_SQL = _TERMS_SQL + """
, terms32 AS (SELECT doc_id, term FROM top WHERE length(term) <= 32)
, existing AS (SELECT row_number() OVER (ORDER BY term) AS id, term FROM (
    SELECT DISTINCT term FROM terms32 WHERE doc_id IN (SELECT doc_id FROM labels)))
, inserted AS (SELECT (SELECT coalesce(max(id), 0) FROM existing) + row_number() OVER (ORDER BY term) AS id, term
               FROM (SELECT DISTINCT term FROM terms32 WHERE term NOT IN (SELECT term FROM existing)))
, allk AS (SELECT * FROM existing UNION ALL SELECT * FROM inserted)
, bridge AS (SELECT DISTINCT t.doc_id AS article_id, k.id AS keyword_id FROM terms32 t JOIN allk k USING (term))
"""


@register("keyword_store", _KWSTORE_SQL + "SELECT id, term FROM inserted", views=("articles",))
def keyword_store(spark, sf_dir):
    """2.11.3: insert absent terms (<= 32 chars) after the labelled articles' terms."""
    return keyword_tables(spark, sf_dir)[1].select("id", "term")


@register("keyword_rejects", _TERMS_SQL + """
SELECT term, length(term) AS term_length, count(*) AS n_articles, min(doc_id) AS first_article FROM top
WHERE length(term) > 32 GROUP BY term
""", views=("articles",))
def keyword_rejects(spark, sf_dir):
    """2.11.3: terms that the keyword column (32 characters) refuses, as reject rows (never dropped silently)."""
    t = terms(spark, sf_dir)
    return t.filter(F.length("term") > KW.MAX_TERM_LEN).groupBy("term").agg(
        F.first(F.length("term")).alias("term_length"), F.count("*").alias("n_articles"), F.min("doc_id").alias("first_article"))


@register("keyword_articles", _KWSTORE_SQL + """
SELECT k.id AS keyword_id, k.term, a.id AS article_id, a.title
FROM articles a JOIN bridge b ON b.article_id = a.id JOIN allk k ON k.id = b.keyword_id
""", views=("articles",))
def keyword_articles(spark, sf_dir):
    """2.3.5: articles by keyword through the bridge table (keyword side is the small one)."""
    _, _, allk, bridge = keyword_tables(spark, sf_dir)
    a = A.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "title")
    return (a.join(bridge, "article_id").join(allk.withColumnRenamed("id", "keyword_id"), "keyword_id")
            .select("keyword_id", "term", "article_id", "title"))


# ---------------------------------------------------------------- 2.11.2 / 2.11.6 / 2.11.7

def _kw_sets(spark, sf_dir):
    """(id, terms) of every article, written once: the overlap join reads the sets from several sides."""
    checkpoint_dir(spark)
    th = themes_by_doc(spark, sf_dir)
    return th.select(F.col("doc_id").alias("id"), F.col("themes").alias("terms")).checkpoint()


_OVERLAP_SQL = """
, pairs AS (
  SELECT a.doc_id AS query_id, b.doc_id AS id, count(*) AS shared
  FROM top a JOIN top b ON a.term = b.term AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id)
, sizes AS (SELECT doc_id, count(*) AS n FROM top GROUP BY doc_id)
, ov AS (
  SELECT p.query_id, p.id, p.shared, p.shared / (sa.n + sb.n - p.shared) AS jaccard
  FROM pairs p JOIN sizes sa ON sa.doc_id = p.query_id JOIN sizes sb ON sb.doc_id = p.id)
, ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, shared DESC, id) AS rank FROM ov)
"""


@register("related_by_keyword", _TERMS_SQL + _OVERLAP_SQL + """
SELECT query_id, rank, id, shared, round(jaccard, 6) AS jaccard FROM ovr WHERE rank <= 5
""", views=("articles",))
def related_by_keyword(spark, sf_dir):
    """2.11.2: other articles ranked by shared keywords (Jaccard, then count, then id)."""
    s = _kw_sets(spark, sf_dir)
    r = KW.overlap_topk(s.withColumnRenamed("id", "query_id"), s, k=5)
    return r.select("query_id", "rank", "id", "shared", F.round("jaccard", 6).alias("jaccard"))


HYBRID_K = 10
W_VEC, W_KW = 0.5, 0.5


def _article_vectors(spark, sf_dir):
    """One mean vector per article and model."""
    return VA.mean_by(A.vectors(spark, sf_dir), ["article_id", "model_id"], out_col="vector").drop("n")


@register("hybrid_related", _TERMS_SQL + _OVERLAP_SQL + """
, av AS (
  SELECT article_id, model_id, list(m ORDER BY pos) AS v FROM (
    SELECT article_id, model_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT article_id, model_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos
      FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
    GROUP BY article_id, model_id, pos)
  GROUP BY article_id, model_id)
, vd AS (SELECT q.model_id, q.article_id AS query_id, c.article_id AS id, list_cosine_distance(c.v, q.v) AS distance
         FROM av q JOIN av c ON q.article_id <> c.article_id AND q.model_id = c.model_id)
, vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY distance, id) AS r FROM vd)
         WHERE r <= 10)
, kr AS (SELECT av.model_id, o.query_id, o.id, o.jaccard FROM ovr o JOIN av ON av.article_id = o.query_id WHERE o.rank <= 10)
, h AS (
  SELECT coalesce(vr.model_id, kr.model_id) AS model_id, coalesce(vr.query_id, kr.query_id) AS query_id,
         coalesce(vr.id, kr.id) AS id, 0.5 * coalesce(1 - vr.distance, 0) + 0.5 * coalesce(kr.jaccard, 0) AS score
  FROM vr FULL OUTER JOIN kr ON vr.model_id = kr.model_id AND vr.query_id = kr.query_id AND vr.id = kr.id)
SELECT model_id, query_id, rank, id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY score DESC, id) AS rank FROM h)
WHERE rank <= 5
""", views=("articles", "vecs"))
def hybrid_related(spark, sf_dir):
    """2.11.6: fuse vector (cosine) and keyword (Jaccard) candidate lists, top 5 per article and model."""
    av = _article_vectors(spark, sf_dir)
    q = av.select(F.col("article_id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    corpus = av.select(F.col("article_id").alias("id"), "article_id", "model_id", "vector")
    vr = K.knn_join(q, corpus, HYBRID_K, "cosine", exclude_self=True, keep=["model_id"]).select(
        "model_id", "query_id", "id", "distance")
    s = _kw_sets(spark, sf_dir)
    asked = av.select("model_id", F.col("article_id").alias("query_id"))
    qk = s.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi").withColumnRenamed("id", "query_id")
    kr = KW.overlap_topk(qk, s, k=HYBRID_K).join(asked, "query_id").select("model_id", "query_id", "id", "jaccard")
    h = vr.join(kr, ["model_id", "query_id", "id"], "full_outer").select(
        "model_id", "query_id", "id",
        (F.lit(W_VEC) * F.coalesce(1 - F.col("distance"), F.lit(0.0))
         + F.lit(W_KW) * F.coalesce(F.col("jaccard"), F.lit(0.0))).alias("score"))
    from pyspark.sql import Window
    w = Window.partitionBy("model_id", "query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
            .select("model_id", "query_id", "rank", "id", F.round("score", 4).alias("score")))


@register("party_similarity", """
, av AS (
  SELECT article_id, model_id, list(m ORDER BY pos) AS v FROM (
    SELECT article_id, model_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT article_id, model_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos
      FROM vecs WHERE vector IS NOT NULL AND len(vector) > 0)
    GROUP BY article_id, model_id, pos)
  GROUP BY article_id, model_id)
, ap AS (SELECT av.article_id, av.model_id, av.v, a.party FROM av JOIN articles a ON a.id = av.article_id)
, pairs AS (
  SELECT n.article_id, n.model_id, r.party, 1 - list_cosine_distance(n.v, r.v) AS sim
  FROM ap n JOIN ap r ON r.party <> 'none' AND r.model_id = n.model_id WHERE n.party = 'none')
SELECT article_id, model_id, round(avg(sim) FILTER (WHERE party = 'KMT'), 4) + 0::DOUBLE AS KMT,
       round(avg(sim) FILTER (WHERE party = 'DPP'), 4) + 0::DOUBLE AS DPP,
       round(avg(sim) FILTER (WHERE party = 'TPP'), 4) + 0::DOUBLE AS TPP
FROM pairs GROUP BY article_id, model_id
""", views=("articles", "vecs"))
def party_similarity(spark, sf_dir):
    """2.11.7: mean cosine similarity of each news article to each party's releases, per model.

    mean_b cos(a, b) = unit(a) . mean_b unit(b), so each party needs one
    centroid of unit vectors (a partial aggregate) and each article one dot
    product per party: no article x release pairs are formed.
    """
    av = _article_vectors(spark, sf_dir)
    arts = A.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "party")
    unit = av.join(arts, "article_id").select(
        "article_id", "model_id", "party",
        V.unit(F.col("vector")).alias("u"))
    releases = unit.filter(F.col("party") != "none")
    cents = VA.mean_by(releases, ["model_id", "party"], vec_col="u", out_col="c").drop("n")
    news = unit.filter(F.col("party") == "none").drop("party")
    sims = news.join(cents, "model_id").select(
        "article_id", "model_id", "party", V.dot(F.col("u"), F.col("c")).alias("sim"))
    p = sims.groupBy("article_id", "model_id").pivot("party", ["KMT", "DPP", "TPP"]).agg(F.first("sim"))
    return p.select("article_id", "model_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ["KMT", "DPP", "TPP"]])
