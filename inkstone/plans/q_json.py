"""Registered batch-file and JSON queries (2.1.5-2.1.9, 2.4.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import text as TX
from inkstone.functions import vectors as V
from inkstone.operators import batchfiles as BF
from inkstone.operators import chunking as C
from inkstone.operators import tables as TB
from inkstone.operators.tables import sequential_ids
from inkstone.plans.q_chunks import _PARA_OFFSETS
from inkstone.plans.registry import register
from inkstone.sources import adapters as A
from inkstone.sources.tables import table

NOW = 1755706275  # job creation time (unix seconds), a parameter
JOB = "corpus-embed"
MODEL = "text-embedding-3-small"
PER_REQUEST = 10
DIM = 64
PASSAGE = "passage: "

_TRIM = f"'^[{TX.GO_SPACE}]+|[{TX.GO_SPACE}]+$'"


@register("paragraphs_from_text", f"""
SELECT doc_id, pos, para AS paragraph FROM (
  SELECT doc_id, unnest(p) AS para, generate_subscripts(p, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)),
                                             lambda x: regexp_replace(x, {_TRIM}, '', 'g')),
                               lambda x: length(x) > 0) AS p
    FROM documents))
""")
def paragraphs_from_text(spark, sf_dir):
    """2.1.5: split whole texts on blank lines, trim, drop empty paragraphs."""
    d = table(spark, sf_dir, "documents")
    paras = F.filter(F.transform(F.split("text", "\n\n"), TX.go_trim), lambda x: F.length(x) > 0)
    return d.select("doc_id", F.posexplode(paras).alias("pos", "paragraph"))


def _chunk_inputs(spark, sf_dir):
    """(seq, input) of every chunk and their number: article offsets plus the chunk's ordinal in its article."""
    arts = A.articles(spark, sf_dir)
    counts = C.paragraph_offsets(arts).groupBy("article_id").agg(F.count("*").alias("n"))
    offsets, total = TB.numbered_keys(counts, "article_id")
    parts = C.paragraph_chunks(arts).join(offsets, "article_id")
    inputs = parts.select((F.col("offset") + F.col("chunk_no") + 1).alias("seq"),
                          F.concat(F.lit(PASSAGE), F.col("chunk")).alias("input"))
    return inputs, total


@register("batch_requests", _PARA_OFFSETS + f"""
, inp AS (
  SELECT c.article_id, c.chunk_no, '{PASSAGE}' || substring(a.content, c.start + 1, c."end" - c.start) AS input
  FROM chunks c JOIN articles a ON a.id = c.article_id)
, num AS (SELECT (row_number() OVER (ORDER BY article_id, chunk_no) - 1) // {PER_REQUEST} AS request_no, input
          FROM inp)
, nreq AS (SELECT CAST(ceil(count(*) / {PER_REQUEST}) AS BIGINT) AS n FROM inp)
SELECT request_no,
       'embed-{NOW}-{JOB}-' || lpad(CAST(request_no AS VARCHAR), CAST(length(CAST((SELECT n FROM nreq) AS VARCHAR)) AS INTEGER), '0')
         AS custom_id,
       count(*) AS n_inputs, CAST(sum(length(input)) AS BIGINT) AS input_chars
FROM num GROUP BY request_no
""", views=("articles",))
def batch_requests(spark, sf_dir):
    """2.1.6: JSONL embedding requests, 10 chunk texts each, ``embed-now-job-NN`` ids."""
    inputs, n = _chunk_inputs(spark, sf_dir)
    req = BF.requests(inputs, "seq", "input", NOW, JOB, MODEL, n, PER_REQUEST)
    body = F.from_json(F.col("line"), "struct<body:struct<input:array<string>>>")
    return req.select("request_no", "custom_id", "n_inputs",
                      F.aggregate(body["body"]["input"], F.lit(0).cast("long"),
                                  lambda a, x: a + F.length(x)).alias("input_chars"))


def result_lines(spark, sf_dir):
    """Result JSONL as a batch API writes it, for the fixture vectors in request order.

    A request whose first vector has label 9 comes back cancelled; vectors of label 3 come back cut to
    half; requests divisible by 50 are followed by a line that is not JSON, and ones by 70 by an empty line.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    num = sequential_ids(e, ["vec_id"], "_seq")
    n_req = F.ceil(num.select(F.max("_seq")).scalar() / F.lit(PER_REQUEST))
    g = num.select(F.floor((F.col("_seq") - 1) / PER_REQUEST).cast("long").alias("request_no"),
                   ((F.col("_seq") - 1) % PER_REQUEST).cast("int").alias("index"), "label", "embedding", "_seq")
    grp = g.groupBy("request_no").agg(
        F.array_sort(F.collect_list(F.struct("_seq", "index", "label", "embedding"))).alias("items"))
    cid = BF.custom_id("embed", F.lit(NOW), F.lit(JOB), F.col("request_no"), n_req)
    cancelled = F.element_at("items", 1)["label"] == 9
    data = F.transform("items", lambda it: F.struct(
        F.lit("embedding").alias("object"), it["index"].alias("index"),
        F.when(it["label"] == 3, F.slice(it["embedding"], 1, DIM // 2)).otherwise(it["embedding"]).alias("embedding")))
    ok = F.struct(F.lit(200).alias("status_code"), F.md5(cid).alias("request_id"),
                  F.struct(F.lit("list").alias("object"), data.alias("data")).alias("body"))
    err = F.struct(F.lit("batch_cancelled").alias("code"),
                   F.lit("This request was not executed because the batch was cancelled.").alias("message"))
    line = F.to_json(F.struct(F.concat(F.lit("batch_req_"), F.md5(cid)).alias("id"), cid.alias("custom_id"),
                              F.when(~cancelled, ok).alias("response"), F.when(cancelled, err).alias("error")))
    no = F.col("request_no")
    return grp.select(F.explode(F.array(line, F.when(no % 50 == 0, "{broken"), F.when(no % 70 == 0, ""))).alias("value")).filter(
        "value IS NOT NULL")


_RESULTS_SQL = f"""
, num AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS seq FROM embeddings)
, nreq AS (SELECT CAST(ceil(count(*) / {PER_REQUEST}) AS BIGINT) AS n FROM embeddings)
, g AS (SELECT vec_id, label, embedding, (seq - 1) // {PER_REQUEST} AS request_no,
               CAST((seq - 1) % {PER_REQUEST} AS BIGINT) AS idx FROM num)
, req AS (SELECT request_no, arg_min(label, idx) = 9 AS cancelled,
                 'embed-{NOW}-{JOB}-' || lpad(CAST(request_no AS VARCHAR), CAST(length(CAST((SELECT n FROM nreq) AS VARCHAR)) AS INTEGER), '0')
                   AS custom_id
          FROM g GROUP BY request_no)
"""


@register("batch_results", _RESULTS_SQL + """
SELECT r.custom_id, g.idx AS "index",
       array_to_string(list_transform(CASE WHEN g.label = 3 THEN g.embedding[1:32] ELSE g.embedding END, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)), ',')
         AS embedding
FROM g JOIN req r USING (request_no) WHERE NOT r.cancelled
""")
def batch_results(spark, sf_dir):
    """2.1.7: result JSONL -> one row per returned embedding (success lines)."""
    ok, _ = BF.parse_results(result_lines(spark, sf_dir))
    return ok.select("custom_id", "index", V.as_scaled_ints(F.col("embedding")).alias("embedding"))


@register("batch_errors", _RESULTS_SQL + """
SELECT custom_id, 'batch_cancelled' AS code FROM req WHERE cancelled
UNION ALL SELECT NULL, 'malformed' FROM req WHERE request_no % 50 = 0
""")
def batch_errors(spark, sf_dir):
    """2.1.7 (second output): error lines of the result file."""
    _, err = BF.parse_results(result_lines(spark, sf_dir))
    return err.select("custom_id", "code")


@register("embed_responses", _RESULTS_SQL + """
SELECT g.vec_id, r.custom_id, g.idx AS "index", CASE WHEN r.cancelled THEN 'error' WHEN g.label = 3 THEN 'truncated' ELSE '' END AS state
FROM g JOIN req r USING (request_no)
""")
def embed_responses(spark, sf_dir):
    """2.1.9: place returned embeddings by (request, index); missing -> 'error', bad length -> 'truncated'."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    n_req = F.ceil(e.select(F.count("*")).scalar() / F.lit(PER_REQUEST))
    ri = BF.request_inputs(e, ["vec_id"], ["vec_id"], PER_REQUEST)
    requested = ri.select("vec_id", "index", BF.custom_id("embed", F.lit(NOW), F.lit(JOB), F.col("request_no"),
                                                          n_req).alias("custom_id"))
    ok, _ = BF.parse_results(result_lines(spark, sf_dir))
    placed = BF.place_responses(requested, ok, DIM)
    return placed.select("vec_id", "custom_id", "index", "state")


@register("first_error_per_index", """
SELECT task_id, arg_min(payload, (event_at, event_id)) AS first_error, min(event_at) AS first_at,
       count(*) AS n_errors
FROM messages WHERE subject = 'failed' GROUP BY task_id
""", views=("messages",))
def first_error_per_index(spark, sf_dir):
    """2.4.4: collect errors per index (task), the first one wins (min_by, partial aggregate)."""
    m = A.messages(spark, sf_dir, ["failed"])
    return m.groupBy("task_id").agg(
        F.min_by("payload", F.struct("event_at", "event_id")).alias("first_error"),
        F.min("event_at").alias("first_at"), F.count("*").alias("n_errors"))
