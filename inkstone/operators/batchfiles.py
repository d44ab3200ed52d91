"""Batch-API files for embedding jobs as DataFrames.

* ``requests`` — numbered inputs grouped into requests of ``per_request``
  inputs, one JSONL line per request.  Each group is bounded by
  ``per_request``, so ``collect_list`` never holds an unbounded group.
* ``parse_results`` — JSONL result lines -> success rows (one per returned
  embedding) and error rows.
* ``place_responses`` — join requested inputs with returned embeddings by
  (custom_id, index) and mark each input ok / truncated / error.
* ``status`` — batch job status rows: terminal flag and the file to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.operators.tables import sequential_ids

ENDPOINT = "/v1/embeddings"
# Terminal batch states.
TERMINAL_STATES = ["completed", "failed", "cancelled", "expired"]

RESULT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.IntegerType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("body", T.StructType([
            T.StructField("object", T.StringType()),
            T.StructField("data", T.ArrayType(T.StructType([
                T.StructField("object", T.StringType()),
                T.StructField("index", T.IntegerType()),
                T.StructField("embedding", T.ArrayType(T.DoubleType())),
            ]))),
        ])),
    ])),
    T.StructField("error", T.StructType([
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
    ])),
])

STATUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("input_file_id", T.StringType()),
    T.StructField("output_file_id", T.StringType()),
    T.StructField("error_file_id", T.StringType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("in_progress_at", T.LongType()),
    T.StructField("completed_at", T.LongType()),
    T.StructField("request_counts", T.StructType([
        T.StructField("total", T.LongType()), T.StructField("completed", T.LongType()),
        T.StructField("failed", T.LongType())])),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def custom_id(kind: str, now: Column, job: Column, i: Column, n_requests: Column) -> Column:
    """``kind-now-job-NN``; NN zero-padded to the digit count of the request count."""
    digits = F.length(n_requests.cast("string"))
    return F.concat(F.lit(kind + "-"), now.cast("string"), F.lit("-"), job, F.lit("-"),
                    F.lpad(i.cast("string"), digits, "0"))


def requests(inputs: DataFrame, seq_col: str, text_col: str, now: int, job: str, model: str,
             n_inputs: int, per_request: int = 10, dim: int | None = None) -> DataFrame:
    """(request_no, custom_id, n_inputs, line): one embeddings request per group of inputs.

    ``seq_col`` numbers the ``n_inputs`` inputs from 1 (``tables.key_offsets`` or
    ``sequential_ids``), so no text is sorted here.
    """
    g = inputs.withColumn("_seq", F.col(seq_col)).withColumn("request_no", F.floor((F.col("_seq") - 1) / per_request).cast("long"))
    grouped = g.groupBy("request_no").agg(
        F.array_sort(F.collect_list(F.struct("_seq", F.col(text_col).alias("t")))).alias("_items"))
    n_requests = F.lit(-(-n_inputs // per_request))
    cid = custom_id("embed", F.lit(now), F.lit(job), F.col("request_no"), n_requests)
    body_fields = [F.transform("_items", lambda x: x["t"]).alias("input"), F.lit(model).alias("model"),
                   F.lit("float").alias("encoding_format")]
    if dim:
        body_fields.append(F.lit(dim).alias("dimensions"))
    line = F.to_json(F.struct(cid.alias("custom_id"), F.lit("POST").alias("method"),
                              F.lit(ENDPOINT).alias("url"), F.struct(*body_fields).alias("body")))
    return grouped.select("request_no", cid.alias("custom_id"), F.size("_items").alias("n_inputs"),
                          line.alias("line"))


def request_inputs(inputs: DataFrame, order_cols: list, key_cols: list, per_request: int = 10) -> DataFrame:
    """(key..., request_no, index): where each input sits inside the request lines."""
    numbered = sequential_ids(inputs, order_cols, "_seq")
    return numbered.select(*key_cols, F.floor((F.col("_seq") - 1) / per_request).cast("long").alias("request_no"),
                           ((F.col("_seq") - 1) % per_request).cast("int").alias("index"))


def parse_results(lines: DataFrame, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(ok rows: custom_id, index, embedding float[]; error rows: custom_id, code, message).

    Blank lines are skipped; a line that is no result becomes an error row of code ``malformed``.
    """
    filled = lines.filter(F.trim(F.col(line_col)) != "")
    p = filled.select(F.col(line_col).alias("line"), F.from_json(F.col(line_col), RESULT_SCHEMA).alias("r"))
    bad = p.filter(F.col("r").isNull() | F.col("r.custom_id").isNull()).select(
        F.lit(None).cast("string").alias("custom_id"), F.lit("malformed").alias("code"), F.col("line").alias("message"))
    p = p.filter(F.col("r.custom_id").isNotNull())
    ok = (p.filter(F.col("r.response").isNotNull())
          .select(F.col("r.custom_id").alias("custom_id"), F.explode("r.response.body.data").alias("d"))
          .select("custom_id", F.col("d.index").alias("index"),
                  F.col("d.embedding").cast("array<float>").alias("embedding")))
    err = (p.filter(F.col("r.error").isNotNull())
           .select(F.col("r.custom_id").alias("custom_id"), F.col("r.error.code").alias("code"),
                   F.col("r.error.message").alias("message")))
    return ok, err.unionByName(bad)


def place_responses(requested: DataFrame, returned: DataFrame, dim: int) -> DataFrame:
    """Left-join requested (custom_id, index, ...) to returned embeddings; state column:
    '' ok, 'truncated' wrong length, 'error' missing."""
    j = requested.join(returned, ["custom_id", "index"], "left")
    state = (F.when(F.col("embedding").isNull(), "error")
             .when(F.size("embedding") != dim, "truncated").otherwise(""))
    return j.withColumn("state", state)


def status(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Batch status rows: terminal flag; the file to fetch is the error file unless completed."""
    s = raw.select(F.from_json(F.col(json_col), STATUS_SCHEMA).alias("s")).select("s.*")
    terminal = F.col("status").isin(TERMINAL_STATES)
    fetch = F.when(~terminal, F.lit(None)).when(F.col("status") == "completed", F.col("output_file_id")) \
        .otherwise(F.col("error_file_id"))
    return s.select(
        "id", "status", terminal.alias("is_done"), fetch.alias("fetch_file_id"),
        (terminal & (F.coalesce(fetch, F.lit("")) == "")).alias("missing_file"),
        F.timestamp_seconds("created_at").cast("timestamp_ntz").alias("created_at"),
        F.timestamp_seconds("in_progress_at").cast("timestamp_ntz").alias("start_at"),
        F.timestamp_seconds("completed_at").cast("timestamp_ntz").alias("end_at"),
        (F.col("completed_at") - F.col("created_at")).alias("wall_seconds"),
        F.col("request_counts.total").alias("total"), F.col("request_counts.failed").alias("failed"))
