"""Batch request / result / status files."""

import json

from pyspark.sql import functions as F

from inkstone.operators import batchfiles as BF


def test_requests_grouping_and_ids(spark):
    inp = spark.createDataFrame([(i, f"text {i}") for i in range(23)], "k long, t string")
    inp = inp.selectExpr("k + 1 AS seq", "t")
    req = BF.requests(inp, "seq", "t", 1755706275, "job", "m", 23, per_request=10).orderBy("request_no").collect()
    assert [r.n_inputs for r in req] == [10, 10, 3]
    assert [r.custom_id for r in req] == ["embed-1755706275-job-0", "embed-1755706275-job-1", "embed-1755706275-job-2"]
    line = json.loads(req[2].line)
    assert line["body"]["input"] == ["text 20", "text 21", "text 22"] and line["url"] == "/v1/embeddings"


def test_results_and_placement(spark):
    ok = {"id": "r1", "custom_id": "c-0", "response": {"status_code": 200, "body": {"data": [
        {"index": 0, "embedding": [0.1, 0.2]}, {"index": 1, "embedding": [0.3]}]}}, "error": None}
    bad = {"id": "r2", "custom_id": "c-1", "response": None, "error": {"code": "batch_cancelled", "message": "m"}}
    lines = spark.createDataFrame([(json.dumps(ok),), (json.dumps(bad),), ("",)], "value string")
    good, err = BF.parse_results(lines)
    assert sorted((r.custom_id, r["index"]) for r in good.collect()) == [("c-0", 0), ("c-0", 1)]
    assert [(r.custom_id, r.code) for r in err.collect()] == [("c-1", "batch_cancelled")]
    req = spark.createDataFrame([("c-0", 0), ("c-0", 1), ("c-1", 0)], "custom_id string, index int")
    st = {(r.custom_id, r["index"]): r.state for r in BF.place_responses(req, good, 2).collect()}
    assert st == {("c-0", 0): "", ("c-0", 1): "truncated", ("c-1", 0): "error"}


def test_status(spark):
    rows = [
        {"id": "b1", "status": "completed", "output_file_id": "out", "error_file_id": None,
         "created_at": 1755706275, "in_progress_at": 1755706277, "completed_at": 1755706385,
         "request_counts": {"total": 10, "completed": 10, "failed": 0}},
        {"id": "b2", "status": "cancelled", "output_file_id": "out", "error_file_id": "err", "created_at": 1},
        {"id": "b3", "status": "in_progress", "created_at": 1},
        {"id": "b4", "status": "failed", "created_at": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    s = {r.id: r for r in BF.status(df).collect()}
    assert s["b1"].is_done and s["b1"].fetch_file_id == "out" and s["b1"].wall_seconds == 110
    assert s["b2"].fetch_file_id == "err" and not s["b3"].is_done and s["b3"].fetch_file_id is None
    assert s["b4"].missing_file


def test_custom_id_padding(spark):
    df = spark.range(1).select(BF.custom_id("gen", F.lit(5), F.lit("j"), F.lit(7), F.lit(120)).alias("c"))
    assert df.first().c == "gen-5-j-007"


def test_lines_that_are_no_results_become_error_rows(spark):
    lines = spark.createDataFrame([("",), ("  ",), ("{broken",), ("{}",), ("[1]",), (None,),
                                   ('{"custom_id": "a", "error": {"code": "x", "message": "y"}}',)], "value string")
    ok, err = BF.parse_results(lines)
    assert ok.count() == 0
    assert sorted((r.custom_id or "", r.code) for r in err.collect()) == [("", "malformed")] * 3 + [("a", "x")]
