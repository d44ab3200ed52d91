"""Streaming jobs (availableNow on a file source) against their batch forms."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from inkstone.operators import embed as EM
from inkstone.sources import adapters as A
from inkstone.streaming import commands as CM
from inkstone.streaming import jobs as J


@pytest.fixture(scope="module")
def wire_dir(spark, sf):
    d = tempfile.mkdtemp(prefix="wire-", dir="/tmp")
    m = A.messages(spark, sf)
    w = CM.render(m).join(m.select("event_id", "event_at"), "event_id")
    # at-least-once delivery: failed-task messages are delivered twice
    w = w.unionByName(w.filter(F.col("subject") == CM.TASK_FAILED))
    lo, hi = [x.timestamp() for x in w.agg(F.min("event_at"), F.max("event_at")).first()]
    step = (hi - lo) / 3
    for i in range(3):  # three files in event-time order, as a live queue would deliver them
        t = F.unix_seconds(F.col("event_at").cast("timestamp"))
        part = w.filter((t >= lo + i * step) & ((t < lo + (i + 1) * step) if i < 2 else F.lit(True)))
        part.drop("event_at").coalesce(1).write.mode("append").json(d)
    return d


def test_parse_rejects_types_and_enums(spark):
    rows = [
        (1, CM.TASK_UPDATE_STATUS, '{"task_id":"123e4567-e89b-42d3-a456-426614174000","user_id":"x","status":"done"}'),
        (2, CM.TASK_UPDATE_STATUS, '{"task_id":"123e4567-e89b-42d3-a456-426614174000","user_id":1,"status":"nope"}'),
        (3, CM.TASK_LOG, '{"task_id":"123e4567-e89b-42d3-a456-426614174000","level":"Verbose"}'),
        (4, CM.TASK_CREATED, '{"task_id":"123e4567-e89b-42d3-a456-426614174000","source":"url"}'),
        (5, CM.TASK_CREATED, 'not json'),
    ]
    df = spark.createDataFrame(rows, "event_id long, subject string, data string")
    r = {x.event_id: x.reason for x in CM.parse(df).collect()}
    assert r == {1: "malformed", 2: "bad status", 3: "bad level", 4: None, 5: "malformed"}
    route = CM.route(CM.parse(df).filter("reason IS NULL")).collect()
    assert [(x.event_id, x.command) for x in route] == [(4, CM.TASK_SCRAPE)]


def test_dead_letter_job(spark, wire_dir):
    base = tempfile.mkdtemp(prefix="dl-", dir="/tmp")
    q = J.dead_letter_job(J.read_wire(spark, wire_dir), f"{base}/good", f"{base}/dead", name="t-dead")
    q.awaitTermination()
    total = spark.read.json(wire_dir).count()
    good = spark.read.parquet(f"{base}/good").count()
    dead = spark.read.parquet(f"{base}/dead")
    assert good + dead.count() == total and dead.count() > 0
    assert dead.select(F.decode(F.unbase64("data_b64"), "UTF-8").alias("d")).filter("d LIKE '%user_id%'").count() == dead.count()


def test_task_state_stream_matches_batch(spark, wire_dir):
    out = tempfile.mkdtemp(prefix="ts-", dir="/tmp")
    q = J.task_state_job(J.read_wire(spark, wire_dir, max_files_per_trigger=1), out, name="t-state")
    q.awaitTermination()
    got = J.latest_tasks(spark, out)
    parsed = J.with_event_time(CM.parse(spark.read.json(wire_dir))).filter("reason IS NULL").dropDuplicates(["event_id"])
    ev = parsed.filter(F.col("subject").isin(CM.TASK_UPDATE_STATUS, CM.TASK_CREATED, CM.TASK_FAILED))
    status = (F.when(F.col("subject") == CM.TASK_CREATED, "pending")
              .when(F.col("subject") == CM.TASK_FAILED, "failed").otherwise(F.col("m")["status"]))
    exp = ev.groupBy(F.col("m")["task_id"].alias("task_id")).agg(
        F.max_by(status, F.struct("event_at", "event_id")).alias("status"),
        F.max_by(F.when(F.col("subject") == CM.TASK_FAILED, F.col("m")["errors"]),
                 F.when(F.col("subject") == CM.TASK_FAILED, F.struct("event_at", "event_id"))).alias("error_message"),
        F.min("event_at").alias("created_at"), F.max("event_at").alias("updated_at"), F.count("*").alias("n_events"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, exp.collect()), key=repr)
    assert got.filter("error_message IS NOT NULL").count() > 0


def test_log_rollup_stream_closed_windows(spark, wire_dir):
    out = tempfile.mkdtemp(prefix="lr-", dir="/tmp")
    q = J.log_rollup_job(J.read_wire(spark, wire_dir), out, name="t-rollup")
    q.awaitTermination()
    got = {(str(r.window_start), r.level): r.n for r in spark.read.parquet(out).collect()}
    parsed = J.with_event_time(CM.parse(spark.read.json(wire_dir))).filter("reason IS NULL").filter(F.col("subject") == CM.TASK_LOG)
    exp = {(str(r.ws), r.level): r.n for r in parsed.groupBy(
        F.window("event_at", "10 minutes").start.alias("ws"), F.col("m")["level"].alias("level")).agg(F.count("*").alias("n")).collect()}
    assert {level for _, level in got} == set(CM.LOG_LEVELS)
    assert got and all(exp[k] == v for k, v in got.items())


def test_embed_with_states(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "boom"), (3, "gamma")], "id long, text string")

    def fn(texts):
        if "boom" in texts:
            raise RuntimeError("remote failure")
        return [[0.0] * (4 if t != "gamma" else 3) for t in texts]

    r = {x.id: x.state for x in EM.embed_with(df, "text", fn, dim=4, batch_size=1).collect()}
    assert r == {1: "", 2: "error", 3: "truncated"}
    hashed = EM.embed_hashed(df, "text", 8).collect()
    py = EM.hashed_fn(8)([x.text for x in hashed])
    for row, vec in zip(hashed, py):
        assert [round(a, 9) for a in row.vector] == [round(b, 9) for b in vec]


@pytest.mark.parametrize("ttl", ["60 minutes", "3 hours"])
def test_content_cache_stream_matches_batch(spark, wire_dir, ttl):
    out = tempfile.mkdtemp(prefix="cc-", dir="/tmp")
    q = J.content_cache_job(J.read_wire(spark, wire_dir), out, name="t-cache-" + ttl[0], ttl=ttl)
    q.awaitTermination()
    got = {r.event_id for r in spark.read.parquet(out).collect()}
    # batch form on the same valid messages
    p = J.with_event_time(CM.parse(spark.read.json(wire_dir))).filter("reason IS NULL").dropDuplicates(["event_id"])
    cache = p.filter(F.col("subject") == CM.TASK_CREATED).select(
        F.col("m")["task_id"].alias("c_task"), F.col("event_at").alias("cached_at"))
    steps = p.filter((F.col("subject") == CM.TASK_UPDATE_STATUS) & (F.col("m")["status"] == "processing")).select(
        "event_id", F.col("m")["task_id"].alias("task_id"), "event_at")
    cond = F.expr("c_task = task_id AND cached_at <= event_at AND cached_at >= event_at - INTERVAL " + ttl)
    exp = {r.event_id for r in steps.join(cache, cond, "left_semi").collect()}
    assert got and got == exp


def test_message_sink_partitions_by_subject(spark, wire_dir):
    out = tempfile.mkdtemp(prefix="pub-", dir="/tmp")
    good = CM.parse(J.read_wire(spark, wire_dir)).filter("reason IS NULL").select("event_id", "subject", "data")
    q = J.message_sink(good, out, name="t-publish")
    q.awaitTermination()
    back = spark.read.json(out)
    assert set(r.subject for r in back.select("subject").distinct().collect()) <= {
        CM.TASK_CREATED, CM.TASK_UPDATE_STATUS, CM.TASK_FAILED, CM.TASK_LOG}
    exp = CM.parse(spark.read.json(wire_dir)).filter("reason IS NULL").count()
    assert back.count() == exp


def test_route_job_matches_batch(spark, wire_dir):
    out = tempfile.mkdtemp(prefix="route-", dir="/tmp")
    q = J.route_job(J.read_wire(spark, wire_dir), out, name="t-route")
    q.awaitTermination()
    got = sorted((r.subject, r.value) for r in spark.read.json(out).collect())
    exp_df = J.routed_commands(spark.read.json(wire_dir))
    exp = sorted((r.subject, r.value) for r in exp_df.select(
        "subject", F.to_json(F.struct("event_id", "data")).alias("value")).collect())
    assert got and got == exp
    assert {s for s, _ in got} <= {CM.TASK_SCRAPE, CM.TASK_GENERATE_TITLE}


def test_retry_stream_matches_batch(spark, wire_dir):
    from pyspark.sql import Window
    out = tempfile.mkdtemp(prefix="retry-", dir="/tmp")
    q = J.retry_job(J.read_wire(spark, wire_dir), out, name="t-retry")
    q.awaitTermination()
    got = sorted((r.event_id, r.attempt, r.delay_ms, r.action) for r in spark.read.parquet(out).collect())
    p = J.with_event_time(CM.parse(spark.read.json(wire_dir))).filter("reason IS NULL").dropDuplicates(["event_id"])
    f = p.filter(F.col("subject") == CM.TASK_FAILED).select("event_id", F.col("m")["task_id"].alias("task_id"), "event_at")
    w = Window.partitionBy("task_id").orderBy("event_at", "event_id")
    a = f.withColumn("attempt", F.row_number().over(w) - 1)
    exp = sorted((r.event_id, r.attempt, r.d, r.act) for r in a.select(
        "event_id", "attempt", CM.backoff_ms(F.col("attempt"), 500, 10_000).alias("d"),
        F.when(F.col("attempt") >= 3, "dead_letter").otherwise("retry").alias("act")).collect())
    assert got and got == exp
    rows = spark.read.parquet(out)
    assert rows.filter("action = 'retry' AND next_at IS NULL OR action = 'dead_letter' AND next_at IS NOT NULL").count() == 0


@pytest.mark.parametrize("dim", [8, 64, 300])
def test_embed_hashed_matches_python_twin_at_every_dimension(spark, sf, dim):
    from inkstone.operators import chunking as C
    texts = C.paragraph_chunks(A.articles(spark, sf)).select("article_id", "chunk_no", F.col("chunk").alias("text")).limit(200)
    rows = EM.embed_hashed(texts, "text", dim).collect()
    for r, v in zip(rows, EM.hashed_fn(dim)([r.text for r in rows]), strict=True):
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.vector, v, strict=True))


def test_workers_import_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys

    import inkstone
    root = os.path.dirname(os.path.dirname(os.path.abspath(inkstone.__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from inkstone import session
from inkstone.operators import embed
s = session.build("local[1]", shuffle_partitions=1)
df = s.createDataFrame([("some words here",)], "text string")
print("VECTORS", embed.embed_hashed(df, "text", 8).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "VECTORS 1" in out.stdout, out.stderr[-2000:]


def test_scans_are_dealt_only_where_a_local_session_says_so(spark, sf):
    from inkstone.sources import tables
    plan = lambda: tables.table(spark, sf, "documents")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4)" in plan()
    spark.conf.unset(tables.SCAN_PARTITIONS)
    try:
        assert "Exchange" not in plan()
    finally:
        spark.conf.set(tables.SCAN_PARTITIONS, "4")
