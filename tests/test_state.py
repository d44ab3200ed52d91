"""Stateful streams against their batch forms: uneven batches, late rows, restarts, expiry."""
import json
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.streaming import commands as CM
from inkstone.streaming import jobs as J

TASKS = ["123e4567-e89b-42d3-a456-42661417400%d" % k for k in range(4)]
START = 1_700_000_000


def failed(event_id, task, at):
    return {"event_id": event_id, "subject": CM.TASK_FAILED, "data": json.dumps({"task_id": TASKS[task], "event_at": START + at, "errors": "x"})}


def created(event_id, task, at, text):
    return {"event_id": event_id, "subject": CM.TASK_CREATED, "data": json.dumps(
        {"task_id": TASKS[task], "event_at": START + at, "source": "text", "original_input": text})}


def step(event_id, task, at):
    return {"event_id": event_id, "subject": CM.TASK_UPDATE_STATUS, "data": json.dumps(
        {"task_id": TASKS[task], "event_at": START + at, "status": "processing"})}


def deliver(folder, n, rows):
    path = os.path.join(folder, f"{n:04d}.json")
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(path, (START + n, START + n))  # the file source goes by time


def numbered(rows):
    """event_id -> (attempt, action) of all failures, per task in event order."""
    out, by = {}, {}
    for r in {r["event_id"]: r for r in rows}.values():
        d = json.loads(r["data"])
        by.setdefault(d["task_id"], []).append((d["event_at"], r["event_id"]))
    for mine in by.values():
        for n, (_, e) in enumerate(sorted(mine)):
            out[e] = (n, "dead_letter" if n >= 3 else "retry")
    return out


def test_retries_are_numbered_in_event_order_whatever_the_batches(spark):
    wire, out = tempfile.mkdtemp(prefix="wire-", dir="/tmp"), tempfile.mkdtemp(prefix="retry-", dir="/tmp")
    # later failures first, in two micro-batches, and a task with more failures than an Arrow batch holds
    batches = [[failed(3, 0, 30), failed(4, 0, 40), failed(10, 1, 500)], [failed(1, 0, 10), failed(2, 0, 20), failed(3, 0, 30)],
               [failed(100 + k, 2, 5000 - k) for k in range(2500)], [failed(5000 + k, 2, 6000 + k) for k in range(300)]]
    for n, rows in enumerate(batches):
        deliver(wire, n, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        J.retry_job(J.read_wire(spark, wire, max_files_per_trigger=1), out, name="s-retry-order").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.event_id: (r.attempt, r.action) for r in J.latest_retries(spark, out).collect()}
    assert got == numbered([r for b in batches for r in b])
    first = {r.event_id: r.next_at for r in J.latest_retries(spark, out).where("action = 'retry'").collect()}
    assert (first[2] - first[1]).total_seconds() == 10.5  # 10 s later, 1,000 instead of 500 ms


def test_retries_count_on_after_a_restart_and_forget_quiet_tasks(spark):
    wire, out = tempfile.mkdtemp(prefix="wire-", dir="/tmp"), tempfile.mkdtemp(prefix="retry-", dir="/tmp")

    def run(n, rows):
        deliver(wire, n, rows)
        J.retry_job(J.read_wire(spark, wire, max_files_per_trigger=1), out, name="s-retry-restart").awaitTermination()
        return {r.event_id: r.attempt for r in J.latest_retries(spark, out).collect()}

    assert run(0, [failed(1, 0, 0), failed(2, 0, 60)]) == {1: 0, 2: 1}
    # beyond the watermark the first two are only a count
    assert run(1, [failed(3, 0, 5 * 3600)])[3] == 2
    assert run(2, [failed(4, 0, 9 * 3600), failed(5, 1, 9 * 3600)])[4] == 3
    run(3, [failed(6, 1, 40 * 3600)])
    assert run(4, [failed(7, 0, 41 * 3600)])[7] == 0  # a horizon without failures


def test_task_table_reads_the_folded_table_and_later_epochs_only(spark):
    wire, out = tempfile.mkdtemp(prefix="wire-", dir="/tmp"), tempfile.mkdtemp(prefix="tasks-", dir="/tmp")
    for n in range(7):
        deliver(wire, n, [created(n, n % 3, 3600 * n, f"t{n}"), failed(50 + n, 3, 3600 * n)])
    J.task_state_job(J.read_wire(spark, wire, max_files_per_trigger=1), out, name="s-fold", fold=3).awaitTermination()
    got = {r.task_id: (r.status, r.n_events) for r in J.latest_tasks(spark, out).collect()}
    assert got == {TASKS[0]: ("pending", 3), TASKS[1]: ("pending", 2), TASKS[2]: ("pending", 2), TASKS[3]: ("failed", 7)}
    read = {f.split("/")[-2] for f in J._task_days(spark, out).inputFiles()}
    assert any(f.startswith("upto=") for f in read) and not {"epoch=0", "epoch=1"} & read
    assert J.latest_tasks(spark, out).groupBy("task_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("ttl, minutes", [("60 minutes", 60), ("3 hours", 180)])
def test_content_reads_equal_the_batch_form(spark, ttl, minutes):
    wire, out = tempfile.mkdtemp(prefix="wire-", dir="/tmp"), tempfile.mkdtemp(prefix="reads-", dir="/tmp")
    batches = [[step(1, 0, 100), created(2, 0, 50, "first"), step(3, 1, 70)], [step(4, 0, 3600), created(5, 0, 1800, "second"), step(6, 0, 1700)],
               [step(7, 0, 1800 + 3600), step(8, 0, 1801 + 3600), step(9, 0, 1800 + 3 * 3600), created(10, 2, 20_000, None), step(11, 2, 20_001)],
               [step(12, 0, 90_000), step(13, 2, 20_002), step(14, 3, 90_001)]]
    for n, rows in enumerate(batches):
        deliver(wire, n, rows)
    table = spark.createDataFrame([(TASKS[0], "stored 0"), (TASKS[1], "stored 1")], "task_id string, content string")
    J.content_reads_job(J.read_wire(spark, wire, max_files_per_trigger=1), table, out, name=f"s-reads-{minutes}", ttl=ttl).awaitTermination()
    got = {r.event_id: (r.served_from, r.content) for r in spark.read.parquet(out).collect()}
    entries, steps = [], []
    for r in (r for b in batches for r in b):
        d = json.loads(r["data"])
        (entries if r["subject"] == CM.TASK_CREATED else steps).append((d["task_id"], d["event_at"], r["event_id"], d.get("original_input")))
    stored = {TASKS[0]: "stored 0", TASKS[1]: "stored 1"}
    want = {}
    for task, at, event_id, _ in steps:
        live = [e for e in entries if e[0] == task and at - 60 * minutes <= e[1] <= at]
        want[event_id] = ("cache", max(live, key=lambda e: e[1])[3]) if live else ("db", stored.get(task))
    assert got == want and {s for s, _ in got.values()} == {"cache", "db"}


def test_content_reads_of_the_event_table_equal_the_registered_query(spark, sf):
    from inkstone.plans import q_streams as Q
    from inkstone.sources import adapters as A
    from inkstone.streaming.tasks import uuid_of
    m = A.messages(spark, sf).where("value >= 1 AND value < 400")
    wire, out = tempfile.mkdtemp(prefix="wire-", dir="/tmp"), tempfile.mkdtemp(prefix="reads-", dir="/tmp")
    CM.render(m).coalesce(2).write.mode("append").json(wire)
    table = m.select(uuid_of(F.col("task_id")).alias("task_id"), F.lit("row").alias("content")).distinct()
    J.content_reads_job(J.read_wire(spark, wire), table, out, name="s-reads-table").awaitTermination()
    got = {r.event_id: r.served_from for r in spark.read.parquet(out).collect()}
    # whole seconds on the wire
    p = m.withColumn("event_at", F.date_trunc("second", "event_at"))
    w = Window.partitionBy("task_id").orderBy(F.unix_seconds(F.col("event_at").cast("timestamp"))).rangeBetween(-60 * Q.CACHE_TTL, 0)
    n = F.count(F.when(F.col("subject") == "pending", 1)).over(w)
    want = {r.event_id: "cache" if r.n else "db" for r in p.withColumn("n", n).where("subject = 'processing'").collect()}
    assert got == want
