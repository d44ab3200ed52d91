"""Message log: deliver-new, restart from the acknowledged position, redelivery, publishing once, retries."""
import json
import os
import tempfile

import pytest

from inkstone.sources import messages as M
from inkstone.streaming import commands as CM
from inkstone.streaming import jobs as J


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    M.register(spark)


def fresh(kind):
    return tempfile.mkdtemp(prefix=f"{kind}-", dir="/tmp")


def publish(spark, log, rows, checkpoint, publisher=None):
    """One batch of rows through a stream."""
    source = fresh("in")
    with open(os.path.join(source, "0.json"), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    stream = spark.readStream.schema("event_id long, subject string, data string").json(source)
    q = stream.writeStream.format(M.NAME).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (q.option("publisher", publisher) if publisher else q).start(log).awaitTermination()


def rows(start, n):
    return [{"event_id": k, "subject": CM.TASK_LOG, "data": f"é{k}"} for k in range(start, start + n)]


def consume(spark, log, name, seen, fail_at=None, consumer=None, **options):
    def keep(batch, epoch):
        got = [(r.seq, r.event_id, r.data) for r in batch.collect()]
        if fail_at is not None and got and epoch == fail_at:
            raise RuntimeError("batch failed")
        seen.append((epoch, got))
    name = name.replace("/", "_")
    if consumer:
        q = J.consume_job(spark, log, consumer, keep, name=name, **options)
    else:
        stream = J.read_messages(spark, log, **options)
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", J.checkpoint_for(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()


def flat(seen):
    return sorted(x for _, got in seen for x in got)


def test_new_consumers_get_all_or_the_new_messages(spark):
    log = fresh("log")
    publish(spark, log, rows(0, 5), fresh("ck"))
    everything, new, ck = [], [], fresh("ck")
    consume(spark, log, fresh("ck"), everything, deliver="all")
    consume(spark, log, ck, new, deliver="new")
    assert [e for _, e, _ in flat(everything)] == [0, 1, 2, 3, 4] and flat(new) == []
    publish(spark, log, rows(5, 3), fresh("ck"))
    consume(spark, log, ck, new, deliver="new")
    assert flat(new) == [(5, 5, "é5"), (6, 6, "é6"), (7, 7, "é7")]
    with pytest.raises(Exception, match="deliver"):
        consume(spark, log, fresh("ck"), [], deliver="some")


def test_a_named_consumer_goes_on_from_its_acknowledged_position(spark):
    log = fresh("log")
    publish(spark, log, rows(0, 4), fresh("ck"))
    first, second, other = [], [], []
    consume(spark, log, fresh("ck"), first, consumer="scraper")
    assert M.position(log, "scraper") == 4
    publish(spark, log, rows(4, 2), fresh("ck"))
    consume(spark, log, fresh("ck"), second, consumer="scraper")  # another query, its checkpoint lost
    assert [e for _, e, _ in flat(first)] == [0, 1, 2, 3] and [e for _, e, _ in flat(second)] == [4, 5]
    assert M.position(log, "scraper") == 6
    consume(spark, log, fresh("ck"), other, consumer="keywords")
    assert len(flat(other)) == 6


def test_a_failed_batch_is_not_acknowledged_and_delivered_again_as_it_was(spark):
    log, ck = fresh("log"), fresh("ck")
    publish(spark, log, rows(0, 3), fresh("ck"))
    seen = []
    with pytest.raises(Exception, match="batch failed"):
        consume(spark, log, ck, seen, fail_at=0, consumer="c")
    assert seen == [] and M.position(log, "c") is None
    publish(spark, log, rows(3, 2), fresh("ck"))
    consume(spark, log, ck, seen, consumer="c")
    assert [e for _, e, _ in sorted(seen[0][1])] == [0, 1, 2]  # the failed batch with its own messages, not with the newer ones
    consume(spark, log, ck, seen, consumer="c")
    assert [e for _, e, _ in flat(seen)] == [0, 1, 2, 3, 4] and M.position(log, "c") == 5


def test_a_batch_that_is_committed_again_changes_nothing(spark):
    log = fresh("log")
    schema = spark.createDataFrame([], "event_id long, subject string, data string").schema
    writer = M._Writer({"path": log, "publisher": "p"}, schema)
    staged = [writer.write(iter([(k, "s", "x"), (k + 1, "s", "y")])) for k in (0, 10)]
    for n, m in enumerate(staged):
        m.task = n
    writer.commit(staged, 7)
    again = [writer.write(iter([(k, "s", "x"), (k + 1, "s", "y")])) for k in (0, 10)]
    for n, m in enumerate(again):
        m.task = n
    writer.commit(again, 7)
    system, root = M.store(log)
    assert [(s.start, s.count) for s in M.segments(system, root)] == [(0, 2), (2, 2)]
    # a commit that died after its first task
    os.remove(M.segments(system, root)[1].place)
    third = [writer.write(iter([(k, "s", "x"), (k + 1, "s", "y")])) for k in (0, 10)]
    for n, m in enumerate(third):
        m.task = n
    writer.commit(third, 7)
    assert [(s.start, s.count) for s in M.segments(system, root)] == [(0, 2), (2, 2)]
    left = writer.write(iter([(99, "s", "z")]))
    writer.abort([left, None], 8)
    assert os.listdir(f"{root}/staged") == []
    seen = []
    consume(spark, log, fresh("ck"), seen)
    assert [e for _, e, _ in flat(seen)] == [0, 1, 10, 11]


def test_publishing_retries_with_capped_delays():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 5:
            raise OSError("store away")
        return "done"

    assert M.tried(flaky, sleep=slept.append) == "done"
    assert slept == [0.5, 1.0, 2.0, 4.0]
    with pytest.raises(OSError):
        M.tried(lambda: (_ for _ in ()).throw(OSError("gone")), sleep=slept.append)
    assert slept[4:] == [0.5, 1.0, 2.0, 4.0, 8.0]
    assert M.tried.__defaults__[0] == M.PUBLISH


def test_batches_are_limited_and_slices_cover_a_segment(spark, monkeypatch):
    log = fresh("log")
    publish(spark, log, rows(0, 40), fresh("ck"))
    schema = spark.createDataFrame([], "seq long, event_id long").schema
    reader = M._Reader({"path": log, "maxmessagesperbatch": "15"}, schema)
    monkeypatch.setattr(M, "READ_MESSAGES", 7)
    parts = reader.partitions({"next": 3}, {"next": 30})
    got = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 4 and sorted(r[0] for r in got) == list(range(3, 30))
    assert reader.latestOffset() == {"next": 40}  # 30 + 15, but the log ends before


def test_events_travel_through_the_log_into_the_task_table(spark, sf):
    from inkstone.sources import adapters as A
    log, out, wire = fresh("log"), fresh("tasks"), fresh("wire")
    CM.render(A.messages(spark, sf)).coalesce(1).write.mode("append").json(wire)
    J.publish(J.read_wire(spark, wire), log, name="m-publish").awaitTermination()
    J.task_state_job(J.read_messages(spark, log).drop("seq"), out, name="m-tasks").awaitTermination()
    direct = fresh("tasks")
    J.task_state_job(J.read_wire(spark, wire), direct, name="m-direct").awaitTermination()
    assert sorted(map(tuple, J.latest_tasks(spark, out).collect()), key=repr) == sorted(
        map(tuple, J.latest_tasks(spark, direct).collect()), key=repr)
    n = CM.render(A.messages(spark, sf)).count()
    system, root = M.store(log)
    assert sum(x.count for x in M.segments(system, root)) == n
