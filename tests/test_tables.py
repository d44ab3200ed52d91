"""Table maintenance operators and skew-safe per-key sequencing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.operators import sequence as SQ
from inkstone.operators import tables as TB


def test_sequential_ids_dense_ordered_and_stable(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(13)
    a = TB.sequential_ids(df, ["k"], "sid", start_after=100)
    rows = a.orderBy("k").collect()
    assert [r.sid for r in rows] == list(range(101, 5101))
    # evaluating again gives the same numbering
    b = {r.k: r.sid for r in a.collect()}
    assert all(b[r.k] == r.sid for r in rows)


def test_insert_if_absent_and_returning_ids(spark):
    existing = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], "id long, k int, v string")
    new = spark.createDataFrame([(11, "b2"), (12, "c"), (12, "c"), (13, "d")], "k int, v string")
    ins = TB.insert_returning_ids(new, existing, ["k"], ["k"]).orderBy("k").collect()
    assert [(r.id, r.k) for r in ins] == [(3, 12), (4, 13)]


def test_fk_cascade_latest_page(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid long, pid long")
    assert [r.key_value for r in TB.fk_orphans(child, ["pid"], parent, ["id"], "e").collect()] == ["3"]
    gone = spark.createDataFrame([(1,)], "id long")
    # a NULL foreign key references nothing, so the cascade keeps it
    assert sorted(r.cid for r in TB.cascade_delete(child, gone, "pid").collect()) == [11, 12]
    arts = spark.createDataFrame([(1, "u", 5), (2, "u", 9), (3, "v", 1), (4, "u", 9)], "id long, url string, published_at int")
    assert sorted((r.url, r.id) for r in TB.latest_by(arts, "url").collect()) == [("u", 4), ("v", 3)]
    assert [r.id for r in TB.page(arts, [F.col("id").desc()], 2, 1).collect()] == [3, 2]


def test_unique_violations(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [(r.key_value, r.n) for r in TB.unique_violations(df, ["k"], "u").collect()] == [("a", 2)]


def _events(spark):
    # one hot key holding most rows plus small keys
    rows = [(i, "hot" if i % 10 else f"k{i % 7}", (i * 37) % 1000) for i in range(3000)]
    return spark.createDataFrame(rows, "eid long, key string, t long")


def test_rank_within_matches_window(spark):
    ev = _events(spark)
    got = {r.eid: r.ordinal for r in SQ.rank_within(ev, "key", ["t", "eid"]).collect()}
    w = Window.partitionBy("key").orderBy("t", "eid")
    exp = {r.eid: r.rn for r in ev.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp


def test_with_previous_matches_lag(spark):
    ev = _events(spark)
    got = {r.eid: r.prev_t for r in SQ.with_previous(ev, "key", ["t", "eid"], ["t"]).collect()}
    w = Window.partitionBy("key").orderBy("t", "eid")
    exp = {r.eid: r.p for r in ev.withColumn("p", F.lag("t").over(w)).collect()}
    assert got == exp


def test_sinks_append_and_partition_overwrite(spark):
    import tempfile

    from inkstone.sources import sinks
    d = tempfile.mkdtemp(prefix="sink-tbl-", dir="/tmp") + "/t"
    a = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 1, "c")], "id long, model_id int, v string")
    sinks.append_table(a, d, ["model_id"])
    sinks.append_table(spark.createDataFrame([(4, 0, "d")], "id long, model_id int, v string"), d, ["model_id"])
    assert sorted(r.id for r in spark.read.parquet(d).collect()) == [1, 2, 3, 4]
    # survivors of a cascade for model 1 only: partition 0 must be left untouched
    sinks.overwrite_partitions(spark.createDataFrame([(3, 1, "c")], "id long, model_id int, v string"), d, ["model_id"])
    got = sorted((r.id, r.model_id) for r in spark.read.parquet(d).collect())
    assert got == [(1, 0), (3, 1), (4, 0)]


def test_sequential_ids_with_hot_leading_key(spark):
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("key"), F.col("id").alias("t")).repartition(9)
    out = TB.sequential_ids(df, ["key", "t"], "sid")
    rows = out.orderBy("key", "t").collect()
    assert [r.sid for r in rows] == list(range(1, n + 1))
    hot = [r for r in rows if r.key == "hot"]
    assert len(hot) == 14000 and hot[0].sid < hot[-1].sid


def test_key_offsets_are_prefix_sums(spark):
    rows = [(k, k % 5) for k in range(0, 3000, 3)]
    got = {r.k: r.offset for r in TB.key_offsets(spark.createDataFrame(rows, "k long, n long").repartition(9), "k").collect()}
    total = 0
    for k, n in rows:
        assert got[k] == total
        total += n
    assert TB.key_offsets(spark.createDataFrame([], "k long, n long"), "k").count() == 0


def test_insert_if_absent_keeps_the_first_of_equal_keys(spark):
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, None, 1)], "k int, v string, w int")
    got = TB.insert_if_absent(new, new.limit(0), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3), (2, None, 1)]
    assert TB.insert_if_absent(new, new.limit(0), ["k"], ["w"]).filter("k = 1").first().v == "b"


def test_insert_if_absent_probes_the_stored_table_without_shuffling_it(spark, tmp_path):
    stored = str(tmp_path / "stored")
    spark.range(50_000).selectExpr("id AS a", "id % 7 AS b", "repeat('x', 20) AS t").write.parquet(stored)
    new = spark.createDataFrame([(1, 1, "y"), (1, 2, "z"), (60_000, 0, "w"), (None, 0, "n"), (1, 2, "zz")], "a long, b long, t string")
    got = TB.insert_if_absent(new, spark.read.parquet(stored), ["a", "b"])
    rows = got.collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, 2, "z"), (60_000, 0, "w"), (None, 0, "n")], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    above = [line for line in final.splitlines() if "LeftSemi" in line]
    assert above and all("BroadcastHashJoin" in line for line in above), final


def test_fk_orphans_repeats_a_row_as_often_as_it_stands_for(spark):
    child = spark.createDataFrame([(1, 2), (2, 3), (3, 0), (None, 4)], "k long, n long")
    parent = spark.createDataFrame([(1,), (1,)], "id long")
    got = TB.fk_orphans(child, ["k"], parent, ["id"], "e", times="n").collect()
    assert [tuple(r) for r in got] == [("e", "2")] * 3


def test_fk_orphans_reads_texts_once_and_shuffles_none(spark):
    from inkstone.plans import registry
    registry.load_all()
    plan = registry.QUERIES["fk_orphans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_insert_if_absent_probes_with_given_keys_only(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    old = spark.createDataFrame([(2, "x"), (9, "y")], "k long, v string")
    got = TB.insert_if_absent(new, old, ["k"], keys=spark.range(1, 4).select(F.col("id").alias("k")))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (3, "c")]
    # the rows themselves are read once
    marked = new.withColumn("v", F.concat("v", F.lit("_made")))
    plan = TB.insert_if_absent(marked.withColumn("k", F.col("k") + F.length("v") * 0), old, ["k"], keys=new.select("k"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("_made") == 1
