import math

import pytest
from pyspark.sql import functions as F

from inkstone.llm import mixing
from tests.llm import odd


def waterfill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_w = sum(w[s] for s in sizes if s not in full)
        left = total - sum(cap * sizes[s] for s in full)
        goal = {s: cap * sizes[s] if s in full else left * w[s] / open_w for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > cap * sizes[s] + 1e-9}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 10, "c": 1000, None: 5}, {"a": 0, "b": 7}, {"x": 5}, {"a": 0},
    {"a": 3, "b": 1, "c": 4, "d": 1, "e": 5, "f": 9, "g": 2, None: 60}])
def test_targets_match_water_filling(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = waterfill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in got)


def many(spark, n=4000):
    # a third of the rows in one source, sizes from 0 to 400
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(pmod(hash(id), 400) as int))").alias("text"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 7) END").alias("source"))


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    docs = many(spark)
    got = mixing.mix(docs.repartition(5))
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert len(per) == 9
    for r in per:
        assert abs(r["t"] - r["g"]) <= max(2, 0.01 * r["g"])
    assert got.where("taken > 3 * size OR copies > 3").count() == 0
    again = mixing.mix(docs.repartition(2), bins=8)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_copies_are_certain_or_one_more(spark):
    got = mixing.mix(many(spark)).where("size > 0").select(
        (F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("x")).distinct().collect()
    assert {r["x"] for r in got} <= {0, 1}


def test_inclusion_follows_weights(spark):
    docs = many(spark).withColumn("weight_", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = mixing.mix(docs, weights=(1,), weight_col="weight_").where("size > 0").withColumn("even", F.col("doc_id") % 2 == 0)
    r = {x["even"]: x["c"] for x in got.groupBy("even").agg(F.avg("copies").alias("c")).collect()}
    assert 2.3 < r[True] / r[False] < 3.7


def test_odd_documents_and_empty_table(spark):
    got = mixing.mix(odd.documents(spark))
    assert got.count() == len(odd.rows())
    sized = {(i, len((t or "").split()) if t is not None and t.isascii() else None) for i, t, *_ in odd.rows()}
    sizes = {(r["doc_id"], r["size"]) for r in got.collect()}
    assert {x for x in sized if x[1] is not None} <= sizes
    assert got.where("size = 0 AND taken <> 0").count() == 0
    assert mixing.mix(odd.empty(spark)).count() == 0


def test_inclusion_differs_between_documents_of_a_source(spark):
    docs = many(spark)
    got = mixing.mix(docs, by_size=True).where("size > 0").cache()
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.sum("size").alias("s")).collect()
    for r in per:
        assert abs(r["t"] - r["g"]) <= max(2, 0.01 * r["g"])
    assert got.where("copies > 3").count() == 0
    # between none and all copies, a longer document is taken more often
    part = [r["source"] for r in per if 0.1 < r["g"] / r["s"] < 2.5 and r["source"]]
    mean = {r["long"]: r["c"] for r in got.where(F.col("source").isin(part)).groupBy((F.col("size") > 60).alias("long")).agg(
        F.avg("copies").alias("c")).collect()}
    assert mean[True] > 1.2 * mean[False]
    equal = mixing.mix(docs).where("size > 0")
    assert got.join(equal.select("doc_id", F.col("copies").alias("e")), "doc_id").where("copies <> e").count() > 100


@pytest.mark.parametrize("share", [0.2, 1.0, 1.7, 2.9, 3.0])
def test_scales_fill_the_target(spark, share):
    sizes = [(w, 10 * w + k) for w in (1, 2, 4, 9) for k in range(5)]
    total = sum(s for _, s in sizes)
    sized = spark.createDataFrame([("a", s, float(w)) for w, s in sizes] + [("b", 0, 1.0)], "source string, size long, weight double")
    goal = spark.createDataFrame([("a", total, share * total), ("b", 0, 0.0)], "source string, source_size long, target double")
    got = {r["scale_of"]: r["scale"] for r in mixing.scales(sized, goal, 3).collect()}
    assert math.isclose(sum(min(3.0, got["a"] * w) * s for w, s in sizes), share * total, rel_tol=1e-9)
    assert "b" not in got


def test_targets_and_crossings_are_worked_out_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a b c " * k, f"s{k % 2}") for k in range(1, 9)], "doc_id long, text string, source string")
    inside, stored = [], mixing.stored

    def seen(df, name, *rest):
        inside.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Window ")))
        return stored(df, name, *rest)

    monkeypatch.setattr(mixing, "stored", seen)
    assert mixing.mix(docs, by_size=True).count() == 8
    # the targets' windows are in the plan of their own table only
    assert dict(inside)["drawn"] == 1 and {"goal", "crossing"} <= dict(inside).keys()
