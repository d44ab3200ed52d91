"""Vector operators against numpy brute force on the fixture embeddings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions import vectors as V
from inkstone.operators import knn as K
from inkstone.operators import lists as L
from inkstone.operators import vector_agg as VA
from inkstone.sources import adapters as A


def _np_dist(metric, q, c):
    if metric == "l2":
        return np.sqrt(((c - q) ** 2).sum(1))
    if metric == "inner_product":
        return -(c @ q)
    return 1 - (c @ q) / (np.linalg.norm(c, axis=1) * np.linalg.norm(q))


@pytest.fixture(scope="module")
def vecs(spark, sf):
    v = A.vectors(spark, sf)
    pdf = v.toPandas()
    return v, pdf


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_knn_literal_matches_numpy(vecs, metric):
    v, pdf = vecs
    m0 = pdf[pdf.model_id == 0]
    c = np.stack(m0.vector.map(lambda a: np.asarray(a, dtype=np.float64)))
    q = c[3] * 0.5 + 0.1
    d = _np_dist(metric, q, c)
    order = np.lexsort((m0.id.to_numpy(), d))[:7]
    got = K.knn(v, q.tolist(), 7, metric, model_id=0).collect()
    assert [r.id for r in got] == m0.id.to_numpy()[order].tolist()
    assert np.allclose([r.distance for r in got], d[order], atol=1e-9)


@pytest.mark.parametrize("rows", [4096, 37])
def test_knn_join_matches_brute_force(spark, vecs, rows):
    v, pdf = vecs
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    got = K.knn_join(q, v, 4, "cosine", exclude_self=True, block_rows=rows).toPandas()
    exp = []
    for m, g in pdf.groupby("model_id"):
        c = np.stack(g.vector.map(lambda a: np.asarray(a, dtype=np.float64)))
        ids = g.id.to_numpy()
        for i, qid in enumerate(ids):
            d = _np_dist("cosine", c[i], c)
            d[i] = np.inf
            for rank, j in enumerate(np.lexsort((ids, d))[:4], 1):
                exp.append((qid, rank, ids[j]))
    got_t = sorted(zip(got.query_id, got["rank"], got.id))
    assert got_t == sorted(exp)


def test_knn_approx_recall(spark, vecs):
    v, _ = vecs
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    exact = K.knn_join(q, v, 5, "cosine", exclude_self=True)
    approx = K.knn_approx(q, v, 5, "cosine", exclude_self=True)
    r = K.recall_at_k(approx, exact).first()
    assert r.n == exact.count() and r.recall >= 0.9
    # approximate results are real neighbours with exact distances
    assert approx.join(exact, ["query_id", "id"]).filter(
        F.abs(approx["distance"] - exact["distance"]) > 1e-9).count() == 0


def test_mean_by_and_avg_embedding(spark, vecs):
    v, pdf = vecs
    got = {(r.article_id, r.model_id): r.avg_vector for r in VA.mean_by(v, ["article_id", "model_id"]).collect()}
    for (a, m), g in pdf.groupby(["article_id", "model_id"]):
        exp = np.mean(np.stack(g.vector.map(lambda x: np.asarray(x, dtype=np.float64))), axis=0)
        assert np.allclose(got[(a, m)], exp, atol=1e-9)
    req = spark.createDataFrame([(0, 0), (10**9, 0)], "article_id long, model_id int")
    out = {r.article_id: r.avg_vector for r in VA.avg_embedding(req, v).collect()}
    assert out[10**9] is None


def test_distance_columns_null_and_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])],
                               "a array<double>, b array<double>")
    r = df.select(V.cosine_distance("a", "b").alias("c"), V.l2("a", "b").alias("l"),
                  V.is_valid(F.col("a")).alias("v")).collect()
    assert np.isnan(r[0].c) and r[1].l is None and not r[2].v
    u = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>").select(V.unit(F.col("a")).alias("u"))
    us = [r.u for r in u.collect()]
    assert us[0] == [0.6, 0.8] and all(np.isnan(us[1]))


def test_knn_join_smaller_corpus_and_blocks(spark, vecs):
    v, pdf = vecs
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    small = v.filter(F.col("id") % 7 == 0)
    got = K.knn_join(q, small, 3, "l2", exclude_self=True).toPandas()
    blocks = K.knn_join(q, small, 3, "l2", exclude_self=True, block_rows=10).toPandas()
    key = lambda df: sorted(zip(df.query_id, df["rank"], df.id))
    assert key(got) == key(blocks)
    cp = pdf[pdf.id % 7 == 0]
    exp = []
    for _, row in pdf.iterrows():
        c = cp[(cp.model_id == row.model_id) & (cp.id != row.id)]
        cm = np.stack(c.vector.map(lambda a: np.asarray(a, dtype=np.float64)))
        d = np.sqrt(((cm - np.asarray(row.vector, dtype=np.float64)) ** 2).sum(1))
        exp += [(row.id, r, c.id.to_numpy()[j]) for r, j in enumerate(np.lexsort((c.id.to_numpy(), d))[:3], 1)]
    assert key(got) == sorted(exp)


def test_knn_join_uneven_batches_many_queries_hot_key_and_mixed_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i, 0 if i % 10 else 1, rng.normal(size=6).tolist()) for i in range(3000)]
    rows += [(5000, 5000, 0, [0.0] * 6), (5001, 5001, 0, [1.0, 2.0]), (5002, 5002, 0, []), (5003, 5003, 0, None),
             (5004, 5004, 9, [1.0] * 6), (5005, 5005, 0, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, article_id long, model_id int, vector array<float>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
        got = K.knn_join(q, v, 3, "cosine", exclude_self=True, block_rows=700).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.id))
    for i, _, m, x in rows[::97] + rows[-6:]:
        x = None if x is None else np.asarray(x, dtype=np.float32).astype(float)
        cand = [(j, np.asarray(y, dtype=np.float32).astype(float)) for j, _, n, y in rows
                if n == m and j != i and y and x is not None and len(y) == len(x) and len(x)]
        with np.errstate(invalid="ignore", divide="ignore"):
            d = [(np.isnan(e), 0.0 if np.isnan(e) else e, j) for j, y in cand
                 for e in [1 - (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))]]
        assert sorted(by.get(i, [])) == [(r, j) for r, (_, _, j) in enumerate(sorted(d)[:3], 1)], i
    good, bad = K.dimension_split(v, 6)
    assert good.count() == 3002 and {r.id for r in bad.collect()} == {5001, 5002, 5003, 5005}


def test_knn_keeps_infinite_distances_and_drops_self(spark):
    v = spark.createDataFrame([(1, 1, 0, [1e200]), (2, 2, 0, [-1e200]), (3, 3, 0, [float("inf")])],
                              "id long, article_id long, model_id int, vector array<double>")
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    got = {(r.query_id, r["rank"]): r.id for r in K.knn_join(q, v, 3, "l2", exclude_self=True).collect()}
    assert got[(1, 1)] == 2 and got[(1, 2)] == 3 and (1, 3) not in got


def test_knn_per_key_jvm_path_matches_kernel(spark, vecs):
    v, _ = vecs
    cent = VA.mean_by(v, ["model_id"], out_col="query_vector").drop("n")
    jvm = {(r.model_id, r["rank"]): (r.id, round(r.distance, 9))
           for r in K.knn_per_key(v, cent, 6, "cosine").collect()}
    ker = {(r.query_id, r["rank"]): (r.id, round(r.distance, 9))
           for r in K.knn_join(cent.withColumn("query_id", F.col("model_id").cast("long")), v, 6, "cosine").collect()}
    assert jvm == ker and len(jvm) == 12


def _clustered(spark, rows_per, clusters, dim=8, seed=5):
    """One hot cluster with half of the rows, the rest evenly small, far apart."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim)) * 10
    label = np.concatenate([np.zeros(rows_per * clusters // 2, int), rng.integers(1, clusters, rows_per * clusters // 2)])
    x = centers[label] + rng.normal(size=(len(label), dim)) * 0.3
    rows = [(i, i, 0, v.tolist()) for i, v in enumerate(x)]
    rows += [(90_000, 1, 0, [0.0] * dim), (90_001, 1, 0, [float("nan")] * dim), (90_002, 1, 0, [1e200] * dim)]
    return x, spark.createDataFrame(rows, "id long, article_id long, model_id int, vector array<double>").repartition(4)


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_knn_join_by_lists_equals_brute_force(spark, metric):
    x, v = _clustered(spark, 40, 30)
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    qs, cs = K._sides(q, v, "query_id", "query_vector", "model_id", "vector")
    index = L.build(cs, metric, 4, 60, 60, exact=True)
    if metric != "inner_product":
        assert len(index[0, 8].centers) > 20
    got = K.knn_join(q, v, 4, metric, exclude_self=True, block_rows=60).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.id))
    whole = {r.id: np.asarray(r.vector) for r in v.collect()}
    ids = np.array(sorted(whole))
    c = np.stack([whole[i] for i in ids])
    for i in [*range(0, len(x), 11), 90_000, 90_001, 90_002]:
        with np.errstate(all="ignore"):
            d = K._exact(metric, whole[i][None, :], c)
        nan = np.isnan(d)
        order = np.lexsort((ids, np.where(nan, 0.0, d), nan, ids == i))[:4]
        assert sorted(by[i]) == [(n + 1, ids[j]) for n, j in enumerate(order)], i


def test_lists_spare_most_block_pairs_of_clustered_vectors_and_split_a_hot_list(spark):
    x, v = _clustered(spark, 40, 30)
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    qs, cs = K._sides(q, v, "query_id", "query_vector", "model_id", "vector")
    index = L.build(cs, "l2", 5, 60, 60, exact=True)
    assigned = L.assign(cs, index, "l2")
    L.measure(assigned, index, 5)
    sizes = K.list_sizes(L.route(qs, index, "l2", 4, exact=True, spare=1), assigned).collect()
    pairs = sum(r["n_queries"] * r["n_rows"] for r in sizes)
    assert pairs < 0.4 * len(x) ** 2  # the hot cluster alone is a quarter
    assert max(r["n_rows"] for r in sizes) >= 60  # dealt into several blocks
    # vectors without clusters are searched whole
    flat = spark.createDataFrame([(i, i, 0, r.tolist()) for i, r in enumerate(np.random.default_rng(1).normal(size=(900, 64)))],
                                 "id long, article_id long, model_id int, vector array<double>")
    _, fs = K._sides(q, flat, "query_id", "query_vector", "model_id", "vector")
    assert L.build(fs, "cosine", 5, 60, 60, exact=True) == {}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_approx_on_clusters_finds_nearly_all_for_few_pairs(spark, metric):
    x, v = _clustered(spark, 60, 30)
    v = v.where("id < 90000")
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    exact = K.knn_join(q, v, 5, metric, exclude_self=True)
    found = K.knn_approx(q, v, 5, metric, exclude_self=True, block_rows=300).cache()
    assert K.recall_at_k(found, exact).first().recall >= 0.9
    work = found.where("rank = 1").agg(F.sum("scored")).first()[0]
    assert work <= 0.2 * len(x) ** 2
    assert found.groupBy("query_id").count().where("count <> 5").count() == 0


def test_knn_approx_odd_rows(spark):
    rows = [(i, i, i % 3, [float(i % 7), float(i), 1.0]) for i in range(300)]
    rows += [(900, 1, 0, [0.0] * 3), (901, 1, 0, None), (902, 1, 0, []), (903, 1, 7, [1.0, 2.0, 3.0]), (904, 1, None, [1.0] * 3),
             (905, 1, 0, [float("nan")] * 3), (906, 1, 0, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, article_id long, model_id int, vector array<double>").repartition(3)
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    got = K.knn_approx(q, v, 3, "cosine", exclude_self=True).collect()
    assert {r.query_id for r in got} >= set(range(300)) and not {901, 902, 904} & {r.query_id for r in got}
    assert all(r.id < 900 for r in got if r.query_id < 300)
    assert K.knn_approx(q.limit(0), v, 3, "cosine").count() == 0
    assert K.knn_approx(q, v.limit(0), 3, "cosine").count() == 0


def test_blocks_of_a_key_do_not_grow_in_number_with_its_rows():
    assert [L.block_width(n, 64, 4096) for n in (10, 40_000, 80_000, 10 ** 9)] == [4096, 5000, 10_000, 125_000]
    assert L.block_width(10 ** 6, 4000, 4096) == 4096  # long vectors: what a task may hold comes first


def test_block_join_sends_a_row_to_few_blocks(spark):
    def side(name):
        return spark.range(2000).select(F.col("id").alias(name), F.lit(0).alias("key"), F.lit(1).alias("dim"), F.lit(-1).alias("grp"),
                                        F.lit(-1).alias("list"), F.col("id").alias("article_id"), F.array(F.lit(1.0)).alias("vector"))

    def run(left, right):
        return pd.DataFrame({"a": [len(left)], "b": [len(right)]})

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    got = K._block_join(side("query_id").drop("list", "article_id"), side("id"), run, schema, 10).collect()
    assert sum(r["a"] * r["b"] for r in got) == 2000 ** 2
    assert sum(r["a"] for r in got) == sum(r["b"] for r in got) == 8 * 2000


def test_smallest_is_the_whole_order(spark):
    rng = np.random.default_rng(3)
    for top in (3, 50, 10 ** 6):  # many ties, some, none
        d = rng.integers(0, top, (40, 300)).astype(float)
        d[rng.random(d.shape) < 0.1] = np.nan
        d[rng.random(d.shape) < 0.02] = np.inf
        d[0] = np.nan
        out, ids = rng.random(d.shape) < 0.05, rng.permutation(300)
        nan = np.isnan(d)
        want = np.lexsort((np.broadcast_to(ids, d.shape), np.where(nan, 0.0, d), nan, out), axis=1)[:, :7]
        assert (K._smallest(d, np.broadcast_to(ids, d.shape), out, 7) == want).all()


def test_knn_approx_is_fitted_on_neighbours_in_the_whole_key(spark, monkeypatch):
    """With neighbours of the sample alone the codes let through a share of the pairs that does not fall with the rows."""
    monkeypatch.setattr(L, "SAMPLE_ROWS", 400)
    monkeypatch.setattr(L, "FIT_QUERIES", 100)
    x = np.random.default_rng(2).normal(size=(8000, 16))
    v = spark.createDataFrame([(i, i, 0, r.tolist()) for i, r in enumerate(x)],
                              "id long, article_id long, model_id int, vector array<double>").repartition(4)
    q = v.select(F.col("id").alias("query_id"), "model_id", F.col("vector").alias("query_vector"))
    _, c = K._sides(q, v, "query_id", "query_vector", "model_id", "vector")
    index = L.build(c, "cosine", 5, 64, 4096, exact=False)[0, 16]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    some = np.argsort(u[:300] @ u.T, axis=1)[:, -6:-1]
    apart = np.bitwise_count(L.codes(u[:300], 7)[:, None] ^ L.codes(u, 7)[some]).sum(axis=2)
    assert abs(float((apart <= index.bits).mean()) - L.found_share("apart")) < 0.02  # 1.00 when fitted on the sample
    found = K.knn_approx(q, v, 5, "cosine", exclude_self=True).cache()
    assert K.recall_at_k(found, K.knn_join(q, v, 5, "cosine", exclude_self=True)).first().recall >= 0.9
    assert found.groupBy("query_id").count().where("count <> 5").count() == 0


def test_probed_lists_hold_enough_rows():
    centers = np.eye(4)
    lists = L.Lists(centers, 1, 0, 0, np.zeros(4, np.int32))
    lists.rows[:] = [2, 0, 3, 9]
    near = centers * 0.9 + np.array([0.04, 0.03, 0.02, 0.01])
    assert lists.probed("l2", near, 1).sum(axis=1).tolist() == [1, 2, 1, 1]
    assert lists.probed("l2", near, 5).tolist()[0] == [True, True, True, False]
    assert lists.probed("l2", near, 100).all()


def test_lists_of_too_few_near_codes_still_give_every_query_its_k():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(400, 8))
    q = rng.normal(size=(90, 8))
    home = np.sort(rng.integers(0, 12, 400))
    lists = L.Lists(rng.normal(size=(12, 8)), 12, 0, 0, np.zeros(12, np.int32))  # no code is near enough
    lists.rows[:] = np.bincount(home, minlength=12)
    cq, cc = L.codes(q, 7), L.codes(c, 7)
    i, j, d, scored = K._search_lists(lists, "l2", 3, 0, np.arange(90), q, cq, np.arange(400), c, cc, home)
    assert np.bincount(i, minlength=90).tolist() == [3] * 90 and (scored <= 9).all()
    assert np.allclose(d, np.sqrt(((q[i] - c[j]) ** 2).sum(axis=1)))
    # the row with the nearest code is among those scored, so no found row is farther than it
    first = L.differing(L.heads_of(cq), L.heads_of(cc)).argmin(axis=1)
    assert (d[np.flatnonzero(np.r_[True, i[1:] != i[:-1]])] <= np.sqrt(((q - c[first]) ** 2).sum(axis=1)) + 1e-9).all()


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_block_topk_equals_brute_force_and_scores_few_pairs(monkeypatch, metric, scale):
    monkeypatch.setattr(K, "_TILE", (256, 512))
    pairs = []
    exact = K._pair_distances
    monkeypatch.setattr(K, "_pair_distances", lambda m, q, c, i, j: (pairs.append(len(i)), exact(m, q, c, i, j))[1])
    rng = np.random.default_rng(1)
    c = rng.normal(size=(6000, 16)) * scale
    c[rng.integers(0, 6000, 1500)] = c[5]  # a vector that many rows have
    c[7], c[8], c[9], c[10], c[11] = 0, np.nan, 1e200, np.inf, 1e-180
    c[20:2000] += (rng.random((1980, 1)) < 0.1) * 1e6
    cid = np.arange(6000)
    cid[100] = 99
    q, qid = np.concatenate([c[:120], c[-200:], rng.normal(size=(280, 16)) * scale]), np.r_[:120, 5800:6000, 10_000:10_280]
    got = K._block_topk(5, metric, True)(pd.DataFrame({"query_id": qid, "vector": list(q)}),
                                         pd.DataFrame({"id": cid, "article_id": -cid, "vector": list(c)}))
    assert (got["article_id"] == -got["id"]).all()
    assert sum(pairs) < 0.05 * len(q) * len(c)
    got = {i: g for i, g in got.groupby("query_id")}
    for n, i in enumerate(qid):
        with np.errstate(all="ignore"):
            d = K._exact(metric, q[n][None], c)
        nan = np.isnan(d)
        order = np.lexsort((cid, np.where(nan, 0.0, d), nan, cid == i))[:5]
        assert got[i]["id"].tolist() == cid[order].tolist(), (metric, i)
        assert np.allclose(got[i]["distance"], d[order], rtol=0, atol=0, equal_nan=True)
