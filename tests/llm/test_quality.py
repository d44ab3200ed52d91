import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import quality
from tests.llm import odd

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rated = labels.select("doc_id", quality.grade_of(labels).alias("grade"))
    # the fit sees two thirds of the labels
    got = quality.classify(spark.read.parquet(f"{BIG}/documents.parquet"), rated.where("doc_id % 3 > 0"))
    return got.join(rated, "doc_id").where("doc_id % 3 = 0").toPandas()


def test_held_out_documents(scored):
    kept = scored.groupby("grade")["kept"].mean()
    assert kept[2] >= 0.97 and kept[1] <= 0.35 and kept[0] <= 0.06
    means = scored.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_tail_probabilities_follow_the_grade(scored):
    assert ((scored["p_top"] >= 0) & (scored["p_top"] <= 1)).all()
    assert ((scored["expected_grade"] >= scored["p_top"] * 2 - 1e-9) & (scored["expected_grade"] <= 2)).all()
    order = scored.sort_values("score")
    assert order["expected_grade"].is_monotonic_increasing and order["p_top"].is_monotonic_increasing


def test_thresholds_stay_in_order_and_shares_come_out():
    rng = np.random.default_rng(1)
    grade = rng.choice(4, 800, p=[0.1, 0.2, 0.3, 0.4])
    rows = [np.unique(np.concatenate((rng.integers(1000, 9000, 20), [10 + g for g in range(4) if g <= grade[k]]))).astype(np.uint32)
            for k in range(800)]
    model = quality.fit(rows, grade, np.ones(800), 4)
    assert (np.diff(model.cuts) > 0).all()
    tails = model.tails(model.score(rows))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean((tails > 0.5).sum(axis=1) == grade) > 0.95
    assert np.allclose(tails.mean(axis=0), [np.mean(grade >= k) for k in (1, 2, 3)], atol=0.05)


def test_features_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t, *_ in odd.rows()]
    for t, f in zip(texts, quality.features(texts), strict=True):
        assert np.array_equal(quality.features([t])[0], f)


def test_reruns_agree(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rated = labels.select("doc_id", quality.grade_of(labels).alias("grade"))
    a = quality.classify(docs, rated, per_grade=20).orderBy("doc_id").collect()
    b = quality.classify(docs.repartition(5), rated.repartition(3), per_grade=20).orderBy("doc_id").collect()
    assert a == b


def test_odd_documents_and_labels(spark):
    rated = spark.createDataFrame([(4, 2), (4, 0), (8, 1), (9, 2), (None, 2), (11, None), (12, 0), (999, 1), (13, 7)],
                                  "doc_id long, grade int")
    got = quality.classify(odd.documents(spark), rated)
    assert got.count() == len(odd.rows()) and got.where("score IS NULL").count() == 0
    for none in (rated.limit(0), rated.where("grade = 2")):
        alone = quality.classify(odd.documents(spark), none)
        assert alone.where("kept AND score IS NULL").count() == len(odd.rows())
    assert quality.classify(odd.empty(spark), rated).count() == 0


def test_grades_of_labels(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (None, 0), (1, None)], "quality int, toxic int")
    assert [r[0] for r in rows.select(quality.grade_of(rows)).collect()] == [0, 0, 1, 2, None, None]
    assert rows.select(F.count(quality.grade_of(rows))).first()[0] == 4


def test_thirty_labels_are_enough_for_a_clear_word(spark):
    rng = np.random.default_rng(3)
    text = lambda word: " ".join([word, *(f"w{k}" for k in rng.integers(0, 10 ** 9, 30))])
    rows = [(k, text("fine" if k % 3 else "junk")) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([(k, 2 if k % 3 else 0) for k in range(30)], "doc_id long, grade int")
    assert {r["doc_id"] for r in quality.classify(docs, rated).where("kept").collect()} == {k for k in range(90) if k % 3}


def test_without_a_telling_feature_all_documents_are_kept(spark):
    docs = spark.createDataFrame([(k, "the same text") for k in range(40)], "doc_id long, text string")
    rated = spark.createDataFrame([(k, 2 if k % 3 == 0 else 0) for k in range(30)], "doc_id long, grade int")
    assert quality.classify(docs, rated).where("kept").count() == 40


def test_fit_equals_an_independent_minimum_of_the_likelihood():
    rng = np.random.default_rng(8)
    n, words = 300, 4
    x = rng.random((n, words)) < 0.4
    latent = x @ np.array([2.0, -1.5, 1.0, -0.5]) + rng.logistic(size=n)
    grade = np.digitize(latent, [-0.5, 1.0])
    weight = rng.uniform(0.5, 2.0, n)
    rows = [np.flatnonzero(r).astype(np.uint32) + 7 for r in x]

    def loss(p):
        cuts = np.array([p[words], p[words] + np.exp(p[words + 1])])
        tail = 1 / (1 + np.exp(-(x @ p[:words])[:, None] + cuts[None, :]))
        tail = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        share = tail[at, grade] - tail[at, grade + 1]
        return -(weight / weight.sum()) @ np.log(share) + 0.5 * quality.PENALTY * (p[:words] ** 2).sum()

    # Newton steps on numeric derivatives, nothing shared with the fit
    p, h, eye = np.zeros(words + 2), 1e-4, np.eye(words + 2)
    for _ in range(25):
        grad = np.array([(loss(p + h * e) - loss(p - h * e)) / (2 * h) for e in eye])
        hess = np.array([[(loss(p + h * a + h * b) - loss(p + h * a - h * b) - loss(p - h * a + h * b) + loss(p - h * a - h * b))
                          / (4 * h * h) for b in eye] for a in eye])
        p = p - np.linalg.solve(hess + 1e-6 * eye, grad)
    model = quality.fit(rows, grade, weight, 3, least_z=0.0, steps=3000)
    assert model.known.tolist() == [7, 8, 9, 10]
    assert np.allclose(model.weights, p[:words], atol=0.02)
    assert np.allclose(model.cuts, [p[words], p[words] + np.exp(p[words + 1])], atol=0.02)


def test_a_labelled_id_that_repeats_is_one_row_of_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, f"{'fine' if k % 2 else 'junk'} " + " ".join(f"w{j}" for j in rng.integers(0, 10 ** 9, 20))) for k in range(60)]
    rows += [(4, f"another text {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rated = spark.createDataFrame([(k, 2 if k % 2 else 0) for k in range(60)], "doc_id long, grade int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda r, *a, **k: seen.append(len(r)) or fit(r, *a, **k))
    assert quality.classify(docs, rated).count() == 560
    assert seen == [60]
