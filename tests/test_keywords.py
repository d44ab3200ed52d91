"""Keyword operators: overlap ranking vs brute force, structs, bands."""


import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.operators import keywords as KW


def brute(sets, k):
    out = []
    for q, tq in sets.items():
        cand = []
        for b, tb in sets.items():
            if b == q:
                continue
            sh = len(set(tq) & set(tb))
            if sh:
                cand.append((-(sh / len(set(tq) | set(tb))), -sh, b, sh))
        for rank, c in enumerate(sorted(cand)[:k], 1):
            out.append((q, rank, c[2], c[3]))
    return sorted(out)


@pytest.mark.parametrize("subset_terms", [8, 3, 0])
def test_overlap_topk_matches_brute_force(spark, subset_terms):
    words = ["a", "b", "c", "d", "e", "f", "g"]
    # a hot term ("a") shared by most documents
    sets = {i: ["a"] + [words[(i * j) % 7] for j in range(1, 4)] for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id long, terms array<string>")
    got = KW.overlap_topk(df.withColumnRenamed("id", "query_id"), df, k=3, subset_terms=subset_terms)
    got = sorted((r.query_id, r.rank, r.id, r.shared) for r in got.collect())
    assert got == brute(sets, 3)


def test_flatten_order_caps_and_relations(spark):
    df = spark.createDataFrame([(["t1", "t2", "t3", "t4", "t5", "t6"], ["Ann", "Bob", "Cid"])],
                               "themes array<string>, ents array<string>")
    kw = df.select(KW.keyword_struct(F.col("themes"), F.col("ents")).alias("kw"))
    flat = kw.select(KW.flatten(F.col("kw")).alias("f")).first().f
    assert flat == ["theme:t1", "theme:t2", "theme:t3", "theme:t4", "theme:t5",
                    "entity:Ann", "entity:Bob", "entity:Cid"]
    rel = KW.relations(kw.withColumn("id", F.lit(1)), "kw", "id").collect()
    assert [(r.entity1, r.relation, r.entity2) for r in rel] == [("Ann", "co_occurs", "Bob"), ("Bob", "co_occurs", "Cid")]


def test_distinct_keywords_no_trim(spark):
    df = spark.createDataFrame([("b,a, a,b",)], "s string")
    assert df.select(KW.distinct_keywords(F.col("s")).alias("o")).first().o == [" a", "a", "b"]


@pytest.mark.parametrize("score,band", [(1.0, "excellent"), (0.9, "excellent"), (0.85, "high"), (0.8, "high"),
                                        (0.5, "moderate"), (0.3, "limited"), (0.0, "irrelevant"), (1.2, None)])
def test_relevance_band(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(KW.relevance_band(F.col("s")).alias("b")).first().b == band


def test_topk_terms_small(spark):
    df = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, "plum plum plum")],
                               "id long, content string")
    r = {(x.doc_id, x.rank): x.term for x in KW.topk_terms(df, k=2).collect()}
    assert r[(1, 1)] == "apple" and r[(3, 1)] == "plum"


@pytest.mark.parametrize("subset_terms", [8, 3])
def test_overlap_topk_random_zipf(spark, subset_terms):
    import random
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    weights = [1.0 / (i + 1) for i in range(40)]
    sets = {i: sorted(set(rnd.choices(vocab, weights, k=rnd.randint(1, 5)))) for i in range(150)}
    df = spark.createDataFrame(list(sets.items()), "id long, terms array<string>")
    got = KW.overlap_topk(df.withColumnRenamed("id", "query_id"), df, k=5, subset_terms=subset_terms)
    got = sorted((r.query_id, r.rank, r.id, r.shared) for r in got.collect())
    assert got == brute(sets, 5)


def test_unspaced_scripts_give_character_pairs(spark):
    df = spark.createDataFrame([(1, "民進黨今天表示 The DPP said 表示"), (2, "國民黨"), (3, None), (4, "")], "id long, content string")
    toks = {r.id: r.t for r in df.select("id", KW.tokens(F.col("content")).alias("t")).collect()}
    assert toks[1] == ["the", "dpp", "said", "民進", "進黨", "黨今", "今天", "天表", "表示", "表示"]
    assert toks[2] == ["國民", "民黨"] and not toks[3] and toks[4] == []
    top = [r.term for r in KW.topk_terms(df, k=3).filter("doc_id = 1").orderBy("rank").collect()]
    assert top[0] == "表示"


def test_counts_in_the_row_match_a_counter(spark):
    from collections import Counter
    texts = ["b a b c a b", "", "z", None]
    df = spark.createDataFrame([(i, t.split() if t is not None else None) for i, t in enumerate(texts)], "id int, t array<string>")
    for r in df.select("id", KW.counted(F.col("t")).alias("c")).collect():
        assert {x.term: x.tf for x in (r.c or [])} == dict(Counter((texts[r.id] or "").split()))


def test_no_plan_lists_pairs_of_a_hot_term(spark):
    df = spark.range(3000).selectExpr("id", "array('hot', concat('t', id % 1000)) AS terms")
    got = KW.overlap_topk(df.withColumnRenamed("id", "query_id"), df, k=2)
    assert got.count() == 6000
    first = got.filter("query_id = 5").orderBy("rank").collect()
    assert [(r.id, r.shared) for r in first] == [(1005, 2), (2005, 2)]


def test_external_extractor_states_and_json(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "prose"), (4, "noise"), (5, None)], "id long, text string")
    good = {"keywords": {"themes": ["t"], "events": [], "entities": ["E", "F"], "actions": []},
            "relations": [{"entity1": "E", "entity2": "F", "relation": "r"}]}

    def fn(texts):
        import json
        if "boom" in texts:
            raise RuntimeError("remote failure")
        return [good if t == "ok" else f"Sure:\n{json.dumps(good)} done" if t == "prose" else "none" for t in texts]

    got = {r.id: r for r in KW.extract_with(df, "text", fn, batch_size=1).collect()}
    assert {i: r.state for i, r in got.items()} == {1: "", 2: "error", 3: "", 4: "invalid", 5: "invalid"}
    assert got[3].kw == got[1].kw and got[1].kw.keywords.entities == ["E", "F"] and got[2].kw is None


def test_relations_are_not_capped_with_the_keywords(spark):
    names = ["Ann", "Bob", "Cid", "Dan", "Eve", "Fay", "Gus"]
    df = spark.createDataFrame([(1, [], names)], "id long, themes array<string>, ents array<string>")
    kw = df.select("id", KW.keyword_struct(F.col("themes"), F.col("ents")).alias("kw"))
    assert kw.first().kw.keywords.entities == names[:5]
    assert KW.relations(kw, "kw", "id").count() == 6


def test_topk_terms_sends_few_terms_and_loses_none(spark):
    rng = random.Random(5)
    words = [f"word{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(20000)]
    rows = [(k // 2 if k < 20 else k, " ".join(words[k * 50:k * 50 + rng.choice([0, 1, 3, 50])])) for k in range(400)] + [(None, "null row"), (401, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    count = {}
    per = [(i, Counter((t or "").split())) for i, t in rows]
    for _, c in per:
        for w in c:
            count[w] = count.get(w, 0) + 1
    scored = {}
    for i, c in per:
        scored.setdefault(i, []).extend((-n * math.log(len(rows) / count[w]), w) for w, n in c.items())
    want = sorted(((i, r + 1, w) for i, x in scored.items() for r, (_, w) in enumerate(sorted(x)[:5])), key=repr)
    for common in (1, 7, 100_000):
        got = KW.topk_terms(docs, "id", "text", 5, common=common).select("doc_id", "rank", "term").collect()
        assert sorted(map(tuple, got), key=repr) == want
    # with df at hand only a few terms of a row go on
    counts = KW.term_counts(docs, "id", "text")
    names = sorted(count, key=lambda w: -count[w])
    sent = KW._candidates(counts, names, [count[w] for w in names], len(rows), 5).count()
    assert sent < 0.5 * counts.select(F.sum(F.size("terms"))).first()[0]
    assert KW.topk_terms(docs.limit(0), "id", "text", 5).count() == 0
