"""The pipeline against a brute-force version, stage by stage, and on odd tables."""
import hashlib
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkstone.llm import mixing, quality
from tests.llm import odd
from tests.llm.test_minhash import brute as near_brute

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).cache())
    return out


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = quality.classify(stages[0], labels.select("doc_id", quality.grade_of(labels).alias("grade"))).where("kept")
    assert {r[0] for r in rows(stages[1])} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = labels.where("quality = 1 AND toxic = 0").join(stages[1], "doc_id", "left_anti").count()
    assert good <= 0.03 * labels.count()


def test_exact_and_near_stages_keep_one_document_of_each_group(stages):
    best = {}
    for r in rows(stages[1]):
        norm = re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "")
        best[norm] = min(best.get(norm, (1, 0)), (-len(r[1] or ""), r[0]))
    assert {r[0] for r in rows(stages[2])} == {i for _, i in best.values()}
    want = {i for i, _, _, kept in near_brute(rows(stages[2])) if kept}
    assert {r[0] for r in rows(stages[3])} == want


def test_mix_and_encoding_match_sql_and_library(stages):
    con = duckdb.connect()
    con.register("documents", stages[3].select(*COLUMNS).toArrow())
    taken = {i: t // s for i, s, _, _, t in con.execute(mixing.SQL).fetchall() if t}
    got = {}
    for r in rows(stages[4]):
        got[r[0]] = got.get(r[0], 0) + 1
    assert got == taken
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in rows(stages[4]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)


def test_stages_return_the_columns_of_documents(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_odd_and_empty_tables(spark, number):
    stage = corpus_pipeline.STAGES[number][1]
    docs = odd.documents(spark)
    got = stage(spark, docs, SMALL)
    assert stage(spark, odd.empty(spark), SMALL).count() == 0
    if number < 4:
        assert got.columns == docs.columns
        ids = {r[0] for r in got.select("doc_id").collect()}
        assert ids <= {r[0] for r in odd.rows()}
        if number == 1:  # of equal texts the longest stays
            assert 6 in ids and 4 not in ids and 5 not in ids
        elif number == 2:  # of linked documents the smallest id
            assert 4 in ids and 5 not in ids and 7 not in ids
        assert got.where(F.col("text").isNotNull()).count() > 0
    else:
        assert got.count() == len(odd.rows())


def test_two_equal_rows_of_one_id_leave_one(spark):
    text = odd.words(__import__("random").Random(5), 80)
    near = text.split()
    near[40] = "changed"
    other = "quite another text about something else altogether"
    rows = [(9, text), (9, text), (9, text.replace(" ", "  ")), (3, other), (9, other), (None, text), (12, " ".join(near)),
            (None, None), (None, ""), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_stage(spark, df.repartition(3), SMALL)
    got = sorted(((r["doc_id"], r["text"]) for r in exact.collect()), key=repr)
    # of equal texts the longest, then the smallest id: once, though id 9 has two texts and two equal rows
    assert got == sorted([(9, text.replace(" ", "  ")), (3, other), (12, " ".join(near)), (7, "")], key=repr)
    left = corpus_pipeline.near_stage(spark, df.repartition(3), SMALL).collect()
    assert sorted(r["doc_id"] for r in left if r["text"] and r["text"] != other) == [9]
    assert sum(r["text"] == other for r in left) == 1


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_columns_with_any_names(spark, number):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).withColumns(
        {"a.b": F.lit(1), "row": F.lit("x"), "row_": F.lit(2), "c`d": F.lit("y"), "taken_id": F.lit(3)})
    got = corpus_pipeline.STAGES[number][1](spark, docs, SMALL)
    assert got.count() > 0
    if number < 4:
        assert got.columns == docs.columns


def test_every_stage_lets_go_of_earlier_work_first(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", calls.append)
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.exact_stage(spark, docs, SMALL).count() == 1
    assert len(calls) == 1 and all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
