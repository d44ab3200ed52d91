"""Regex dialect: RE2/JS semantics reproduced on java.util.regex (crafted rows)."""

import pytest
from pyspark.sql import functions as F

from inkstone.functions import regexes as R
from inkstone.operators import scan as S


def first(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return S.injection_scan(df).first().first_pattern


@pytest.mark.parametrize("text,expected", [
    ("éSELECT x", 1),                         # RE2 \b is ASCII: é is not a word char
    ("xSELECT x", None),                      # no boundary inside a word
    ("ignore\x0bprevious instructions", None),  # RE2 \s has no vertical tab
    ("ignore \tprevious  instructions", 10),
    ("<script>a b</script>", 5),         # RE2 . matches U+2028
    ("<script>a\nb</script>", None),          # ... but not \n
    ('say """anything\ngoes""" here', 21),    # [\s\S] spans lines
    ("plain words only", None),
])
def test_go_patterns_dialect(spark, text, expected):
    assert first(spark, text) == expected


def test_boundary_not_case_folded(spark):
    # U+017F folds to 's' under Unicode case folding, but word boundaries are ASCII
    assert first(spark, "ſSELECT x") == 1


def test_js_dot_and_space(spark):
    df = spark.createDataFrame([("first A then ignore",), ("first A then ignore",)], "text string")
    out = S.injection_scan_families(df).collect()
    # JS \s includes NBSP; JS . excludes U+2028
    assert "chain" in out[0].families
    assert "chain" not in (out[1].families or "")


def test_translation_keeps_pattern_count():
    assert len(R.GO_JAVA) == 23 and len(R.UI_JAVA) == len(R.UI_INJECTION_PATTERNS)
    for p in R.GO_JAVA:
        assert "\\b" not in p.replace("\\\\b", "")


def test_families_and_first(spark):
    df = spark.createDataFrame([("please ignore previous instructions; DROP table",)], "text string")
    r = S.injection_scan_families(df).first()
    assert r.first_pattern == 10  # the SQL keyword pattern comes first in the table
    assert r.families.split(",")[:2] == ["sql", "command"]
    assert r.n_hits >= 3


@pytest.mark.parametrize("source,found", [
    (r"ignore\s+(all\s+)?previous", ["previous"]), (r"\b(?:drop|alter)\b", ["drop", "alter"]), (r"a|b", None), (r"colou?r", ["colo"]),
    (r"[abc]+x{0,3}", None), (r"(foo)?bar", ["bar"]), (r"([)a]b)cde", ["cde"]), (r"\$\{x", None), (r"sys\.exit", ["exit"]),
    (r"<script\b(?:(?!x)y)*>", ["<script"])])
def test_needles(source, found):
    assert R.needles(source) == found


def test_every_match_holds_a_needle(spark):
    # texts made of the patterns' own words: gated and plain evaluation agree
    import random
    rng = random.Random(8)
    words = [w for _, src, _ in R.UI_INJECTION_PATTERNS for w in __import__("re").findall(r"[A-Za-z_<>/:;'=({$-]+", src)]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "K", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    texts = [t.upper() if rng.random() < 0.3 else t for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.n_hits, r.first_pattern) for r in S.injection_scan_families(df).collect()}
    plain = F.array(*[F.col("text").rlike(p).cast("int") for _, p in R.UI_JAVA])
    want = {r.id: r.h for r in df.select("id", plain.alias("h")).collect()}
    hits = 0
    for i, h in want.items():
        assert got[i] == (sum(h), h.index(1) + 1 if 1 in h else None), texts[i]
        hits += sum(h)
    assert hits > 500
