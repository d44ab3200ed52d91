"""Source divergence audit against brute force over every group, pair and term."""
import re
from collections import Counter, defaultdict

from inkstone.llm import divergence
from tests.llm import odd

ROWS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, least_docs, top):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, source in count:
        terms = [t for t, n in docs[lang].items() if n >= least_docs]
        totals = Counter()
        for key, c in count.items():
            if key[0] == lang:
                totals.update(c)

        def p(c):
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in terms) + 5 * len(terms)) for t in terms}  # noqa: B023

        mine, q = p(count[lang, source]), p(totals)
        pairs = [(-sum(abs(mine[t] - o[t]) for t in terms), other.encode())
                 for (le, other), c in count.items() if le == lang and other != source for o in [p(c)]]
        best = [(q[t] - mine[t], t.encode()) for t in terms if count[lang, source][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", best, top)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(items)[:most])]
    return sorted(out)


def run(df, **kw):
    return sorted(tuple(r[c] for c in ROWS) for r in divergence.audit(df, **kw).collect())


def test_equals_brute_force_on_odd_rows(spark):
    want = brute([(r[2], r[3], r[1]) for r in odd.rows()], 2, 7)
    assert {r[2] for r in want} == {"pair", "term"}
    assert run(odd.documents(spark), least_docs=2, top=7) == want


def test_language_without_kept_terms(spark):
    got = run(odd.documents(spark), least_docs=10_000)
    assert got == brute([(r[2], r[3], r[1]) for r in odd.rows()], 10_000, 50)
    assert {r[2] for r in got} == {"pair"} and {r[4] for r in got} == {0}


def test_ties_are_cut_in_utf8_order(spark):
    # 40 terms with equal counts in one source, none in the other: one value, more terms than ranks
    words = [chr(0x61 + k) * 2 for k in range(20)] + ["é", "ü", "\U0001F44D", "￦", "漢"] + [chr(0x430 + k) for k in range(15)]
    rows = [("x", "a", " ".join(words))] * 3 + [("x", "b", "only these words")] * 3 + [(None, "solo", "Ab aB")] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for top in (1, 24, 25, 50):
        assert run(df, least_docs=2, top=top) == brute(rows, 2, top)


def test_worker_hands_on_full_tables(spark, monkeypatch):
    want = run(odd.documents(spark), least_docs=2)
    batches = [b for b in odd.documents(spark).coalesce(1).selectExpr(
        "coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "cast(coalesce(text, '') AS binary) AS text").toArrow().to_batches(7)]
    whole = Counter()
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            whole[r["lang"], r["source"], r["term"]] += r["n"]
    monkeypatch.setattr(divergence, "HELD", 5)
    parts = Counter()
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            parts[r["lang"], r["source"], r["term"]] += r["n"]
    assert whole == parts and want


def test_counts_beyond_64_bits_of_product(spark):
    df = spark.range(1).selectExpr("cast(9000000000000 as bigint) AS c", "cast(70000000000001 as bigint) AS n", "cast(7 as bigint) AS v")
    got = df.select(divergence.probability(df.c, df.n, df.v).alias("p")).first()["p"]
    assert got == 1 + 10 ** 9 * (9000000000000 + 5) // (70000000000001 + 35)


def test_empty_table(spark):
    assert run(odd.empty(spark)) == []
