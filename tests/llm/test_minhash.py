import random
import re

import numpy as np
import pytest

from inkstone.llm import minhash, wordhash
from tests.llm import odd


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    ids = {}
    for i, t, *_ in rows:
        if i is not None:
            ids.setdefault(i, shingles(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(ids)
    for k, a in enumerate(keys):
        for b in keys[k + 1:]:
            x, y = ids[a], ids[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None, i is None or find(i) == i) for i, t, *_ in rows), key=repr)


def test_odd_documents_match_brute_force(spark):
    got = minhash.near_duplicates(odd.documents(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(odd.rows())


def test_empty_table(spark):
    assert minhash.near_duplicates(odd.empty(spark)).count() == 0


def family(seed, copies, size=150, edits=8):
    """A text and copies with a few words changed; copies differ more from each other than from the text."""
    rng = random.Random(seed)
    base = odd.words(rng, size).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(size)] = odd.words(rng, 1)
        out.append(" ".join(w))
    return out + [" ".join(base)]


@pytest.mark.parametrize("members", [1024, 7])
def test_a_large_family_keeps_all_links_also_in_blocks(spark, members):
    texts = family(1, 60) + family(2, 10) + family(3, 3)
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts + texts[:20]))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), members=members)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_shingle_sets_count_distinct_shingles_of_any_length():
    texts = [t or "" for _, t, *_ in odd.rows()]
    assert [len(s) for s in wordhash.shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_hashes_do_not_depend_on_batches_or_segments(monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in odd.rows()]
    together = wordhash.shingle_sets(texts)
    monkeypatch.setattr(wordhash, "SEGMENT", 64)
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(wordhash.shingle_sets([t])[0], s)


def test_half_keys_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(0)
    met = trials = 0
    for _ in range(300):
        shared = rng.integers(0, 2 ** 63, 170).astype(np.uint64)
        a, b = (np.unique(np.concatenate((shared, rng.integers(0, 2 ** 63, 15).astype(np.uint64)))) for _ in range(2))
        x, y = minhash.half_keys([a, b])
        half = x == y
        met += half[:minhash.HALVES].any() and half[minhash.HALVES:].any()
        trials += 1
    assert met >= trials - 1  # similarity 0.85: 0.9998 each


def test_bands_follow_from_the_threshold():
    assert minhash.bands(85) == (16, 5) and minhash.bands(80) == (16, 4)
    for percent in range(5, 101, 5):
        assert minhash.meets(percent / 100, *minhash.bands(percent)) >= minhash.MEET
    for bad in (0, 101):
        with pytest.raises(ValueError):
            minhash.bands(bad)


def test_other_thresholds_find_their_pairs_too(spark):
    rows, rng = [], random.Random(7)
    for k in range(30):  # pairs at 0.5 and a little more; bands made for 0.85 would miss most of them
        base = [f"w{rng.randrange(10 ** 9)}" for _ in range(154)]
        near = list(base)
        for at in range(8, 154, 16):
            near[at] = f"x{rng.randrange(10 ** 9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    want = brute(rows, percent=50)
    assert sum(kept for *_, kept in want) == 30
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def brute_rows(rows, percent=85):
    """Like brute, with every row linked by its own text, whatever other texts its doc_id has."""
    numbered = brute([(k, t) for k, (_, t) in enumerate(rows)], percent)
    least = {}
    for k, _, c, _ in numbered:
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], n, least[c], rows[k][0] == least[c]) for k, n, c, _ in numbered)


@pytest.mark.parametrize("members", [1024, 2])
def test_every_text_of_a_repeated_doc_id_keeps_its_links(spark, members):
    texts = [family(seed, 3, edits=3) for seed in range(10, 34)]
    rows = []
    for k in range(0, 24, 2):  # the smallest id of two groups, with a text of either
        rows += [(5 * k, texts[k][3]), (5 * k, texts[k + 1][3]), (5 * k, texts[k][3])]
        rows += [(5 * k + 1 + j, texts[k + j // 3][j % 3]) for j in range(6)]
    rows += [(1000, texts[0][0]), (1000, texts[5][0]), (1000, "alone"), (1001, "alone")]
    random.Random(6).shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), members=members)
    assert sorted(map(tuple, got.collect())) == brute_rows(rows)
