import hashlib
import re

import pytest

from inkstone.llm import exactdedup
from inkstone.llm.common import shared_path
from tests.llm import odd


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r[1] or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        named = [(-len(t or ""), i) for i, t, *_ in members if i is not None]
        longest = max(len(m[1] or "") for m in members)
        best = min([x for x in named if -x[0] == longest], default=(0, None))[1]
        out += [(i, best, len(members), i == best, hashlib.sha256(norm.encode()).hexdigest()) for i, *_ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"key_bits": 3}, {"capacity": 1, "max_depth": 4}, {"capacity": 2, "max_depth": 0}])
def test_odd_documents_match_brute_force(spark, options):
    got = exactdedup.exact_dedup(odd.documents(spark), **options).collect()
    assert sorted(map(tuple, got), key=repr) == brute(odd.rows())


def test_empty_table(spark):
    assert exactdedup.exact_dedup(odd.empty(spark)).count() == 0


def test_buckets_split_until_they_fit_and_are_key_ranges(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text', id) AS text")
    keys = exactdedup._keyed(docs, 64, "doc_id", "text").select("key")
    slots, depth = exactdedup.directory(keys, capacity=50, max_depth=12)
    slots = sorted(slots.collect(), key=lambda r: r["slot"])
    assert len(slots) <= 2 ** depth and max(r["depth"] for r in slots) == depth
    load = {}
    owner = {r["slot"]: r["bucket"] for r in slots}
    for r in keys.collect():
        b = owner[(r["key"] % 2 ** 64) >> (64 - depth)]
        load[b] = load.get(b, 0) + 1
    assert max(load.values()) <= 50 and sum(load.values()) == 2000
    path = shared_path(spark, "test-index")
    index = exactdedup.build_index(docs, keys, path, capacity=50, max_depth=12)
    assert index.count() == 2000
    spans = sorted((min(k), max(k)) for k in _by_bucket(index).values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def _by_bucket(index):
    out = {}
    for r in index.select("bucket", "key").collect():
        out.setdefault(r["bucket"], []).append(r["key"] % 2 ** 64)
    return out
