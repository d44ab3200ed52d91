"""Near-duplicates by MinHash with tensored banding.

Two collections of ``HALVES`` short keys (``ROWS`` minhashes each) are computed
per text; the tables are all pairs of one key from either collection.  So
``HALVES ** 2`` tables need only ``2 * HALVES * ROWS`` minhashes.  Texts that
agree on both halves of any table are candidates.  Halves and rows follow from
the threshold (``bands``): a pair at the threshold meets in some table with
probability ``MEET`` at least.  At 0.85 these are 16 halves of 5 rows (0.9998,
and 1 - 1e-6 for a pair at 0.9), at 0.8 16 halves of 4 rows (0.9996); most
groups hold together by more than one link.

The work is kept near the input's size, whatever the groups:

* equal shingle sets collapse to one class first (two 64-bit set digests and
  the size), so copies never meet each other; classes have numbers of their own;
* a half key that no other class has cannot be part of a match; only classes
  with a shared key in both collections form table keys;
* a table entry is a star: members point at the smallest id, counts and minima
  combine before the shuffle, no pairs are listed;
* each class's text then travels once to its candidate cluster, where one task
  compares full shingle sets: an inverted index of the rarest shingles (a pair
  at the threshold must share one of them) gives the pairs that are verified,
  and pairs already connected are skipped;
* clusters beyond ``MEMBERS`` classes or ``SHINGLES`` shingles are dealt into
  blocks, and every pair of blocks is a task of its own: same links, bounded memory.

Edge cases: a null or empty text, and one without words, has an empty set and
is linked with nothing; a document with a null doc_id is linked with nothing
and kept; rows that repeat a doc_id belong to the same class or link like any
others, each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import wordhash
from inkstone.llm.common import arrow_batches, components, stored, texts

#: Halves of each collection, at least.
HALVES = 16
#: Probability with which a pair at the threshold meets in some table, at least.
MEET = 0.9995
#: Similarity at which texts are linked, in percent: 100 * shared >= PERCENT * union.
PERCENT = 85
#: Bounds of one verification task; larger clusters are dealt into blocks.
MEMBERS = 1024
SHINGLES = 2_000_000

_U = np.uint64
_SKETCH = "doc_id long, h long, n long, s1 long, s2 long, halves array<long>"


def meets(similarity: float, halves: int, rows: int) -> float:
    """Probability that two sets agree on a half of either collection."""
    return (1 - (1 - similarity ** rows) ** halves) ** 2


def bands(percent: int = PERCENT) -> tuple[int, int]:
    """(halves, rows) for a threshold: the fewest halves, and the most rows (8 at most) that still meet often enough."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be in 1 .. 100, not {percent}")
    halves = HALVES
    while meets(percent / 100, halves, 1) < MEET:
        halves *= 2
    return halves, max(r for r in range(1, 9) if meets(percent / 100, halves, r) >= MEET)


def half_keys(sets: list[np.ndarray], halves: int = HALVES, rows: int = bands()[1]) -> np.ndarray:
    """(len(sets), 2 * halves) keys: first collection, then second; sets must not be empty."""
    mult = wordhash.stream(2 * halves * rows, 11) | _U(1)
    add = wordhash.stream(2 * halves * rows, 12)
    out = np.empty((len(sets), 2 * halves), _U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):  # a quarter million shingles at a time: the numbers stay in the cache
            stop, total = at + 1, len(sets[at])
            while stop < len(sets) and total + len(sets[stop]) <= 1 << 18:
                total += len(sets[stop])
                stop += 1
            x = np.concatenate(sets[at:stop])
            begin = np.cumsum([0] + [len(s) for s in sets[at:stop - 1]])
            for k in range(2 * halves):
                key = np.full(stop - at, k, _U)
                for r in range(k * rows, k * rows + rows):
                    least = np.minimum.reduceat((x * mult[r] + add[r]) >> _U(32), begin)
                    key = wordhash.mix(key * _U(0x9E3779B97F4A7C15) + least)
                out[at:stop, k] = key
            at = stop
    return out


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text hash, set size, set digest and half keys (for links at ``percent``) of (doc_id, h, text)."""
    halves_, rows_ = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = wordhash.shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = half_keys([sets[k] for k in full], halves_, rows_).view(np.int64)
            halves: list = [None] * len(sets)
            for row, k in enumerate(full):
                halves[k] = keys[row]
            with np.errstate(over="ignore"):
                s1 = [int(np.add.reduce(wordhash.mix(s), dtype=_U).astype(np.int64)) for s in sets]
                s2 = [int(np.add.reduce(wordhash.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(halves, pa.list_(pa.int64()))],
                ["doc_id", "h", "n", "s1", "s2", "halves"])

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, _SKETCH)


def candidate_links(classes: DataFrame, n_halves: int = HALVES) -> DataFrame:
    """(src, dst) star edges over all table entries with two classes or more; classes: (cid, 2 * n_halves keys)."""
    half = classes.select("cid", F.posexplode("halves").alias("k", "v"))
    shared = half.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k", "v")
    useful = half.join(shared, ["k", "v"]).groupBy("cid").agg(F.collect_list(F.struct("k", "v")).alias("keys"))
    first = F.filter("keys", lambda x: x["k"] < n_halves)
    second = F.filter("keys", lambda x: x["k"] >= n_halves)
    table = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(
        a["k"], a["v"], b["k"], b["v"]))))
    entry = useful.select("cid", F.explode(table).alias("t"))
    entry = stored(entry, "tables")
    least = entry.groupBy("t").agg(F.min("cid").alias("dst"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "dst")
    return entry.join(least, "t").where("cid <> dst").select(F.col("cid").alias("src"), "dst").distinct()


def _linked(ids: list[int], part: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smallest id of its component) for ids that are linked; if parts differ, only pairs across parts count."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    whole = np.concatenate(sets)
    token, rank, seen = np.unique(whole, return_inverse=True, return_counts=True)
    order = np.argsort(seen, kind="stable")  # rarest first
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    rank = place[rank]
    rare = np.sort(seen)
    ranked, pre_token, pre_doc, at = [], [], [], 0
    for k, s in enumerate(sets):
        mine = np.sort(rank[at:at + len(s)])
        at += len(s)
        ranked.append(mine)
        # a partner shares at least ceil(percent * n / 100) of the n, so one of the first n - that + 1
        lead = mine[:len(mine) - -(-percent * len(mine) // 100) + 1]
        lead = lead[rare[lead] > 1]
        pre_token.append(lead)
        pre_doc.append(np.full(len(lead), k))
    tokens, owners = np.concatenate(pre_token), np.concatenate(pre_doc)
    by = np.lexsort((owners, tokens))
    tokens, owners = tokens[by], owners[by]
    cuts = np.flatnonzero(np.diff(tokens)) + 1
    across = len(set(part)) > 1
    tried: set[tuple[int, int]] = set()
    for group in np.split(owners, cuts):
        if len(group) < 2:
            continue
        group = group.tolist()
        if len({find(x) for x in group}) == 1:
            continue
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (across and part[a] == part[b]) or find(a) == find(b) or (a, b) in tried:
                    continue
                tried.add((a, b))
                x, y = ranked[a], ranked[b]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    ra, rb = find(a), find(b)
                    if ids[ra] < ids[rb]:
                        root[rb] = ra
                    else:
                        root[ra] = rb
    return [(ids[k], ids[find(k)]) for k in range(len(ids)) if find(k) != k]


def verified_links(docs: DataFrame, clusters: DataFrame, percent: int = PERCENT, members: int = MEMBERS,
                   shingles: int = SHINGLES) -> DataFrame:
    """(src, dst) links confirmed on full shingle sets.

    docs: (doc_id, h, text); clusters: (cid, doc_id, h, n, cluster), where doc_id and h name a text of the class.
    Links that follow from others of the same task are left out.
    """
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    blocks = F.ceil(F.greatest(F.col("c") / members, F.col("w") / shingles)).cast("int")
    dealt = clusters.select("cid", "doc_id", "h", "cluster").join(size.select("cluster", blocks.alias("blocks")), "cluster")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # a shuffle join at every size: the classes grow with the input, a broadcast of them would stop working
    text = docs.join(dealt.hint("merge"), ["doc_id", "h"]).select(
        "doc_id", "h", "cid", "text", "cluster", "blocks", "block")
    text = text.dropDuplicates(["doc_id", "h"]).drop("doc_id", "h")  # rows that repeat both doc_id and text
    met = text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "cid", "text")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = wordhash.shingle_sets([t.encode() for t in pdf["text"]])
        found = _linked(pdf["cid"].tolist(), pdf["block"].tolist(), sets, percent)
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return met.groupBy("cluster", "a", "b").applyInPandas(verify, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    members: int = MEMBERS, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    plain = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    sketch = stored(sketches(plain, percent), "sketches")
    known = sketch.where("n > 0 AND doc_id IS NOT NULL")
    # a class is named by a number: its smallest doc_id may carry another text, of another class
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min_by("h", "doc_id").alias("h"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    row = ["doc_id", "h", "n", "s1", "s2"]
    keyed = known.join(classes, row).dropDuplicates(row).select("cid", "halves")
    clusters = components(candidate_links(keyed, bands(percent)[0])).withColumnRenamed("id", "cid")
    clusters = clusters.join(classes, "cid").groupBy("cid").agg(
        F.min("component").alias("cluster"), *[F.max(c).alias(c) for c in ("doc_id", "h", "n")])
    found = components(verified_links(plain, stored(clusters, "clusters"), percent, members, shingles))
    found = found.withColumnRenamed("id", "cid").join(classes.select("cid", "doc_id"), "cid")
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = found.join(least, "component").select("cid", "least")
    named = classes.join(found, "cid", "left").select("n", "s1", "s2", F.coalesce("least", "doc_id").alias("component"))
    out = sketch.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


#: Brute force in DuckDB SQL: all pairs that share a shingle.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM size UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.c),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id,
       w.doc_id = coalesce(c, w.doc_id) AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN comp ON comp.doc_id = w.doc_id
"""
