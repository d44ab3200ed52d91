"""Lists of an embedding table: every row belongs to the nearest of about sqrt(n) centres of its key.

The centres of a key (model and dimension) are k-means centres of a bounded
sample of its rows; every row is then assigned.  Two searches use them:

* exact (``knn.knn_join``): a list keeps how near and how far its rows lie from
  its centre, and the k nearest of those distances.  By the triangle inequality
  these bound, for one query, every distance to the list from below and the
  k-th best distance from above; lists that cannot hold a neighbour are not
  visited.  Where the sample shows that the lists of a key spare less than
  ``SPARES`` of the visits (vectors without clusters), the key is searched whole.
* approximate (``knn.knn_approx``): the nearest ``probes`` lists are visited (more, where
  these hold too few rows), and of their rows those are scored whose sign codes differ from
  the query's in ``bits`` places at most, and in ``first`` of those compared first.  They are
  fitted so that ``TARGET`` of the true neighbours are found: neighbours of some rows of
  the sample among all rows of the key.  In the sample alone neighbours lie farther away the more rows
  it leaves out, and a share of all pairs that does not fall with the rows would be scored.

Neighbouring lists share a group of about a block of rows, and queries travel to
groups: one row per group that has a list to visit, none to the others.

The driver holds the centres and a few numbers a list, ``CELLS`` numbers at most
over all keys; keys beyond the ``KEYS`` largest have no lists and are searched
whole.  Rows without a place (not finite, or of length 0 for cosine) form a list
of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that may have lists, lists of a key, and numbers of all centres together (32 MB): the bound of what is broadcast.
KEYS, LISTS, CELLS = 4096, 4096, 4_000_000
#: Rows of a key that the centres are fitted on at most, and k-means rounds.
SAMPLE_ROWS, ROUNDS = 8192, 8
#: Queries of the sample that probes and depth are fitted on, those of them whose neighbours are sought in a whole key,
#: and the share of neighbours that must be found.
FIT_QUERIES, FIT_WHOLE, TARGET = 256, 1024, 0.92
#: Parts of the neighbours not found: in lists not visited, by the code's first words, by the whole code.
LOSS = {"place": 1 / 2, "first": 1 / 8, "apart": 3 / 8}
#: Words of a code that are compared first (without one bit: their difference is a byte), and pairs compared at once.
FIRST_WORDS, CODE_PAIRS = 4, 1 << 16
#: Rows whose codes are made at once.
CODE_ROWS = 2048
#: Share of visits that the lists of a key must spare in an exact search.
SPARES = 0.5
#: List numbers of rows without a place, and of keys without lists.
NO_PLACE, WHOLE = -2, -1


#: Blocks that a key's rows are dealt into, if they fill them, and the most numbers of a block (64 MB as doubles).
SPLIT, BLOCK_CELLS = 8, 8_000_000


def block_width(n: int, dim: int, block_rows: int) -> int:
    """Rows of a block of a key with ``n`` rows: ``block_rows``, or more where the key would have over ``SPLIT`` blocks.

    Every row travels once per block that it meets, so a fixed number of blocks keeps what is shuffled in
    proportion to the rows, until blocks are as large as a task may hold.
    """
    return max(block_rows, min(math.ceil(n / SPLIT), BLOCK_CELLS // max(dim, 1)))


def matrix(series: pd.Series) -> np.ndarray:
    return np.concatenate(series.to_numpy()).astype(np.float64).reshape(len(series), -1)


def placed(metric: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the space of the centres (unit vectors for cosine), and which of them have a place."""
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(length) & ((length > 0) | (metric != "cosine"))
        y = x / length[:, None] if metric == "cosine" else x
    return np.where(ok[:, None], y, 0.0), ok


def distances(y: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d2 = (y * y).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :] - 2.0 * (y @ centers.T)
    return np.sqrt(np.maximum(d2, 0.0))


def kmeans(y: np.ndarray, lists: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = y[rng.choice(len(y), min(lists, len(y)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(y, centers).argmin(axis=1)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, y)
        # a centre without rows moves to a row
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None],
                           y[rng.integers(0, len(y), len(centers))])
    return centers


def codes(y: np.ndarray, seed: int) -> np.ndarray:
    """Signs of random projections, 512 to 2048 of them by the dimension, as rows of 64-bit words."""
    bits = min(2048, max(512, -(-16 * y.shape[1] // 64) * 64))
    turn = np.random.default_rng(seed).normal(size=(y.shape[1], bits))
    out = np.empty((len(y), bits // 64), np.uint64)
    for s in range(0, len(y), CODE_ROWS):
        out[s:s + CODE_ROWS] = np.packbits(y[s:s + CODE_ROWS] @ turn > 0, axis=1).view(np.uint64)
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ, (len(a), len(b))."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def heads_of(code: np.ndarray) -> np.ndarray:
    """The words of codes (along the last axis) that are compared first."""
    out = code[..., :FIRST_WORDS].copy()
    out[..., 0] &= ~np.uint64(1)
    return out


def heads(code: np.ndarray) -> np.ndarray:
    """``heads_of``, a row a word."""
    return np.ascontiguousarray(heads_of(code).T)


def differing_heads(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which heads differ, (columns of a, columns of b) as bytes."""
    out = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    step = max(1, CODE_PAIRS // max(1, b.shape[1]))
    words, bits = (np.empty((min(step, len(out)), b.shape[1]), t) for t in (np.uint64, np.uint8))
    with np.errstate():  # ends the buffer's size too: with the default one rows of under 2,048 are copied first
        np.setbufsize(1024)
        for s in range(0, len(out), step):
            part = out[s:s + step]
            for x, y in zip(a[:, s:s + step], b, strict=True):
                np.bitwise_xor(x[:, None], y[None, :], out=words[:len(part)])
                part += np.bitwise_count(words[:len(part)], out=bits[:len(part)])
    return out


def differing_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the codes of pairs of rows differ."""
    out = np.empty(len(i), np.float32)
    one = np.ones(a.shape[1], np.float32)
    step = max(1, CODE_PAIRS // a.shape[1])
    for s in range(0, len(i), step):
        out[s:s + step] = np.bitwise_count(a[i[s:s + step]] ^ b[j[s:s + step]]) @ one
    return out


def similarity_order(metric: str, y: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Smaller is nearer: how lists are ordered for a query."""
    return -(y @ centers.T) if metric == "inner_product" else distances(y, centers)


def places(order: np.ndarray) -> np.ndarray:
    """Place of every list in a query's order."""
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(order.shape[1])[None, :], axis=1)
    return out


def found_share(part: str) -> float:
    return 1 - (1 - TARGET) * LOSS[part]


def fit_search(metric: str, y: np.ndarray, centers: np.ndarray, k: int, seed: int) -> tuple[int, int, int]:
    """(probes, first, bits) that find ``TARGET`` of the sample's own neighbours."""
    queries = min(FIT_QUERIES, len(y))
    score = similarity_order(metric, y[:queries], y)
    score[np.arange(queries), np.arange(queries)] = np.inf
    k = min(k, len(y) - 1)
    every = codes(y, seed)
    if k < 1:
        return len(centers), FIRST_WORDS * 64, every.shape[1] * 64
    true = np.argsort(score, axis=1)[:, :k]
    home = distances(y, centers).argmin(axis=1)
    place = places(np.argsort(similarity_order(metric, y[:queries], centers), axis=1))
    head = heads(every)
    seen = {"place": np.take_along_axis(place, home[true], axis=1),
            "first": np.take_along_axis(differing_heads(head[:, :queries], head), true, axis=1),
            "apart": np.take_along_axis(differing(every[:queries], every), true, axis=1)}
    cut = {part: int(np.quantile(x, found_share(part), method="higher")) for part, x in seen.items()}
    return cut["place"] + 1, cut["first"], cut["apart"]


def grouped(centers: np.ndarray, rows: np.ndarray, block_rows: int) -> np.ndarray:
    """Group of each list: lists in order of their main direction, about ``block_rows`` expected rows together."""
    along = centers - centers.mean(axis=0)
    order = np.argsort(along @ np.linalg.svd(along, full_matrices=False)[2][0], kind="stable")
    out = np.empty(len(centers), np.int32)
    out[order] = np.floor((np.cumsum(rows[order]) - rows[order] / 2) / block_rows)
    return out


class Lists:
    """The lists of one key."""

    def __init__(self, centers: np.ndarray, probes: int, first: int, bits: int, group: np.ndarray):
        self.centers, self.probes, self.first, self.bits, self.group = centers, probes, first, bits, group
        n = len(centers)
        self.low, self.high, self.rows = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        self.near: list[list[float]] = [[] for _ in range(n)]
        self.bare = 0

    def probed(self, metric: str, x: np.ndarray, least: int) -> np.ndarray:
        """(queries, lists): the nearest ``probes`` lists, or as many as hold ``least`` rows; none for queries without a place."""
        y, ok = placed(metric, x)
        order = similarity_order(metric, y, self.centers)
        last = min(self.probes, order.shape[1]) - 1
        out = order <= np.partition(order, last, axis=1)[:, last:last + 1]
        few = np.flatnonzero(out @ self.rows < min(least, self.rows.sum()))
        if len(few):
            by = np.argsort(order[few], axis=1, kind="stable")
            held = self.rows[by]
            more = np.zeros((len(few), len(self.rows)), bool)
            np.put_along_axis(more, by, np.cumsum(held, axis=1) - held < least, axis=1)
            out[few] |= more
        return out & ok[:, None]

    def may_hold(self, metric: str, x: np.ndarray, k: int) -> np.ndarray:
        """(queries, lists): whether a list can hold one of the k nearest rows."""
        y, ok = placed(metric, x)
        out = np.zeros((len(x), len(self.centers)), bool)
        if not (self.rows > 0).any():
            return out
        near = np.full((len(self.centers), k), np.inf)
        for j, d in enumerate(self.near):
            near[j, :min(k, len(d))] = sorted(d)[:k]
        if metric == "inner_product":
            dot, length = y @ self.centers.T, np.sqrt((y * y).sum(axis=1))[:, None]
            reach = np.where(self.rows > 0, self.high, 0.0)
            best, sure = -dot - length * reach, np.where(np.isfinite(near)[None], -dot[:, :, None] + length[:, :, None] * np.where(
                np.isfinite(near), near, 0.0)[None], np.inf)
        else:
            d = distances(y, self.centers)
            best = np.maximum(0.0, np.maximum(d - self.high[None, :], self.low[None, :] - d))
            sure = d[:, :, None] + near[None]
        sure = sure.reshape(len(x), -1)
        limit = np.partition(sure, k - 1, axis=1)[:, k - 1]
        # against rounding of either side
        slack = 1e-6 * (1.0 + np.abs(np.where(np.isfinite(limit), limit, 0.0)) + np.sqrt((y * y).sum(axis=1)))
        out = best <= (limit + slack)[:, None]
        out[~ok] = True
        return out & (self.rows > 0)[None, :]


def spared(metric: str, y: np.ndarray, centers: np.ndarray, k: int) -> float:
    """Share of visits that bounds spare between the sample's first rows and the sample."""
    probe = Lists(centers, 0, 0, 0, np.zeros(len(centers), np.int32))
    d = distances(y, centers)
    home = d.argmin(axis=1)
    off = d[np.arange(len(y)), home]
    for j in range(len(centers)):
        mine = np.sort(off[home == j])
        if len(mine):
            probe.rows[j], probe.low[j], probe.high[j], probe.near[j] = len(mine), mine[0], mine[-1], mine[:k].tolist()
    return 1 - float(probe.may_hold(metric, y[:FIT_QUERIES], k).mean())


def build(corpus: DataFrame, metric: str, k: int, least_rows: int, block_rows: int, exact: bool, seed: int = 7) -> dict[tuple, Lists]:
    """Lists of every (key, dim) of ``corpus`` (id, key, dim, vector) with more than ``least_rows`` rows; where
    ``exact``, only of those whose lists spare enough."""
    sizes = corpus.groupBy("key", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_rows)
    sizes = sizes.orderBy(F.col("n").desc(), "key", "dim").limit(KEYS).collect()
    if not sizes:
        return {}
    plan = [(r["key"], r["dim"], max(1, min(math.ceil(math.sqrt(r["n"])), LISTS, CELLS // (r["dim"] * len(sizes)))),
             min(1.0, 2.0 * SAMPLE_ROWS / r["n"]), r["n"]) for r in sizes]
    spark = corpus.sparkSession
    kind = corpus.schema["key"].dataType.simpleString()
    wanted = spark.createDataFrame(plan, f"key {kind}, dim int, lists int, rate double, n long")
    hashed = F.xxhash64("id")
    sample = corpus.join(F.broadcast(wanted), (corpus["key"].eqNullSafe(wanted["key"])) & (corpus["dim"] == wanted["dim"])).select(
        corpus["key"], corpus["dim"], "id", "vector", "lists", "rate", "n")
    sample = sample.where(F.pmod(hashed, F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    nth = F.row_number().over(Window.partitionBy("key", "dim").orderBy(hashed, "id"))
    sample = sample.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS)

    def nothing() -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([], dtype=object), "dim": [], "list": [], "center": pd.Series([], dtype=object),
                             "probes": [], "first": [], "bits": [], "grp": []})

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        y, ok = placed(metric, matrix(rows["vector"]))
        y = y[ok]
        if not len(y):
            return nothing()
        centers = kmeans(y, int(rows["lists"].iloc[0]), seed)
        if exact and spared(metric, y, centers, k) < SPARES:
            return nothing()
        probes, first, bits = (0, 0, 0) if exact else fit_search(metric, y, centers, k, seed)
        share = np.bincount(distances(y, centers).argmin(axis=1), minlength=len(centers)) / len(y)
        n = int(rows["n"].iloc[0])
        # where queries visit many lists, narrow groups spare none of them and only send every query more often
        width = block_width(n, int(key[1]), block_rows) if 4 * probes > len(centers) else block_rows
        return pd.DataFrame({"key": [key[0]] * len(centers), "dim": [key[1]] * len(centers), "list": range(len(centers)),
                             "center": list(centers), "probes": probes, "first": first, "bits": bits,
                             "grp": grouped(centers, share * n, width)})

    fitted = sample.groupBy("key", "dim").applyInPandas(
        fit, f"key {kind}, dim int, list int, center array<double>, probes int, first int, bits int, grp int").collect()
    found: dict[tuple, list] = {}
    for r in fitted:
        found.setdefault((r["key"], r["dim"]), []).append(r)
    out: dict[tuple, Lists] = {}
    for name, mine in found.items():
        mine.sort(key=lambda r: r["list"])
        out[name] = Lists(np.array([r["center"] for r in mine]), mine[0]["probes"], mine[0]["first"], mine[0]["bits"],
                          np.array([r["grp"] for r in mine], np.int32))
    if not exact:
        refit(sample, corpus, out, {(r["key"], r["dim"]): r["n"] for r in sizes}, metric, k, seed)
    return out


def refit(sample: DataFrame, corpus: DataFrame, index: dict[tuple, Lists], sizes: dict[tuple, int], metric: str, k: int, seed: int) -> None:
    """Probes and code distances of keys that are larger than their sample, fitted on neighbours among all rows of the key.

    One pass scores every row against the queries of its key, at most ``FIT_WHOLE`` and ``CELLS`` numbers over all keys; a
    task returns the k nearest of each. With less room than ``FIT_QUERIES`` a key the sample's values stay, which find more.
    """
    wide = {name: sizes[name] for name in index if sizes[name] > SAMPLE_ROWS}
    each = min([FIT_WHOLE, *(CELLS // (dim * len(wide)) for _, dim in wide)])
    if not wide or each < FIT_QUERIES:
        return
    asked: dict[tuple, list] = {}
    for r in sample.where((F.col("nth") <= each) & (F.col("n") > SAMPLE_ROWS)).select("key", "dim", "id", "vector").collect():
        if (r["key"], r["dim"]) in wide:
            asked.setdefault((r["key"], r["dim"]), []).append((r["id"], r["vector"]))
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((index, asked))

    def queries_of(name: tuple) -> tuple:
        lists, rows = shared.value[0][name], shared.value[1][name]
        y, ok = placed(metric, np.array([v for _, v in rows], dtype=np.float64))
        y, ids = y[ok], np.array([i for i, _ in rows])[ok]
        place = places(np.argsort(similarity_order(metric, y, lists.centers), axis=1)) if len(y) else np.zeros((0, 1), int)
        return ids, y, codes(y, seed), place, lists.centers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[tuple, tuple] = {}
        best: dict[tuple, list[np.ndarray]] = {}
        for pdf in batches:
            for name, at in _groups(pdf):
                if name not in shared.value[1]:
                    continue
                if name not in ready:
                    ready[name] = queries_of(name)
                ids, y, code, place, centers = ready[name]
                x, ok = placed(metric, matrix(pdf["vector"].iloc[at]))
                x, xid = x[ok], pdf["id"].to_numpy(np.int64)[at][ok]
                if not len(x) or not len(y):
                    continue
                score = similarity_order(metric, y, x)
                score[ids[:, None] == xid[None, :]] = np.inf
                near = np.argpartition(score, min(k, len(x)) - 1, axis=1)[:, :k]
                row = np.arange(len(y))[:, None]
                theirs = codes(x, seed)[near]
                new = [score[row, near], place[row, distances(x, centers).argmin(axis=1)[near]],
                       np.bitwise_count(heads_of(code)[:, None] ^ heads_of(theirs)).sum(axis=2, dtype=np.int64),
                       np.bitwise_count(code[:, None] ^ theirs).sum(axis=2, dtype=np.int64)]
                if name in best:
                    new = [np.concatenate(pair, axis=1) for pair in zip(best[name], new, strict=True)]
                keep = np.argsort(new[0], axis=1)[:, :k]
                best[name] = [np.take_along_axis(z, keep, axis=1) for z in new]
        for name, (score, place, first, apart) in best.items():
            held = np.isfinite(score)
            yield pd.DataFrame({"key": [name[0]] * int(held.sum()), "dim": name[1], "query": np.nonzero(held)[0], "score": score[held],
                                "place": place[held], "first": first[held], "apart": apart[held]})

    kind = corpus.schema["key"].dataType.simpleString()
    seen = corpus.mapInPandas(run, f"key {kind}, dim int, query int, score double, place long, first long, apart long")
    nth = F.row_number().over(Window.partitionBy("key", "dim", "query").orderBy("score", "place", "apart"))

    def cut(part: str):
        # at most k * FIT_WHOLE values a key
        every = F.sort_array(F.collect_list(part))
        return F.element_at(every, (F.ceil((F.size(every) - 1) * F.lit(found_share(part))) + 1).cast("int")).alias(part)

    for r in seen.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("key", "dim").agg(*[cut(part) for part in LOSS]).collect():
        mine = index[r["key"], r["dim"]]
        mine.probes, mine.first, mine.bits = r["place"] + 1, r["first"], r["apart"]


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray]]:
    keys = [None if k is None or k != k else k for k in pdf["key"].tolist()]
    at: dict[tuple, list[int]] = {}
    for i, name in enumerate(zip(keys, pdf["dim"].tolist(), strict=True)):
        at.setdefault(name, []).append(i)
    for name, rows in at.items():
        yield name, np.array(rows)


def assign(corpus: DataFrame, index: dict[tuple, Lists], metric: str) -> DataFrame:
    """``corpus`` with ``list``, its ``grp`` and ``off`` (distance from the list's centre)."""
    if not index:
        return corpus.withColumn("list", F.lit(WHOLE)).withColumn("grp", F.lit(WHOLE)).withColumn("off", F.lit(0.0))
    shared = corpus.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen, grp, off = np.full(len(pdf), WHOLE, np.int32), np.full(len(pdf), WHOLE, np.int32), np.zeros(len(pdf))
            for name, rows in _groups(pdf):
                if name in shared.value:
                    y, ok = placed(metric, matrix(pdf["vector"].iloc[rows]))
                    d = distances(y, shared.value[name].centers)
                    best = d.argmin(axis=1)
                    chosen[rows] = np.where(ok, best, NO_PLACE)
                    grp[rows] = np.where(ok, shared.value[name].group[best], NO_PLACE)
                    off[rows] = d[np.arange(len(rows)), best]
            yield pdf.assign(list=chosen, grp=grp, off=off)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.schema)
    return corpus.mapInPandas(run, f"{kinds}, list int, grp int, off double")


def count_rows(assigned: DataFrame, index: dict[tuple, Lists]) -> None:
    """Fill in each list's rows."""
    if not index:
        return
    rows = assigned.where(F.col("list") >= 0).groupBy("key", "dim", "list").agg(F.count(F.lit(1)).alias("n"))
    for r in rows.collect():
        index[r["key"], r["dim"]].rows[r["list"]] = r["n"]


def measure(assigned: DataFrame, index: dict[tuple, Lists], k: int) -> None:
    """Fill in each list's rows, nearest and farthest distance and k nearest distances: k + 3 numbers a list."""
    if not index:
        return
    rows = assigned.where(F.col("list") != WHOLE).select("key", "dim", "list", "off")
    for r in rows.groupBy("key", "dim", "list").agg(
            F.count(F.lit(1)).alias("n"), F.min("off").alias("low"), F.max("off").alias("high")).collect():
        mine = index[r["key"], r["dim"]]
        if r["list"] == NO_PLACE:
            mine.bare = r["n"]
        else:
            mine.rows[r["list"]], mine.low[r["list"]], mine.high[r["list"]] = r["n"], r["low"], r["high"]
    nth = F.row_number().over(Window.partitionBy("key", "dim", "list").orderBy("off"))
    for r in rows.where(F.col("list") >= 0).withColumn("nth", nth).where(F.col("nth") <= k).collect():
        index[r["key"], r["dim"]].near[r["list"]].append(r["off"])


def route(queries: DataFrame, index: dict[tuple, Lists], metric: str, k: int, exact: bool, spare: int = 0) -> DataFrame:
    """A row of ``queries`` (query_id, key, dim, vector) per group (``grp``) with a list that it visits.

    ``spare``: rows that may be excluded from a query's neighbours (itself).
    """
    if not index:
        return queries.withColumn("grp", F.lit(WHOLE))
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen = np.empty(len(pdf), object)
            for name, rows in _groups(pdf):
                mine = shared.value.get(name)
                if mine is None:
                    for r in rows:
                        chosen[r] = np.array([WHOLE], np.int32)
                    continue
                x = matrix(pdf["vector"].iloc[rows])
                if exact:
                    visit = mine.may_hold(metric, x, k + spare)
                    # rows without a place come last in a ranking by distance: wanted only where others are too few
                    few = metric == "inner_product" or mine.rows.sum() < k + spare
                    bare = ~placed(metric, x)[1] | few
                else:
                    visit, bare = mine.probed(metric, x, k + spare), np.zeros(len(x), bool)
                # the last column is the list of rows without a place
                groups = np.append(np.arange(mine.group.max() + 1), NO_PLACE).astype(np.int32)
                visit = np.stack([*(visit[:, mine.group == g].any(axis=1) for g in groups[:-1]), bare], axis=1)
                for r, v in zip(rows, visit, strict=True):
                    chosen[r] = groups[v]
            yield pdf.assign(grps=chosen)

    # a row once out of Python, and once per group only from here
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInPandas(run, f"{kinds}, grps array<int>").withColumn("grp", F.explode("grps")).drop("grps")
