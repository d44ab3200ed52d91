"""Exact and approximate k-nearest-neighbour search over embedding tables.

* ``knn`` — one query vector: distance column, sort and limit; every task keeps
  its k best rows, nothing is shuffled.
* ``knn_per_key`` — one query vector per key (e.g. a model centroid), joined on
  that key; top-k per key through a window that Spark limits map-side.
* ``knn_join`` — many queries x corpus, matched within a key (the model) and
  the vector's dimension.  A key of more than one block is cut into lists
  (``lists``): a query visits only lists that can hold one of its neighbours by
  the triangle inequality.  Both sides of a group of lists are dealt into blocks of bounded
  size; every pair of blocks is one task that scores its block with matrix
  products and returns its k best per query.  No rows are collected to the driver or
  broadcast, and a list that holds most of the rows is as many tasks as its
  blocks need.  Keys whose vectors have no clusters are searched whole.
* ``knn_approx`` — the same lists with multi-probe: a query visits its nearest
  lists, sign codes pick the rows of a list that are scored.

Vectors of another dimension than the query's never match (``dimension_split``
reports them).  Distances that are NaN (cosine of a zero vector) rank last.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions import vectors as V
from inkstone.operators import lists as L

#: Rows of either side in one task of the join; keys of more than ``lists.SPLIT`` such blocks have larger ones.
BLOCK_ROWS = 4096
# Distance cells computed at once inside one task.
_CELLS = 2_000_000
# Pairs after which a query's limit is set anew.
_PAIRS = 100_000
# Queries and rows of a tile of products.
_TILE = 1024, 2048
# Neighbours beyond k that are re-scored exactly, against rounding in the matrix product.
_SPARE = 8


def _rank_window(*partition_cols: str):
    return Window.partitionBy(*partition_cols).orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc_nulls_last())


def dimension_split(vectors: DataFrame, dim: int, vec_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has ``dim`` elements, all other rows)."""
    ok = F.coalesce(V.dimension_ok(F.col(vec_col), dim), F.lit(False))
    return vectors.filter(ok), vectors.filter(~ok)


def knn(corpus: DataFrame, query: list[float], k: int, metric: str = "l2",
        model_id: int | None = None, vec_col: str = "vector") -> DataFrame:
    """(id, article_id, distance) of the k nearest rows of ``corpus`` to one query vector (a parameter)."""
    c = corpus if model_id is None else corpus.filter(F.col("model_id") == F.lit(model_id))
    q = F.array(*[F.lit(float(x)) for x in query])
    c = c.filter(V.dimension_ok(F.col(vec_col), len(query)))
    d = c.select("id", "article_id", V.distance(metric, F.col(vec_col), q).alias("distance"))
    return d.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


def knn_per_key(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2",
                key: str = "model_id", vec_col: str = "vector", qvec_col: str = "query_vector") -> DataFrame:
    """Top-k corpus rows per key against ``queries`` (exactly one vector per key).

    ``queries`` is keyed (unique ``key``), so the equi-join is a lookup that
    never multiplies corpus rows; adaptive execution splits a skewed key.
    """
    q = queries.select(F.col(key).alias("_key"), F.col(qvec_col).alias("_qvec"))
    j = corpus.filter(V.is_valid(F.col(vec_col))).join(
        q, (F.col(key) == F.col("_key")) & (F.size(vec_col) == F.size("_qvec")))
    d = j.select(key, "id", "article_id", V.distance(metric, F.col(vec_col), F.col("_qvec")).alias("distance"))
    return (d.withColumn("rank", F.row_number().over(_rank_window(key)))
            .filter(F.col("rank") <= k))


# ---------------------------------------------------------------- knn_join

def _dist_matrix(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    g = q @ c.T
    if metric == "inner_product":
        return -g
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - g / np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1)))
    d2 = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * g
    return np.sqrt(np.maximum(d2, 0.0))


def _exact(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact distance along the last axis (q broadcasts against c)."""
    if metric == "l2":
        return np.sqrt(((q - c) ** 2).sum(axis=-1))
    dotp = (q * c).sum(axis=-1)
    if metric == "inner_product":
        return -dotp
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - dotp / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((c * c).sum(axis=-1)))


def _smallest(dist: np.ndarray, ids: np.ndarray, out: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest (excluded last, then NaN, then distance, then id) per row."""
    near = _no_farther(dist, out, k)
    if near is not None:
        dist, ids, out = (np.take_along_axis(x, near, axis=1) for x in (dist, np.broadcast_to(ids, out.shape), out))
    nan = np.isnan(dist)
    best = np.lexsort((ids, np.where(nan, 0.0, dist), nan, out), axis=1)[:, :k]
    return best if near is None else np.take_along_axis(near, best, axis=1)


def _no_farther(dist: np.ndarray, out: np.ndarray, k: int) -> np.ndarray | None:
    """Columns that hold, for every row, all distances up to its k-th smallest; None where these are not few."""
    if dist.shape[1] <= 8 * k:
        return None
    key = np.where(out | np.isnan(dist), np.inf, dist)
    last = np.partition(key, k - 1, axis=1)[:, k - 1:k]
    most = int((key <= last).sum(axis=1).max()) if len(key) else 0
    if most > dist.shape[1] // 2 or not np.isfinite(last).all():
        return None
    return np.argpartition(key, most - 1, axis=1)[:, :most]


def _distinct(c: np.ndarray, cid: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of any vector: of equal vectors those with the k smallest ids."""
    rows = np.ascontiguousarray(c).view(np.dtype((np.void, c.shape[1] * c.itemsize)))[:, 0]
    _, same = np.unique(rows, return_inverse=True)
    order = np.lexsort((cid, same))
    group, ids = same[order], cid[order]
    begins = np.r_[True, group[1:] != group[:-1]]
    nth = np.cumsum(begins | np.r_[True, ids[1:] != ids[:-1]])  # equal ids count once
    return np.sort(order[nth - np.repeat(nth[begins], np.diff(np.r_[np.flatnonzero(begins), len(nth)])) < k])


def _best(i: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best pairs (NaN last, then distance, then id) of every query ``i``, in this order."""
    nan = np.isnan(dist)
    order = np.lexsort((ids, np.where(nan, 0.0, dist), nan, i) if nan.any() else (ids, dist, i))
    of = i[order]
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return order[np.arange(len(of)) - np.repeat(begins, np.diff(np.r_[begins, len(of)])) < k]


def _pair_distances(metric: str, q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact distances of pairs of rows, ``_CELLS`` numbers of either side at once."""
    step = max(1, _CELLS // q.shape[1])
    return np.concatenate([_exact(metric, q[i[s:s + step]], c[j[s:s + step]]) for s in range(0, len(i), step)] or [np.zeros(0)])


def _every_pair(metric: str, q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, exclude_self: bool):
    """(query rows, corpus rows, distances) of the k best of all pairs, whatever the vectors hold."""
    step = max(1, _CELLS // max(len(cid), (k + _SPARE) * q.shape[1]))
    for s in range(0, len(qid), step):
        qs, qi = q[s:s + step], qid[s:s + step]
        with np.errstate(over="ignore", invalid="ignore"):
            d = _dist_matrix(metric, qs, c)
        out = (qi[:, None] == cid[None, :]) if exclude_self else np.zeros(d.shape, bool)
        near = _smallest(d, np.broadcast_to(cid, d.shape), out, k + _SPARE)
        exact = _exact(metric, qs[:, None, :], c[near])
        out = np.take_along_axis(out, near, axis=1)
        best = _smallest(exact, cid[near], out, k)
        rows = np.take_along_axis(near, best, axis=1)
        use = ~np.take_along_axis(out, best, axis=1)
        yield np.broadcast_to(np.arange(s, s + len(qi))[:, None], rows.shape)[use], rows[use], np.take_along_axis(exact, best, axis=1)[use]


def _plain(metric: str, x: np.ndarray) -> np.ndarray:
    """Rows whose bounds hold: no overflow, and for cosine a direction."""
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        return (length < 1e100) & ((length > 1e-100) | (metric != "cosine"))


def _bounds(metric: str, q: np.ndarray, c: np.ndarray):
    """(a, b, least): ``a @ b.T`` is, rounding included, no less than least(rows, d) for every pair at distance d or nearer.

    For cosine products of unit vectors in single precision; else in double precision, with columns for what rounding can take.
    """
    lq, lc = (np.sqrt((x * x).sum(axis=1))[:, None] for x in (q, c))
    if metric == "cosine":
        slack = (q.shape[1] + 16) * 2.0 ** -23
        return (q / lq).astype(np.float32), (c / lc).astype(np.float32), lambda rows, d: (1 - slack - d).astype(np.float32)
    slack = (q.shape[1] + 16) * 2.0 ** -51
    if metric == "inner_product":
        return np.hstack([q, slack * lq]), np.hstack([c, lc]), lambda rows, d: -d
    # q.c - c.c / 2 is (q.q - d.d) / 2
    a, b = np.hstack([q, np.ones_like(lq), slack * lq]), np.hstack([c, lc * lc * (slack - 1) / 2, lc])
    q2 = lq[:, 0] ** 2
    return a, b, lambda rows, d: (q2[rows] - d * d) / 2 - slack * (q2[rows] + d * d)


def _bounded_pairs(metric: str, q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, exclude_self: bool):
    """(query rows, corpus rows, distances) of the k best of all pairs of plain rows.

    A tile of products is compared with what the query's k-th best row so far comes to; only pairs that may be nearer
    are scored exactly. The first tile's largest products give the first k.
    """
    a, b, least = _bounds(metric, q, c)
    room = np.empty(_TILE, a.dtype)
    for s in range(0, len(qid), _TILE[0]):
        rows = np.arange(s, min(s + _TILE[0], len(qid)))
        limit = np.full(len(rows), -np.inf, a.dtype)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        new, fresh, full = [], 0, _TILE[1]
        for t in range(0, len(cid), _TILE[1]):
            part = b[t:t + _TILE[1]]
            product = np.matmul(a[rows], part.T, out=room[:len(rows), :len(part)])
            if t == 0 and len(part) > 2 * (k + 1):
                near = np.argpartition(product, len(part) - k - 1, axis=1)[:, -k - 1:]
                exact = _pair_distances(metric, q, c, np.repeat(rows, k + 1), near.ravel()).reshape(near.shape)
                if exclude_self:
                    exact[qid[rows][:, None] == cid[near]] = np.inf
                kth = np.partition(exact, k - 1, axis=1)[:, k - 1]
                some = np.isfinite(kth)
                limit[some] = least(rows[some], kth[some])
            i, j = np.divmod(np.flatnonzero(product >= limit[:, None]), len(part))
            j += t
            if exclude_self:
                other = qid[rows[i]] != cid[j]
                i, j = i[other], j[other]
            new.append((i, j, _pair_distances(metric, q, c, rows[i], j)))
            fresh += len(i)
            # the limits fall with the rows seen: set anew as these double
            if t + len(part) >= full or fresh > _PAIRS or t + _TILE[1] >= len(cid):
                held = [np.concatenate(x) for x in zip(held, *new, strict=True)]
                keep = _best(held[0], cid[held[1]], held[2], k)
                held = [x[keep] for x in held]
                last = np.flatnonzero(np.bincount(held[0], minlength=len(rows)) == k)
                if len(last):
                    ends = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
                    kth = np.full(len(rows), np.inf)
                    kth[held[0][ends]] = held[2][ends]
                    limit[last] = np.maximum(limit[last], least(rows[last], kth[last]))
                new, fresh, full = [], 0, max(full, 2 * (t + len(part)))
        yield rows[held[0]], held[1], held[2]


def _block_topk(k: int, metric: str, exclude_self: bool):
    """Cogroup body: the k best corpus rows of one block for every query of one block."""

    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(corpus):
            return pd.DataFrame({c: [] for c in ("query_id", "id", "article_id", "distance")})
        qid, cid = queries["query_id"].to_numpy(np.int64), corpus["id"].to_numpy(np.int64)
        aid = corpus["article_id"].to_numpy(np.int64)
        q, c = L.matrix(queries["vector"]), L.matrix(corpus["vector"])
        use = _distinct(c, cid, k + exclude_self)
        cid, aid, c = cid[use], aid[use], c[use]
        q_ok, c_ok = _plain(metric, q), _plain(metric, c)
        parts = []
        for search, left, right in ((_bounded_pairs, q_ok, c_ok), (_every_pair, q_ok, ~c_ok), (_every_pair, ~q_ok, np.ones(len(c), bool))):
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            if len(left) and len(right):
                parts += [(left[i], right[j], d) for i, j, d in search(metric, q[left], c[right], qid[left], cid[right], k, exclude_self)]
        i, j, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        best = _best(i, cid[j], d, k)
        i, j, d = i[best], j[best], d[best]
        return pd.DataFrame({"query_id": qid[i], "id": cid[j], "article_id": aid[j], "distance": d})

    return run


_JOIN_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("article_id", T.LongType()),
    T.StructField("distance", T.DoubleType()),
])


def _sides(queries: DataFrame, corpus: DataFrame, qid: str, qvec: str, model: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, key, dim, vector) and (id, article_id, key, dim, vector) of valid vectors; floats travel as floats."""
    def numbers(df: DataFrame, c: str):
        kind = df.schema[c].dataType
        small = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
        return F.col(c).cast("array<float>" if small else "array<double>").alias("vector")

    q = queries.filter(V.is_valid(F.col(qvec))).select(
        F.col(qid).cast("long").alias("query_id"), F.col(model).alias("key"), F.size(qvec).alias("dim"),
        numbers(queries, qvec))
    c = corpus.filter(V.is_valid(F.col(vec_col))).select(
        F.col("id").cast("long").alias("id"), F.col("article_id").cast("long").alias("article_id"),
        F.col(model).alias("key"), F.size(vec_col).alias("dim"), numbers(corpus, vec_col))
    return q, c


_ON = ["key", "dim", "grp"]


def list_sizes(visits: DataFrame, assigned: DataFrame) -> DataFrame:
    """(key, dim, grp, n_queries, n_rows) of the groups of lists that both sides have."""
    one, none = F.lit(1), F.lit(0)
    both = visits.select(*_ON, one.alias("q"), none.alias("c")).unionByName(assigned.select(*_ON, none.alias("q"), one.alias("c")))
    return both.groupBy(*_ON).agg(F.sum("q").alias("n_queries"), F.sum("c").alias("n_rows")).where(
        "key IS NOT NULL AND n_queries > 0 AND n_rows > 0")


def _block_join(visits: DataFrame, assigned: DataFrame, run, schema: T.StructType, block_rows: int) -> DataFrame:
    """Every block of a group's queries against every block of its rows, each pair one cogrouped task."""
    # a row per group of lists: as wide a block as for the whole key (``lists.block_width``)
    of_key = F.sum("n_rows").over(Window.partitionBy("key", "dim"))
    width = F.greatest(F.lit(block_rows), F.least(F.ceil(of_key / L.SPLIT), F.floor(L.BLOCK_CELLS / F.greatest("dim", F.lit(1)))))
    dealt = list_sizes(visits, assigned).withColumn("width", width).select(
        *_ON, F.ceil(F.col("n_queries") / F.col("width")).cast("int").alias("nq"),
        F.ceil(F.col("n_rows") / F.col("width")).cast("int").alias("nc"))

    def block(id_col: str, n: str):
        return F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    qs = visits.join(dealt, _ON).withColumn("qb", block("query_id", "nq")).withColumn("cb", all_of("nc"))
    cs = assigned.join(dealt, _ON).withColumn("cb", block("id", "nc")).withColumn("qb", all_of("nq"))
    task = [*_ON, "qb", "cb"]
    return qs.select(*task, "query_id", "vector").groupBy(*task).cogroup(
        cs.select(*task, "id", "article_id", "list", "vector").groupBy(*task)).applyInPandas(run, schema)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine",
             exclude_self: bool = False, qid: str = "query_id", qvec: str = "query_vector",
             model: str = "model_id", vec_col: str = "vector", block_rows: int = BLOCK_ROWS,
             unique_queries: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Top-k corpus rows for every query, matched within the same ``model`` key.

    ``model`` names the grouping column present on both sides (the embedding
    model, or any key such as an LSH bucket).  ``unique_queries=False`` when a
    query id appears under several keys whose lists are to be merged; with
    ``keep`` (the model column) a query is ranked per key instead.  Returns
    (query_id, id, article_id, distance, rank).
    """
    if metric not in V.METRICS:
        raise ValueError(f"metric must be one of {V.METRICS}")
    per_key = keep is not None
    q, c = _sides(queries, corpus, qid, qvec, model, vec_col)
    spare = 1 if exclude_self else 0
    index = L.build(c, metric, k + spare, block_rows, block_rows, exact=True)
    assigned = L.assign(c, index, metric)
    L.measure(assigned, index, k + spare)
    visits = L.route(q, index, metric, k, exact=True, spare=spare)
    schema = T.StructType([*_JOIN_SCHEMA.fields, T.StructField("key", c.schema["key"].dataType)]) if per_key else _JOIN_SCHEMA
    body = _block_topk(k, metric, exclude_self)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = body(left, right)
        return out.assign(key=key[0]) if per_key else out

    cand = _block_join(visits, assigned, run, schema, block_rows)
    if per_key:
        ranked = cand.withColumn("rank", F.row_number().over(_rank_window("key", "query_id")))
        return ranked.filter(F.col("rank") <= k).withColumnRenamed("key", keep[0])
    if unique_queries:
        return cand.withColumn("rank", F.row_number().over(_rank_window("query_id"))).filter(F.col("rank") <= k)
    # a pair may come from several keys: equal rows share a dense rank, then one of them stays
    ranked = cand.withColumn("rank", F.dense_rank().over(_rank_window("query_id")))
    return ranked.filter(F.col("rank") <= k).dropDuplicates(["query_id", "id"])


# ---------------------------------------------------------------- approximate

#: Keys of fewer rows are searched whole.
LEAST_ROWS = 64
# Queries that the lists of a group are searched for at once.
_QUERIES = 4096
_APPROX_SCHEMA = T.StructType([*_JOIN_SCHEMA.fields, T.StructField("scored", T.LongType()), T.StructField("centres", T.LongType())])


def _search_lists(mine: L.Lists, metric: str, k: int, spare: int, qid: np.ndarray, qv: np.ndarray, code_q: np.ndarray,
                  cid: np.ndarray, cv: np.ndarray, code_c: np.ndarray, home: np.ndarray):
    """(query rows, corpus rows, distances) of the k best found in the visited lists, and the number of pairs scored a query.

    Rows lie in order of their list (``home``). A list's rows meet the queries that visit it: codes are compared in
    their first words, as a whole where these are near enough, and vectors where that is.
    """
    begins = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
    spans = list(zip(home[begins], begins, np.r_[begins[1:], len(home)], strict=True))
    probed = mine.probed(metric, qv, k + spare)[:, home[begins]]
    head_q, head_c = L.heads(code_q), L.heads(code_c)
    low = np.full(probed.shape, 256, np.int16)  # least difference of the first words of a list's rows
    found = np.zeros(len(qid), np.int64)
    scored = np.zeros(len(qid), np.int64)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    new: list[tuple] = []

    def settle() -> None:
        nonlocal held, new
        held = [np.concatenate(x) for x in zip(held, *new, strict=True)]
        keep = _best(held[0], cid[held[1]], held[2], k)
        held, new = [x[keep] for x in held], []

    def score(i: np.ndarray, j: np.ndarray) -> None:
        scored[:] += np.bincount(i, minlength=len(qid))
        new.append((i, j, _pair_distances(metric, qv, cv, i, j)))
        if sum(len(x[0]) for x in new) > _CELLS:
            settle()

    def others(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = qid[i] != cid[j] if spare else np.ones(len(i), bool)
        return i[use], j[use]

    for n, (_, a, b) in enumerate(spans):
        visitors = np.flatnonzero(probed[:, n])
        wide = max(1, _CELLS // max(1, len(visitors)))
        for t in range(a, b if len(visitors) else a, wide):
            end = min(t + wide, b)
            apart = L.differing_heads(head_c[:, t:end], head_q[:, visitors])
            low[visitors, n] = np.minimum(low[visitors, n], apart.min(axis=0))
            j, i = np.divmod(np.flatnonzero(apart <= mine.first), len(visitors))
            i, j = visitors[i], j + t
            near = L.differing_pairs(code_q, code_c, i, j) <= mine.bits
            i, j = others(i[near], j[near])
            found += np.bincount(i, minlength=len(qid))
            score(i, j)
    # the nearest codes at any rate, so no query is left without its k: they lie in the lists with the least differences
    short = np.flatnonzero(found < k)
    if len(short):
        most = min(k + spare, len(spans))
        nearest = np.argpartition(low[short], most - 1, axis=1)[:, :most]
        again = np.zeros((len(short), len(spans)), bool)
        np.put_along_axis(again, nearest, True, axis=1)
        again &= probed[short]
        scored[short] = 0
        more = []
        for n, (_, a, b) in enumerate(spans):
            of = short[again[:, n]]
            wide = max(1, _CELLS // (b - a))
            for t in range(0, len(of), wide):
                apart = L.differing_heads(head_q[:, of[t:t + wide]], head_c[:, a:b])
                rows = min(k + spare, b - a)
                near = np.argpartition(apart, rows - 1, axis=1)[:, :rows]
                more.append(others(np.repeat(of[t:t + wide], rows), a + near.ravel()))
        settle()
        mask = np.zeros(len(qid), bool)
        mask[short] = True
        mine_ = mask[held[0]]
        more.append((held[0][mine_], held[1][mine_]))
        held = [x[~mine_] for x in held]
        i, j = (np.concatenate(x) for x in zip(*more, strict=True))
        i, j = np.divmod(np.unique(i * len(cid) + j), len(cid))
        score(i, j)
    settle()
    return *held, scored


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", seed: int = 7,
               qid: str = "query_id", qvec: str = "query_vector", vec_col: str = "vector", exclude_self: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top-k within the same model: lists, multi-probe, sign codes, exact distances (the HNSW index re-aimed).

    Every corpus row is in a list.  Per query, all pairs cost a look at its key's centres; rows of the visited lists
    cost a comparison of sign codes; only the rows whose codes are nearest are scored.  Returns (query_id, id,
    article_id, distance, rank, scored); scored: the query's full distances, to centres and rows.
    """
    q, c = _sides(queries, corpus, qid, qvec, "model_id", vec_col)
    index = L.build(c, metric, k, LEAST_ROWS, block_rows, exact=False, seed=seed)
    assigned = L.assign(c, index, metric).where(F.col("list") != L.NO_PLACE)
    L.count_rows(assigned, index)
    spare = 1 if exclude_self else 0
    visits = L.route(q, index, metric, k, exact=False, spare=spare)
    shared = q.sparkSession.sparkContext.broadcast(index)
    whole = _block_topk(k, metric, exclude_self)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = shared.value.get((key[0], key[1]))
        if mine is None or not len(left) or not len(right):
            out = whole(left, right)
            return out.assign(scored=np.where(out["query_id"].duplicated(), 0, len(right)), centres=0)
        qid_, cid, aid = (x.to_numpy(np.int64) for x in (left["query_id"], right["id"], right["article_id"]))
        qv, cv, home = L.matrix(left["vector"]), L.matrix(right["vector"]), right["list"].to_numpy()
        use = _distinct(cv, cid, k + spare)
        use = use[np.argsort(home[use], kind="stable")]
        cid, aid, cv, home = cid[use], aid[use], cv[use], home[use]
        code_q, code_c = (L.codes(L.placed(metric, x)[0], seed) for x in (qv, cv))
        step = max(1, min(_QUERIES, _CELLS // len(mine.centers)))
        parts = []
        for s in range(0, len(qid_), step):
            at = slice(s, s + step)
            i, j, exact, scored = _search_lists(mine, metric, k, spare, qid_[at], qv[at], code_q[at], cid, cv, code_c, home)
            first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
            parts.append(pd.DataFrame({"query_id": qid_[at][i], "id": cid[j], "article_id": aid[j],
                                       "distance": exact, "scored": np.where(first, scored[i], 0), "centres": len(mine.centers)}))
        return pd.concat(parts, ignore_index=True)

    cand = _block_join(visits, assigned, run, _APPROX_SCHEMA, block_rows)
    of_query = Window.partitionBy("query_id")
    # every task of a query names the same centres: it looked at them once
    total = F.sum("scored").over(of_query) + F.max("centres").over(of_query)
    ranked = cand.withColumn("rank", F.row_number().over(_rank_window("query_id"))).withColumn("scored", total)
    return ranked.filter(F.col("rank") <= k).drop("centres")


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, n): share of exact (query_id, id) neighbours the approximate search found."""
    found = approx.select("query_id", "id").withColumn("_found", F.lit(1))
    j = exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return j.agg(F.avg(F.coalesce(F.col("_found"), F.lit(0))).alias("recall"), F.count("*").alias("n"))
