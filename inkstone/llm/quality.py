"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Ratings are ordered grades 0 .. K-1.  One weight per hashed text feature is
shared by all grades, and ordered thresholds t_1 < ... < t_K-1 cut the score:

    P(grade >= k) = 1 / (1 + exp(t_k - score))

so a document gets an expected grade (the sum of these) and, for selection,
the probability of the top grade.  Features are present or absent, over the
whole text: words, their first four and five bytes, and the bins of a few text
statistics (symbols, repetition, length).  They are hashed to 26 bits; only
features whose frequency in some grade differs from chance get a weight
(``LEAST_Z`` standard errors, fewer with few labels), so a long text is not judged by the sum of its
many rare words.

The model is fitted on a bounded sample of labelled documents, at most
``PER_GRADE`` of each grade (those whose ids hash lowest), weighted back to
the grades' shares among all labels.  Every document is scored.

Edge cases: a null or empty text has only its statistics; documents without a
label are scored like others; labels without a grade, or without a document,
are ignored, and of several labels for one document the lowest grade counts; of
several texts under one labelled doc_id the fit sees one;
with labels of fewer than two grades nothing can be learned, scores are null
and every document is kept; it is also kept if no feature gets a weight; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import wordhash
from inkstone.llm.common import arrow_batches, texts

#: Labelled documents of each grade that the fit sees at most.
PER_GRADE = 2500
#: Standard errors by which a feature's frequency in a grade must differ from its overall frequency.
LEAST_Z = 8.0
#: The same as a share of sqrt(n), the most that n documents allow; it decides below some 130 documents.
LEAST_SHARE = 0.7
BITS = 26
#: Probability of the top grade from which a document is kept.
KEEP = 0.5
#: Strength of the quadratic penalty on weights, per training document.
PENALTY = 1e-4
STEPS = 300

_U = np.uint64


def _statistics(text: bytes, n_words: int, n_distinct: int) -> list[int]:
    """Bins of text statistics, as small feature numbers."""
    data = np.frombuffer(text, np.uint8)
    size = max(len(data), 1)
    symbols = np.count_nonzero(_SYMBOL[data]) / size
    digits = np.count_nonzero((data >= 48) & (data <= 57)) / size
    length = min(int(np.log2(n_words + 1)), 20)
    fresh = int(20 * n_distinct / max(n_words, 1))
    return [length, 32 + min(int(40 * symbols), 40), 96 + min(int(40 * digits), 40), 160 + fresh,
            1024 + 32 * length + fresh, 192 + min(size // max(n_words, 1), 60)]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(texts_: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature numbers (below 2 ** BITS) of each text."""
    word, four, five, begins = wordhash.token_hashes(texts_)
    out = []
    with np.errstate(over="ignore"):
        shift = _U(64 - BITS)
        word, four, five = (wordhash.mix(x + _U(k)) >> shift for k, x in enumerate((word, four, five)))
        for text, a, b in zip(texts_, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            words = np.unique(word[a:b])
            stats = wordhash.mix(np.array(_statistics(text, b - a, len(words)), _U) + _U(1 << 40)) >> shift
            out.append(np.unique(np.concatenate((words, four[a:b], five[a:b], stats))).astype(np.uint32))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Model:
    """Feature numbers (sorted), their weights, and the ordered thresholds."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> None:
        self.known, self.weights, self.cuts = known, weights, cuts

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows or not len(self.known):
            return np.zeros(len(rows))
        every = np.concatenate(rows)
        at = np.minimum(np.searchsorted(self.known, every), len(self.known) - 1)
        value = np.where(self.known[at] == every, self.weights[at], 0.0)
        # summed row by row, so a score does not depend on its batch
        return np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), weights=value, minlength=len(rows))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one row per score."""
        return _sigmoid(score[:, None] - self.cuts[None, :])


def fit(rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, grades: int, penalty: float = PENALTY,
        steps: int = STEPS, least_z: float = LEAST_Z) -> Model:
    """Penalised maximum likelihood by full gradients with per-weight step sizes (Adam)."""
    known, seen = np.unique(np.concatenate(rows), return_counts=True)
    z = np.zeros(len(known))
    for k in range(grades):
        chance = np.mean(grade == k)
        mine = [r for r, g in zip(rows, grade.tolist(), strict=True) if g == k]
        if not mine:
            continue
        number, count = np.unique(np.concatenate(mine), return_counts=True)
        here = np.zeros(len(known))
        here[np.searchsorted(known, number)] = count
        rest = np.maximum(1 - seen / len(rows), 1e-9)
        z = np.maximum(z, np.abs(here - seen * chance) / np.sqrt(np.maximum(seen * chance * (1 - chance) * rest, 1e-9)))
    known = known[(z >= min(least_z, LEAST_SHARE * np.sqrt(len(rows)))) & (seen < len(rows))]
    held = [np.flatnonzero(np.isin(known, r, assume_unique=True)) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(h) for h in held])
    col = np.concatenate(held)
    w = np.zeros(len(known))
    share = np.array([weight[grade >= k].sum() / weight.sum() for k in range(1, grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    # thresholds as a first value and positive gaps, so they stay in order
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    params = np.concatenate((w, cuts[:1], gaps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    weight = weight / weight.sum()
    n = len(known)
    for step in range(1, steps + 1):
        w, cuts = params[:n], np.concatenate((params[n:n + 1], params[n] + np.cumsum(np.exp(params[n + 1:]))))
        score = np.bincount(row, weights=w[col], minlength=len(rows))
        edge = np.concatenate((np.full((len(rows), 1), 1.0), _sigmoid(score[:, None] - cuts[None, :]),
                               np.zeros((len(rows), 1))), axis=1)  # P(grade >= k), k = 0 .. K
        at = np.arange(len(rows))
        upper, lower = edge[at, grade], edge[at, grade + 1]
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = -weight * (d_upper - d_lower)
        d_cut = np.zeros(grades - 1)
        np.add.at(d_cut, np.maximum(grade - 1, 0), np.where(grade > 0, weight * d_upper, 0))
        np.add.at(d_cut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -weight * d_lower, 0))
        grad = np.concatenate((np.bincount(col, weights=d_score[row], minlength=n) + penalty * w,
                               [d_cut.sum()], np.cumsum(d_cut[::-1])[::-1][1:] * np.exp(params[n + 1:])))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params = params - 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    cuts = np.concatenate((params[n:n + 1], params[n] + np.cumsum(np.exp(params[n + 1:]))))
    return Model(known, params[:n], cuts)


def _features_of(docs: DataFrame, extra: str) -> DataFrame:
    """(extra, f): feature numbers as bytes, per row of (extra, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(extra).cast(pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             [extra, "f"])
    return docs.mapInArrow(run, f"{extra} int, f binary")


def train(docs: DataFrame, rated: DataFrame, grades: int = 3, per_grade: int = PER_GRADE, **options) -> Model | None:
    """Fit on (doc_id, text) and (doc_id, grade); None if fewer than two grades occur."""
    rated = rated.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("grade").cast("int").alias("grade"))
    share = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}  # one row per grade
    if len(share) < 2:
        return None
    parts = [rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
             for g in sorted(share)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # at most grades * per_grade ids, and one text of each: of rows that repeat an id, the text that hashes lowest
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.max("grade").alias("grade"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    sample = sample.select("grade", "one.text")
    got = _features_of(sample, "grade").collect()  # at most grades * per_grade rows
    grade = np.array([r["grade"] for r in got], np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    # the same order, and so the same sums, in every run
    order = sorted(range(len(got)), key=lambda k: (grade[k], hashlib.md5(got[k]["f"]).digest()))
    rows = [np.frombuffer(got[k]["f"], np.uint32) for k in order]
    grade = grade[order]
    del got
    count = np.bincount(grade, minlength=grades)
    weight = np.array([share.get(g, 0) / max(count[g], 1) for g in range(grades)])[grade]
    return fit(rows, grade, weight, grades, **options)


def grade_of(labels: DataFrame) -> Column:
    """Grades of (quality, toxic): 0 poor, 1 well written but toxic, 2 good."""
    return F.when(labels["quality"] == 0, 0).when(labels["toxic"] == 1, 1).when(
        (labels["quality"] == 1) & (labels["toxic"] == 0), 2)


def classify(docs: DataFrame, rated: DataFrame, grades: int = 3, keep: float = KEEP, per_grade: int = PER_GRADE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade, p_top, kept of every document; rated: (doc_id, grade)."""
    arrow_batches(docs.sparkSession)
    plain = texts(docs, id_col, text_col)
    model = train(plain, rated, grades, per_grade)
    if model is None:
        none = F.lit(None).cast("double")
        return plain.select("doc_id", none.alias("score"), none.alias("expected_grade"), none.alias("p_top"),
                            F.lit(True).alias("kept"))
    out = plain.select("doc_id", scored(docs.sparkSession, model)("text").alias("s")).select("doc_id", "s.*")
    return out.withColumn("kept", F.col("p_top") >= keep if len(model.known) else F.lit(True))


def scored(spark: SparkSession, model: Model):
    """Column function of texts: struct of score, expected_grade and p_top (nulls are empty texts)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, expected_grade double, p_top double")
    def run(text: pd.Series) -> pd.DataFrame:
        score = shared.value.score(features([t.encode() if t else b"" for t in text]))
        tails = shared.value.tails(score)
        return pd.DataFrame({"score": score, "expected_grade": tails.sum(axis=1), "p_top": tails[:, -1]})

    return run
