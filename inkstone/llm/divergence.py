"""Source divergence audit by count-cell ranking.

Every (lang, source) group gives each kept term of its language a smoothed
probability in billionths, p = 1 + floor(10^9 (count + 5) / (N + 5 V)); the
audit reports how far the sources of a language lie apart (part ``pair``) and
which terms a source uses more than its language does (part ``term``).

p depends on a term's count alone, so terms are not scored one by one: those of
a group with the same (group count, lang count) form a cell with a multiplicity,
the difference f is evaluated once per cell, cells of equal value merge, and a
running total of multiplicities says which values reach the wanted ranks.  Only
the terms of those cells are expanded, in UTF-8 order within a value.  Sums over
all terms for two sources are sums over cells (count here, count there) in the
same way: cells in which one count is 0 follow from each source's histogram of
counts, so terms that a source lacks are never listed.

Counting combines in the task first: a worker holds at most ``HELD`` (group,
term) counts and hands them on when they are full.  All arithmetic is on whole
numbers (products as decimals, beyond 64 bits).

Edge cases: null text, lang and source are empty strings; a group without terms
takes part with count 0 everywhere; a language without kept terms has pairs of
value 0 and no term rows; rows that repeat a doc_id are documents each (ids are
not read); terms may be of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_batches, stored

#: Documents of a language that must hold a term.
LEAST_DOCS = 30
#: Added to every count.
PRIOR = 5
SCALE = 1_000_000_000
#: Ranks of part ``term`` (a top-k report).
TOP = 50
#: (group, term) counts that a worker holds before it hands them on.
HELD = 300_000
#: ASCII letters and every byte of other characters; the text's bytes are in lower case (A-Z only).
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) combined over what a worker holds; the empty term counts a group's documents."""
    seen: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def flush():
        for (lang, source), terms in seen.items():
            names = list(terms)
            for k in range(0, len(names), 50_000):
                part = names[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[w] for w in part], pa.int64()),
                     pa.array([docs[lang, source][w] for w in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])
        seen.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            words = _TERM.findall(text.lower())
            if (lang, source) not in seen:
                seen[lang, source], docs[lang, source] = Counter({b"": 0}), Counter()
            n, d = seen[lang, source], docs[lang, source]
            held -= len(n)
            n.update(words)
            d.update(set(words))
            d[b""] += 1
            held += len(n)
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs), one row per group and term, and one per group with the empty term; dealt by (lang, term)."""
    arrow_batches(docs.sparkSession)

    def plain(name):
        return F.coalesce(docs[name].cast("string"), F.lit(""))

    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"),
                       plain(text_col).cast("binary").alias("text"))
    rows = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), exactly."""
    top = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + PRIOR * terms).cast("decimal(20,0)"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: see the module's text."""
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, lang_col, source_col, text_col)
    # one shuffle serves the counts and their sums over a language
    counts = counts.withColumn("all_n", F.sum("n").over(by_term)).withColumn(
        "all_docs", F.sum("docs").over(by_term)).withColumn("first", F.min("source").over(by_term) == F.col("source"))
    counts = stored(counts.where((F.col("term") == "") | (F.col("all_docs") >= least_docs)).select(
        "lang", "source", "term", "n", "all_n", "first"), "term-counts")
    kept = counts.where("term <> ''")

    of_lang = counts.groupBy("lang").agg(
        F.sum((F.col("first") & (F.col("term") != "")).cast("long")).alias("v"),
        F.sum(F.when(F.col("first"), F.col("all_n")).otherwise(0)).alias("lang_n"))
    groups = stored(counts.groupBy("lang", "source").agg(
        F.sum("n").alias("group_n"), F.sum((F.col("term") != "").cast("long")).alias("used")).join(of_lang, "lang"), "groups")
    return _pairs(kept, groups).unionByName(_terms(kept, groups, top))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    key = ["lang", "source"]
    cells = kept.groupBy(*key, "n", "all_n").agg(F.count(F.lit(1)).alias("m")).join(groups, key)
    f = probability(F.col("n"), F.col("group_n"), F.col("v")) - probability(F.col("all_n"), F.col("lang_n"), F.col("v"))
    cells = stored(cells.select(*key, "n", "all_n", "m", f.alias("value")).where("value > 0"), "cells")
    # cells of equal value merge; a value is wanted if fewer than ``top`` terms lie before it
    upto = Window.partitionBy(*key).orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    values = cells.groupBy(*key, "value").agg(F.sum("m").alias("m")).withColumn(
        "before", F.sum("m").over(upto) - F.col("m")).where(F.col("before") < top)
    wanted = cells.drop("m").join(values.select(*key, "value"), [*key, "value"], "left_semi")
    terms = kept.select(*key, "n", "all_n", "term").join(wanted, [*key, "n", "all_n"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("value").desc(), "term"))
    return terms.withColumn("rank", rank).where(F.col("rank") <= top).select(
        *key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum of f over all kept terms for any two sources of a language, as cells (n, other_n) with signed multiplicity."""
    slim = kept.select("lang", "term", "source", "n")
    other = slim.select("lang", "term", F.col("source").alias("other"), F.col("n").alias("other_n"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = slim.join(other, ["lang", "term"]).where("source < other").groupBy(
        "lang", "source", "other", "n", "other_n").agg(F.count(F.lit(1)).alias("m"))
    # a term of both sources leaves the cells in which one count is 0, and was counted once too often as lacking in both
    moved = F.array(*[F.struct(n.alias("n"), o.alias("other_n"), m.alias("m")) for n, o, m in (
        (F.col("n"), F.col("other_n"), F.col("m")), (F.col("n"), zero, -F.col("m")), (zero, F.col("other_n"), -F.col("m")),
        (zero, zero, F.col("m")))])
    both = both.select("lang", "source", "other", F.inline(moved))
    names = groups.select("lang", "source", "v", "used")
    couples = names.join(names.select("lang", F.col("source").alias("other"), F.col("used").alias("other_used")),
                         "lang").where("source < other")
    histogram = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    left = couples.select("lang", "source", "other").join(histogram, ["lang", "source"]).select(
        "lang", "source", "other", "n", zero.alias("other_n"), "m")
    right = couples.select("lang", "source", "other").join(
        histogram.select("lang", F.col("source").alias("other"), F.col("n").alias("other_n"), "m"), ["lang", "other"]).select(
        "lang", "source", "other", zero.alias("n"), "other_n", "m")
    none = couples.select("lang", "source", "other", zero.alias("n"), zero.alias("other_n"),
                          (F.col("v") - F.col("used") - F.col("other_used")).alias("m"))
    # (0, 0) rows also keep couples of languages without any kept term
    cells = both.unionByName(left).unionByName(right).unionByName(none).groupBy(
        "lang", "source", "other", "n", "other_n").agg(F.sum("m").alias("m"))
    total = groups.select("lang", "source", "group_n", "v")
    cells = cells.join(total, ["lang", "source"]).join(
        total.select("lang", F.col("source").alias("other"), F.col("group_n").alias("other_total")), ["lang", "other"])
    f = F.abs(probability(F.col("n"), F.col("group_n"), F.col("v"))
              - probability(F.col("other_n"), F.col("other_total"), F.col("v")))
    value = F.sum(F.when(F.col("v") > 0, F.col("m") * f).otherwise(0)).cast("long")
    sums = stored(cells.groupBy("lang", "source", "other").agg(value.alias("value")), "pairs")
    sums = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "other"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value",
                       rank.alias("rank"))


#: The same in DuckDB SQL, over every group and kept term.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total
  FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
used AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
grp AS (
  SELECT g.lang, g.source, coalesce(sum(u.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN used u ON g.lang = u.lang AND g.source = u.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (g.total + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM grp g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY coalesce(value, 0) DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT),
         row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
