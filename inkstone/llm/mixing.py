"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Within it a document is expected
``scale * weight`` times, ``max_copies`` at most; the source's scale is such that
the expected words add up to the target.  Weights are those of a column, or,
with ``by_size``, the binary digits of the document's size, so that longer
documents are likelier; without either all are equal.  The whole part of that
number is taken for certain.  The fraction is an inclusion probability p,
different for documents of different weight: they are ranked by

    (u / (1 - u)) / (p / (1 - p)),   u = a hash of the doc_id, uniform in (0, 1)

and the lowest ranks fill what the whole copies leave open, up to the document
that would overrun it; one closing document, the one whose size comes nearest
to the rest, is added if that brings the source nearer to its target.  The
draw depends on doc_id and seed alone, so reruns agree.

The place where a source's running total crosses its target is found from
totals of 65,536 rank bins per source, combined before the shuffle; only the
documents of the crossing bin are put in order.

Edge cases: a null or wordless text has size 0 and is taken 0 times; a source
without words has target 0; null is a source like any other and comes last;
rows that repeat a doc_id share its draw; an empty table gives an empty
result; a null or negative weight counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import WORD, stored
from inkstone.operators.tables import sequential_ids

#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 65_536
#: Join keys that one source is dealt over, so a source with a third of all rows is no single task.
SALTS = 64


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1) from 52 bits of an MD5 digest (any SQL engine can repeat it)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def _per_source(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row per source (column ``key``, dropped): every source is dealt over ``SALTS`` keys."""
    salted = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    on = dealt["source"].eqNullSafe(salted[key]) & (dealt["salt"] == salted["salt_"])
    return dealt.join(salted, on, how).drop(key, "salt", "salt_")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources are ranked by code point, null last.  A target stops at
    ``max_copies`` times its source's words; the excess is shared again by
    weight, until no target is above.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = sequential_ids(src, [F.col("source").asc_nulls_last()], "rank")
    rank = F.col("rank") - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = stored(src.select("source", "source_size", pick.alias("w"),
                            (F.col("source_size") * max_copies).cast("double").alias("cap")), "sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0  # words per unit of weight
    while True:
        full = F.col("cap") < F.col("w") * share
        caps, open_w = src.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
                               F.sum(F.when(~full, F.col("w")))).first()
        now = (float(total) - caps) / open_w if open_w else share
        if now <= share:
            break
        share = now
    return src.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(share)).alias("target"))


def scales(sized: DataFrame, goal: DataFrame, max_copies: int) -> DataFrame:
    """(scale_of, scale): per source, the number that weights are multiplied with.

    Documents of the largest weights reach ``max_copies`` first.  With the heaviest weights down to some level full,
    the others share what is left of the target; the scale is that of the first level that then stays below the most.
    """
    level = sized.where("size > 0 AND weight > 0").groupBy(F.col("source").alias("scale_of"), "weight").agg(
        F.sum("size").alias("words"))
    down = Window.partitionBy("scale_of").orderBy(F.col("weight").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(0, Window.unboundedFollowing)
    level = level.withColumn("full", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn(
        "open", F.sum(F.col("weight") * F.col("words")).over(after))
    level = level.join(goal.select(F.col("source").alias("g"), "target"), F.col("scale_of").eqNullSafe(F.col("g")))
    scale = (F.col("target") - max_copies * F.col("full")) / F.col("open")
    return level.withColumn("scale", scale).where(F.col("scale") * F.col("weight") <= max_copies).groupBy("scale_of").agg(
        F.max_by("scale", "weight").alias("scale"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7, bins: int = BINS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None, by_size: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document."""
    size = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long")
    if weight_col:  # three digits: a source has a bounded number of weights, however many documents
        weight = F.format_string("%.2e", F.greatest(F.coalesce(docs[weight_col].cast("double"), F.lit(0.0)), F.lit(0.0))).cast("double")
    else:
        weight = F.length(F.bin(size)).cast("double") if by_size else F.lit(1.0)
    sized = stored(docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"),
                               size.alias("size"), weight.alias("weight")), "sizes")
    goal = targets(sized, weights, max_copies)
    goal = goal.join(scales(sized, goal, max_copies), goal["source"].eqNullSafe(F.col("scale_of")), "left").drop(
        "scale_of").withColumnRenamed("source", "s")
    goal = stored(goal, "goal")  # a row per source; every use below would otherwise carry its whole plan
    # without a scale even all copies of all documents stay below the target
    wanted = F.when(F.col("weight") <= 0, 0.0).when(
        F.col("scale").isNull() | (F.col("target") >= F.col("source_size") * max_copies), F.lit(float(max_copies))).otherwise(
        F.least(F.lit(float(max_copies)), F.col("scale") * F.col("weight")))
    rows = _per_source(sized, goal, "s").withColumn("wanted", wanted)
    rows = rows.withColumn("whole", F.floor("wanted")).withColumn("p", F.col("wanted") - F.col("whole"))
    u = draw(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # rank in (0, 1): the odds ratio on a bounded scale, in the same order
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds)))
    rows = rows.withColumn("bin", F.floor(F.col("rank") * bins)).drop("scale", "wanted", "weight")

    # what whole copies leave open, and the bin in which the running total crosses it
    per_bin = rows.groupBy("source", "bin").agg(
        F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"),
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("loose"))
    by_source = Window.partitionBy("source")
    upto = by_source.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    per_bin = per_bin.withColumn("rest", F.col("target") - F.sum("sure").over(by_source)).withColumn(
        "before", F.sum("loose").over(upto) - F.col("loose"))
    crossing = per_bin.where("bin IS NOT NULL AND before <= rest AND before + loose > rest").select(
        F.col("source").alias("s"), F.col("bin").alias("cross"), "before")
    rest = per_bin.groupBy(F.col("source").alias("s1")).agg(F.max("rest").alias("rest"))
    plan = stored(rest.join(crossing, F.col("s1").eqNullSafe(F.col("s")), "left").drop("s"), "crossing")  # a row per source
    rows = _per_source(rows, plan, "s1")

    inside = rows.where("bin = cross")
    running = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    inside = inside.withColumn("chosen", F.col("before") + F.sum("size").over(running) <= F.col("rest"))
    outside = rows.where("NOT coalesce(bin = cross, false)").withColumn(
        "chosen", F.coalesce((F.col("rest") > 0) & (F.col("cross").isNull() | (F.col("bin") < F.col("cross"))),
                             F.lit(False)) & F.col("rank").isNotNull())
    rows = stored(inside.unionByName(outside), "drawn")

    # one closing document per source: the one whose size comes nearest to what is still open
    gap = rows.groupBy(F.col("source").alias("s")).agg(
        (F.max("rest") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap"))
    spare = rows.where("rank IS NOT NULL AND NOT chosen")
    spare = _per_source(spare, gap, "s").withColumn("miss", F.abs(F.col("gap") - F.col("size")))
    close = spare.where("miss < gap").groupBy(F.col("source").alias("s2")).agg(
        F.min(F.struct("miss", "rank", "doc_id")).alias("best")).select("s2", F.col("best.rank").alias("best_rank"),
                                                                        F.col("best.doc_id").alias("best_id"))
    rows = _per_source(rows, close, "s2", "left")
    extra = F.col("chosen") | F.coalesce(
        (F.col("rank") == F.col("best_rank")) & F.col("doc_id").eqNullSafe(F.col("best_id")), F.lit(False))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
                       (copies * F.col("size")).cast("long").alias("taken"))


#: The same computation in DuckDB SQL (weights 5, 2, 1; seed 7; by size).
SQL = """
WITH sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY source),
fill AS (
  SELECT *, 3.0 * source_size AS cap,
         sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / w, source ROWS UNBOUNDED PRECEDING) AS caps,
         sum(w) OVER () - sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS UNBOUNDED PRECEDING) AS open_w,
         sum(source_size) OVER () AS total
  FROM src),
water AS (
  SELECT min(x) AS share FROM (
    SELECT (total - caps) / open_w AS x, caps, open_w, 3.0 * source_size / w AS r,
           lead(3.0 * source_size / w) OVER (ORDER BY 3.0 * source_size / w, source) AS nxt FROM fill WHERE open_w > 0
    UNION ALL SELECT max(total) / max(tw), 0, 0, 0, min(r) FROM (
      SELECT total, sum(w) OVER () AS tw, 3.0 * source_size / w AS r FROM fill))
  WHERE x >= r AND x <= coalesce(nxt, 1e300)),
goal AS (SELECT source, source_size, least(3.0 * source_size, w * share)::DOUBLE AS target FROM src, water),
level AS (
  SELECT source, length(bin(size)) AS weight, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY ALL),
stair AS (
  SELECT l.source, l.weight, g.target,
         coalesce(sum(words) OVER (PARTITION BY l.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
         sum(weight * words) OVER (PARTITION BY l.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
  FROM level l JOIN goal g ON l.source IS NOT DISTINCT FROM g.source),
scale AS (
  SELECT source, max_by((target - 3 * used) / open, weight) AS scale FROM stair
  WHERE (target - 3 * used) / open * weight <= 3 GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         CASE WHEN c.scale IS NULL OR g.target >= 3.0 * g.source_size THEN 3.0::DOUBLE
              ELSE least(3.0::DOUBLE, c.scale * length(bin(d.size))) END AS wanted,
         (('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
  LEFT JOIN scale c ON d.source IS NOT DISTINCT FROM c.source),
odds AS (
  SELECT *, floor(wanted) AS whole,
         CASE WHEN wanted > floor(wanted) AND size > 0
              THEN (u / (1 - u)) / ((wanted - floor(wanted)) / (1 - (wanted - floor(wanted)))) END AS q FROM drawn),
run AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
         sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (
           PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM odds),
chosen AS (SELECT *, q IS NOT NULL AND rest > 0 AND upto <= rest AS chosen FROM run),
gap AS (
  SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM chosen),
near AS (
  SELECT *, row_number() OVER (
    PARTITION BY source ORDER BY q IS NULL OR chosen OR abs(gap - size) >= gap, abs(gap - size), q, doc_id) AS nth
  FROM gap)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST((whole + CASE WHEN chosen OR (nth = 1 AND q IS NOT NULL AND abs(gap - size) < gap) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM near
"""
