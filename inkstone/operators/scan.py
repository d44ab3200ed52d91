"""Injection-pattern scans: ordered ``rlike`` chains evaluated JVM-side.

A ``CASE WHEN`` chain stops at the first matching pattern, so the common
"first pattern id" question costs only as many regex scans as needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import regexes as R


def first_match(text: Column, patterns: list[str], folded: Column | None = None,
                gates: list[tuple[list[str], list[str]]] | None = None) -> Column:
    """1-based index of the first pattern that matches, NULL when none does.

    With ``gates``, a pattern is tried only where ``folded`` (the text in lower
    case) contains one of its strings and all of its signs.
    """
    expr = None
    for i, p in enumerate(patterns, start=1):
        cond = text.rlike(p)
        if gates is not None:
            strings, signs = gates[i - 1]
            if strings:
                cond = reduce(lambda a, b: a | b, [folded.contains(s) for s in strings]) & cond
            cond = reduce(lambda a, b: b & a, [folded.contains(s) for s in signs], cond)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def injection_scan(df: DataFrame, text_col: str = "text", patterns: list[str] | None = None) -> DataFrame:
    """Adds (matched, first_pattern) for the server-side pattern list.

    Its patterns are tried only where strings that their matches contain occur;
    patterns of one's own are all tried.
    """
    if patterns is not None:
        out = df.withColumn("first_pattern", first_match(F.col(text_col), patterns))
    else:
        # the patterns fold case beyond ASCII: the long s has no lower case of its own
        low = df.withColumn("_low", F.translate(F.lower(text_col), "\u017f", "s"))
        out = low.withColumn("first_pattern", first_match(F.col(text_col), R.GO_JAVA, F.col("_low"), R.GO_GATES)).drop("_low")
    return out.withColumn("matched", F.col("first_pattern").isNotNull())


def injection_scan_families(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Browser-side list: (n_hits, first_pattern, families) per row.

    Every pattern is evaluated once into a 0/1 hit vector, its regex only where
    a string that every match contains occurs (the text is lower-cased once for
    that); the count, the first hit and the families are read from that vector.  ``families``
    lists, in table order, the families with at least one hit.
    """
    t = F.col(text_col)

    def hit(pattern: str, needles: list[str] | None, folded: bool) -> Column:
        if not needles:
            return t.rlike(pattern).cast("int")
        place = F.col("_low") if folded else t
        maybe = reduce(lambda a, b: a | b, [place.contains(n) for n in needles])
        return F.when(maybe, t.rlike(pattern).cast("int")).otherwise(F.when(t.isNotNull(), 0))

    low = df.select("*", F.lower(t).alias("_low"))
    hits = low.select("*", F.array(*[hit(p, *n) for (_, p), n in zip(R.UI_JAVA, R.UI_NEEDLES, strict=True)]).alias("_hits"))
    h = F.col("_hits")
    fam_hit = []
    for fam in R.UI_FAMILIES:
        idx = [i for i, (f, _) in enumerate(R.UI_JAVA) if f == fam]
        fam_hit.append(F.when(F.greatest(*[h[i] for i in idx]) == 1, F.lit(fam)) if len(idx) > 1
                       else F.when(h[idx[0]] == 1, F.lit(fam)))
    first = F.array_position(h, 1)
    return hits.select(
        *df.columns,
        F.aggregate(h, F.lit(0), lambda a, x: a + x).alias("n_hits"),
        F.when(first > 0, first.cast("int")).alias("first_pattern"),
        F.concat_ws(",", *fam_hit).alias("families"),
    )
