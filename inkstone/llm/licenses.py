"""License scans by diagonal voting.

Every rolling word pair of every text is hashed and joined with the positions
of the same pair in the license templates.  A hit votes for its diagonal (word
position in the text minus position in the template).  A full vote on one
diagonal is a place where a template stands word for word; neighbouring
diagonals are merged, so inserted or missing words do not break a longer
notice, and a merged span counts if it covers enough of the template.  Spans
are verified on the words themselves: the hash only selects, the join compares
the pair's words.  Only DataFrame functions are used.

Words: A-Z in lower case, then runs of digits, a-z and everything beyond ASCII.

Base phrases count at every place.  The method's own templates add labels.
Pairs of two very common words are no template positions (they would hit
everywhere); coverage counts the remaining pairs.

Edge cases: a null or empty text has no words and score 0; an empty table
gives an empty result; rows that repeat both doc_id and text are scanned
once and returned as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.llm.common import texts

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening words of public license notices, and the label of each.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
)

#: Pairs of two of these are left out of the longer templates.
COMMON = frozenset("a an and are as at by for in is it of on or that the this to with you".split())
#: Share of a template's pairs that a merged span must cover.
COVER = 0.75
#: Templates of at most so many pairs must be covered in full: a single word tells short notices apart.
SHORT = 8
#: Diagonals at most so many words apart are merged.
SLACK = 3

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The only character outside ASCII whose lower case is a plain letter (k); it must stay outside.
KELVIN = "K"
_MARK = "\x00"


def template_rows() -> list[tuple[int, str, bool, int, int, str]]:
    """(tid, label, base, pairs of the template, position, pair of words)."""
    rows = []
    for tid, (phrase, label, base) in enumerate([(*b, True) for b in BASE] + [(*t, False) for t in TEMPLATES]):
        w = phrase.split()
        grams = [(p, f"{w[p]} {w[p + 1]}") for p in range(len(w) - 1)
                 if base or not {w[p], w[p + 1]} <= COMMON]
        rows += [(tid, label, base, len(grams), p, g) for p, g in grams]
    return rows


def template_positions(spark: SparkSession) -> DataFrame:
    """The template table: a fixed list of a few hundred rows, whatever the corpus."""
    rows = spark.createDataFrame(
        [*template_rows(), (-1, "", False, 0, 0, _MARK)],
        "tid int, label string, base boolean, pairs int, tpos int, tgram string")
    return rows.withColumn("thash", F.xxhash64("tgram"))


def words(text: Column) -> Column:
    plain = F.lower(F.replace(text, F.lit(KELVIN), F.lit("é")))
    return F.array_remove(F.split(plain, SEPARATORS), "")


def _pairs(w: Column) -> Column:
    """All word pairs with hash and place, and a mark that carries the number of words."""
    rolled = F.transform(w, lambda x, i: F.struct(
        i.alias("dpos"), F.concat_ws(" ", x, F.get(w, i + 1)).alias("gram")))
    return F.concat(rolled, F.array(F.struct(F.size(w).alias("dpos"), F.lit(_MARK).alias("gram"))))


def scan(docs: DataFrame, cover: float = COVER, slack: int = SLACK, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    One pass over the texts and one shuffle of the hits: each document's mark
    meets a row of the template table too, so documents without any hit stay.
    """
    spark = docs.sparkSession
    plain = texts(docs, id_col, text_col)
    w = plain.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    grams = w.select("doc_id", "h", F.explode(F.transform(F.array("w"), _pairs)[0]).alias("g")).select(
        "doc_id", "h", "g.dpos", "g.gram", F.xxhash64("g.gram").alias("hash"))
    t = template_positions(spark)
    # the template table is a constant of this module
    hits = grams.join(F.broadcast(t), (F.col("hash") == F.col("thash")) & (F.col("gram") == F.col("tgram"))).select(
        "doc_id", "h", "tid", "label", "base", "pairs", "tpos", "dpos")
    hits = hits.groupBy("doc_id", "h", "tid", "label", "base", "pairs", "tpos", "dpos").agg(
        F.count(F.lit(1)).alias("n"))
    hits = hits.withColumn("diag", F.when(F.col("tid") >= 0, F.col("dpos") - F.col("tpos")))
    on = Window.partitionBy("doc_id", "h", "tid")
    hits = hits.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "h", "tid", "diag")))
    gap = F.col("diag") - F.lag("diag").over(on.orderBy("diag", "tpos"))
    hits = hits.withColumn("new", F.when(gap <= slack, 0).otherwise(1)).withColumn(
        "span", F.sum("new").over(on.orderBy("diag", "tpos").rowsBetween(Window.unboundedPreceding, 0)))
    full = F.col("base") & (F.col("votes") == F.col("pairs"))
    spans = hits.groupBy("doc_id", "h", "tid", "label", "base", "pairs", "span").agg(
        F.max("n").alias("times"), F.max("dpos").alias("n_words"),
        F.count_distinct("tpos").alias("covered"),
        F.count(F.when(full & (F.col("tpos") == 0), 1)).alias("places"),
        F.min(F.when(full, F.col("diag"))).alias("first"), F.max(F.when(full, F.col("diag"))).alias("last"),
        F.min("dpos").alias("start"), (F.max("dpos") + 2).alias("end"))
    share = F.col("covered") / F.col("pairs")
    found = (F.col("tid") >= 0) & F.when(F.col("base"), F.col("places") > 0).otherwise(
        (share >= cover) & ((F.col("pairs") > SHORT) | (share == 1)))
    label = F.when(found, F.col("label"))
    base_label = F.when(found & F.col("base"), F.col("label"))
    out = spans.groupBy("doc_id", "h").agg(
        F.max(F.when(F.col("tid") < 0, F.col("n_words"))).cast("long").alias("n_words"),
        F.max(F.when(F.col("tid") < 0, F.col("times"))).alias("times"),
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base_label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct("start", "end", "label")))).alias("spans"))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("h", "times", "time")


def _values() -> str:
    return ",\n".join(f"({t}, '{lab}', {str(b).lower()}, {n}, {p}, '{g}')" for t, lab, b, n, p, g in template_rows())


#: The same computation in DuckDB SQL.
SQL = f"""
WITH t(tid, label, base, pairs, tpos, tgram) AS (VALUES {_values()}),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM w),
hits AS (
  SELECT doc_id, tid, label, base, pairs, tpos, i - 1 AS dpos, i - 1 - tpos AS diag
  FROM g JOIN t ON t.tgram = w[i] || ' ' || w[i + 1]),
voted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, tid, diag) AS votes,
         CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag, tpos) <= {SLACK} THEN 0 ELSE 1 END AS new
  FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diag, tpos ROWS UNBOUNDED PRECEDING) AS span FROM voted),
spans AS (
  SELECT doc_id, tid, label, base, pairs, span, count(DISTINCT tpos) AS covered,
         count(*) FILTER (WHERE base AND votes = pairs AND tpos = 0) AS places,
         min(diag) FILTER (WHERE base AND votes = pairs) AS first_word,
         max(diag) FILTER (WHERE base AND votes = pairs) AS last_word
  FROM numbered GROUP BY ALL),
found AS (
  SELECT *, covered / pairs AS share, CASE WHEN base THEN places > 0
         ELSE covered / pairs >= {COVER} AND (pairs > {SHORT} OR covered = pairs) END AS found FROM spans),
agg AS (
  SELECT doc_id, sum(places) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE found AND base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE found)), ',') AS labels,
         max(share) FILTER (WHERE found) AS score
  FROM found GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN agg ON agg.doc_id = w.doc_id
"""
