"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every distinct 64-bit shingle hash below a fixed fraction of
the hash range.  Whether a hash is held never depends on the document, so a
union of sketches is the sketch of the union, and shared hashes estimate
containment between texts of very unequal length.  The smallest hash is held
as well, so that short texts have a fingerprint too (a union keeps the minimum).
Only DataFrame functions are used.

Words are runs without blanks and x09 to x0D of the lower-cased text; shingles
take five words, a text of fewer words is one shingle, a text without words
has an empty sketch.  Two empty sketches are alike (1.0), an empty and a
filled one are not (0.0).

Edge cases: a null text is an empty text; a table of one document is its own
next document; an empty table gives an empty result; rows that repeat both
doc_id and text count once in that order and are returned as often as they
occur; different texts under one doc_id follow each other
by text hash; a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import SPACE, code_points, stored, texts
from inkstone.operators.tables import sequential_ids

SHINGLE = 5
#: One in so many hashes is held.
SCALE = 8


def sketch(text: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted array of the held shingle hashes of ``text``."""
    words = F.array_remove(F.split(F.lower(text), SPACE), "")
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))),
                       lambda h: _held(h, scale, shingle))[0]


def _held(h: Column, scale: int, shingle: int) -> Column:
    """``h``: word hashes; bound once by the caller's lambda, so they are computed once."""
    limit = F.lit(-(2 ** 63) + 2 ** 64 // scale).cast("long")
    rolled = F.transform(F.sequence(F.lit(0), F.size(h) - shingle),
                         lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
    every = F.when(F.size(h) >= shingle, rolled).when(
        F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
    return F.transform(F.array(every), lambda s: F.array_sort(F.array_distinct(F.concat(
        F.filter(s, lambda x: x < limit), F.filter(F.array(F.array_min(s)), lambda x: x.isNotNull())))))[0]


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts taken together, from their sketches."""
    limit = F.lit(-(2 ** 63) + 2 ** 64 // scale).cast("long")
    both = F.array_sort(F.array_union(a, b))
    return F.filter(both, lambda x, i: (x < limit) | (i == 0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds, 0 to 1 (1 if ``a`` is empty)."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def printed(held: Column) -> Column:
    return F.array_join(F.transform(held, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def fingerprints(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (string) of every document."""
    return texts(docs, id_col, text_col).select(
        "doc_id", code_points(F.col("text")).alias("n_chars"), printed(sketch(F.col("text"), scale)).alias("fingerprint"))


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, next_id, next_h) for (doc_id, text): who follows whom, by ascending doc_id, last to first.

    Only ids, text hashes and lengths are ordered, by range partitions.
    """
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"), code_points(F.col("text")).alias("n")).distinct()
    seq = stored(sequential_ids(ids, ["doc_id", "h"], "seq"), "order")
    total = seq.count()
    follow = seq.select(F.when(F.col("seq") == 1, F.lit(total)).otherwise(F.col("seq") - 1).alias("seq"),
                        F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    return seq.join(follow, "seq").drop("seq")


def _name(doc_id: str) -> Column:
    """A doc_id as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))


def edit_likeness(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text is the text with its last quarter (rounded down, code
    points) replaced by the first as many of the next document.  Texts move
    once, by doc_id and text hash; what travels from a document to its
    predecessor is the part of its text that the predecessor takes, and its sketch.
    """
    plain = texts(docs, id_col, text_col)
    order = next_documents(plain)
    # the same three columns on both sides of the second join, so that texts move in one exchange; the rest is made behind it
    full = plain.select("text", _name("doc_id").alias("name"), F.xxhash64("text").alias("h"))
    takes = order.select(_name("next_id").alias("name"), F.col("next_h").alias("h"), "doc_id",
                         _name("doc_id").alias("prev_name"), F.col("h").alias("prev_h"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    given = full.join(takes, ["name", "h"]).select(
        "doc_id", F.col("prev_name").alias("name"), F.col("prev_h").alias("h"),
        F.col("text").substr(F.lit(1), F.col("take")).alias("tail"), sketch(F.col("text"), scale).alias("next_held"))
    given = given.dropDuplicates(["name", "h"])
    pairs = full.join(given, ["name", "h"]).withColumn("held", sketch(F.col("text"), scale))
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 4).cast("int")), F.col("tail"))
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "held", "next_held")
    out = out.withColumn("edited_held", sketch(F.col("edited"), scale))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("held")).alias("fingerprint"),
        printed(F.col("edited_held")).alias("edited_fingerprint"),
        likeness(F.col("held"), F.col("edited_held")).alias("near_edited"),
        likeness(F.col("held"), F.col("next_held")).alias("near_next"),
        containment(F.col("held"), F.col("edited_held")).alias("contained_edited"),
        containment(F.col("held"), F.col("next_held")).alias("contained_next"))
