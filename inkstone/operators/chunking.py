"""Overlapping text chunking as per-row array expressions + one explode.

Everything is computed inside the row (``sequence`` / ``transform`` /
``flatten``) and turned into rows by a single ``posexplode``: no shuffle, no
Python.  Positions are code points (Spark ``length``/``substring``), byte
cuts use ``octet_length``.

Chunk geometry for size ``s``, overlap ``o`` (even, 1 < o < s),
step ``u = s - o``, half overlap ``h = o / 2``, for ``i = 0, u, 2u, ... < n``:
start = max(0, i - h), end = min(n, i + s - h), unique end = min(n, i + u).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.bind import let, let2, running_sums
from inkstone.sources.adapters import running_byte_cuts


def check_params(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be greater than 0")
    if overlap <= 1 or overlap >= size or overlap % 2 != 0:
        raise ValueError("chunk overlap must be an even number greater than 1 and less than chunk size")


def _offsets_in(n: Column, base: Column, size: int, overlap: int) -> Column:
    """array<struct(start, offset_left, offset_right, end)> for a text of length n at base.

    ``n`` and ``base`` are bound once per row (``let``): referenced inside
    the lambda they would be re-evaluated for every chunk.
    """
    u, h = size - overlap, overlap // 2
    typ = "array<struct<start:int,offset_left:int,offset_right:int,end:int>>"

    def build(n, base):
        def one(i):
            start = F.greatest(F.lit(0), i - h)
            return F.struct(
                (base + start).cast("int").alias("start"),
                (i - start).cast("int").alias("offset_left"),
                (F.least(n, i + u) - start).cast("int").alias("offset_right"),
                (base + F.least(n, i + size - h)).cast("int").alias("end"),
            )

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(u)), one)).otherwise(F.array().cast(typ))

    return let2(n, base, build)


def offsets(df: DataFrame, text_col: str = "content", id_col: str = "id", size: int = 256,
            overlap: int = 32) -> DataFrame:
    """2.6.1: (article_id, chunk_no, start, offset_left, offset_right, end) for whole texts."""
    check_params(size, overlap)
    arr = _offsets_in(F.length(text_col), F.lit(0), size, overlap)
    return (df.select(F.col(id_col).alias("article_id"), F.posexplode(arr).alias("chunk_no", "c"))
            .select("article_id", "chunk_no", "c.*"))


def paragraph_starts(paragraphs: Column) -> Column:
    """2.5.2: start of every paragraph, the exclusive running sum of code-point lengths."""
    return _prefix_exclusive(F.transform(paragraphs, lambda p: F.length(p)))


def _prefix_exclusive(lens: Column) -> Column:
    """[0, x1, x1+x2, ...], as long as ``lens``."""
    return let(running_sums(lens), lambda sums: F.when(F.size(sums) > 0, F.concat(
        F.array(F.lit(0)), F.slice(sums, 1, F.size(sums) - 1))).otherwise(sums))


def paragraph_offsets(df: DataFrame, paragraphs_col: str = "paragraphs", id_col: str = "id",
                      size: int = 256, overlap: int = 32) -> DataFrame:
    """2.6.2: chunk offsets inside each paragraph, shifted to article coordinates.

    Overlap never crosses a paragraph boundary; empty paragraphs produce none.
    """
    check_params(size, overlap)
    paras = F.col(paragraphs_col)
    starts = paragraph_starts(paras)
    per_para = F.transform(
        F.arrays_zip(paras.alias("p"), starts.alias("s")),
        lambda z: _offsets_in(F.length(z["p"]), z["s"], size, overlap))
    return (df.select(F.col(id_col).alias("article_id"), F.posexplode(F.flatten(per_para)).alias("chunk_no", "c"))
            .select("article_id", "chunk_no", "c.*"))


def paragraph_chunks(df: DataFrame, paragraphs_col: str = "paragraphs", id_col: str = "id",
                     size: int = 256, overlap: int = 32) -> DataFrame:
    """2.6.2 + 2.6.3 in one pass: offsets and the four text parts of every chunk.

    Chunks never cross paragraphs, so each text is cut from its own
    paragraph inside the row: no join back to the article text (which would
    shuffle the whole corpus) and substrings scan a paragraph, not the article.
    (article_id, chunk_no, start, offset_left, offset_right, end, chunk,
    left_overlap, unique, right_overlap)
    """
    check_params(size, overlap)
    paras = F.col(paragraphs_col)
    starts = paragraph_starts(paras)

    def per_para(z):
        def cut(p, base):
            offs = _offsets_in(F.length(p), F.lit(0), size, overlap)

            def one(o):
                s, e, ol, orr = o["start"], o["end"], o["offset_left"], o["offset_right"]
                return F.struct(
                    (base + s).cast("int").alias("start"), ol.alias("offset_left"), orr.alias("offset_right"),
                    (base + e).cast("int").alias("end"),
                    F.substring(p, s + 1, e - s).alias("chunk"),
                    F.when(ol > 0, F.substring(p, s + 1, ol)).otherwise(F.lit("")).alias("left_overlap"),
                    F.substring(p, s + ol + 1, orr - ol).alias("unique"),
                    F.when(orr < e - s, F.substring(p, s + orr + 1, e - s - orr)).otherwise(F.lit(""))
                    .alias("right_overlap"))

            return F.transform(offs, one)

        return let2(z["p"], z["s"], cut)

    arr = F.flatten(F.transform(F.arrays_zip(paras.alias("p"), starts.alias("s")), per_para))
    return (df.select(F.col(id_col).alias("article_id"), F.posexplode(arr).alias("chunk_no", "c"))
            .select("article_id", "chunk_no", "c.*"))


def parts(chunks: DataFrame, articles: DataFrame, content_col: str = "content") -> DataFrame:
    """2.3.1 + 2.6.3: join chunks to their article text and cut the four parts.

    (article_id, chunk_no, start, end, chunk, left_overlap, unique, right_overlap)
    """
    a = articles.select(F.col("id").alias("article_id"), F.col(content_col).alias("_content"))
    j = chunks.join(a, "article_id").filter(F.col("_content").isNotNull())
    c, s, e = F.col("_content"), F.col("start"), F.col("end")
    ol, orr = F.col("offset_left"), F.col("offset_right")
    return j.select(
        "article_id", "chunk_no", "start", "end",
        F.substring(c, s + 1, e - s).alias("chunk"),
        F.when(ol > 0, F.substring(c, s + 1, ol)).otherwise(F.lit("")).alias("left_overlap"),
        F.substring(c, s + ol + 1, orr - ol).alias("unique"),
        F.when(orr < e - s, F.substring(c, s + orr + 1, e - s - orr)).otherwise(F.lit("")).alias("right_overlap"),
    )


def _triples(text: Column, size: int, overlap: int) -> Column:
    """array<struct(left, body, right)> of the direct chunker; empty text -> one empty triple."""
    lo, lu = overlap // 2, size - overlap
    empty = F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("body"), F.lit("").alias("right")))

    def build(text, n):
        def one(lhs):
            rhs = F.least(lhs + lu, n)
            left_from = F.greatest(lhs - lo, F.lit(0))
            return F.struct(
                F.substring(text, left_from + 1, lhs - left_from).alias("left"),
                F.substring(text, lhs + 1, rhs - lhs).alias("body"),
                F.substring(text, rhs + 1, F.least(rhs + lo, n) - rhs).alias("right"),
            )

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(lu)), one)).otherwise(empty)

    return let2(text, F.length(text), build)


def text_triples(df: DataFrame, text_col: str = "content", id_col: str = "id", size: int = 256,
                 overlap: int = 32) -> DataFrame:
    """2.6.4: (article_id, chunk_no, left, body, right) straight from one text."""
    check_params(size, overlap)
    return (df.select(F.col(id_col).alias("article_id"),
                      F.posexplode(_triples(F.col(text_col), size, overlap)).alias("chunk_no", "t"))
            .select("article_id", "chunk_no", "t.*"))


def context_triples(df: DataFrame, paragraphs_col: str = "paragraphs", id_col: str = "id",
                    size: int = 256, overlap: int = 32, compat: bool = False) -> DataFrame:
    """2.5.3: chunk triples per paragraph, borrowing ``overlap/2`` code points of context
    from the neighbouring paragraphs.

    Short paragraphs (<= size - overlap) are one chunk; long ones use the
    direct chunker and replace the first chunk's left / last chunk's right
    context with the neighbour's.  ``compat=True`` reproduces the reference's
    long-paragraph rule that skips the left neighbour of the second paragraph.
    """
    check_params(size, overlap)
    lo, lu = overlap // 2, size - overlap
    min_left = 1 if compat else 0

    def per_para_in(paras, p, i):  # i is 0-based
        n_p = F.size(paras)
        prev = F.when(i > 0, F.try_element_at(paras, i)).otherwise(F.lit(None).cast("string"))
        nxt = F.when(i < n_p - 1, F.try_element_at(paras, i + 2)).otherwise(F.lit(None).cast("string"))
        prev_tail = F.when(prev.isNull(), F.lit("")).otherwise(
            F.substring(prev, F.greatest(F.length(prev) - lo, F.lit(0)) + 1, lo))
        next_head = F.when(nxt.isNull(), F.lit("")).otherwise(F.substring(nxt, 1, lo))
        short = F.array(F.struct(prev_tail.alias("left"), p.alias("body"), next_head.alias("right")))

        def chunks_of(n, heads):
            prev_tail, next_head = heads["l"], heads["r"]

            def chunk(lhs):
                rhs = F.least(lhs + lu, n)
                left_from = F.greatest(lhs - lo, F.lit(0))
                own_left = F.substring(p, left_from + 1, lhs - left_from)
                own_right = F.substring(p, rhs + 1, F.least(rhs + lo, n) - rhs)
                return F.struct(
                    F.when((lhs == 0) & (i > min_left), prev_tail).otherwise(own_left).alias("left"),
                    F.substring(p, lhs + 1, rhs - lhs).alias("body"),
                    F.when((rhs >= n) & (i < n_p - 1), next_head).otherwise(own_right).alias("right"))

            return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(lu)), chunk)

        typ = "array<struct<left:string,body:string,right:string>>"
        heads = F.struct(prev_tail.alias("l"), next_head.alias("r"))
        return let2(F.length(p), heads, lambda n, hs: F.when(n == 0, F.array().cast(typ))
                    .when(n <= lu, short).otherwise(chunks_of(n, hs)))

    all_chunks = let(F.col(paragraphs_col),
                     lambda paras: F.flatten(F.transform(paras, lambda p, i: per_para_in(paras, p, i))))
    return (df.select(F.col(id_col).alias("article_id"), F.posexplode(all_chunks).alias("chunk_no", "t"))
            .select("article_id", "chunk_no", "t.*"))


def byte_cuts(paragraphs: Column) -> Column:
    """2.5.1 / 2.9.3: cumulative UTF-8 byte lengths (the ``cuts`` column)."""
    return running_byte_cuts(paragraphs)


def split_by_cuts(text: Column, cuts: Column) -> Column:
    """2.9.3 inverse: slice text by byte cuts; empty pieces skipped; no cuts -> [text].

    The encoded bytes and the cuts are bound once per row, not once per piece.
    """
    def pieces(data: Column, ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
        kept = F.filter(F.arrays_zip(starts.alias("h"), ends.alias("t")), lambda z: z["t"] > z["h"])
        return F.transform(kept, lambda z: F.decode(F.substring(data, z["h"] + 1, z["t"] - z["h"]), "UTF-8"))

    split = let2(F.encode(text, "UTF-8"), cuts, pieces)
    return F.when(F.size(cuts) == 0, F.array(text)).otherwise(split)
