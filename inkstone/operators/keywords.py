"""Keyword analytics: tf-idf keywords, keyword structs, keyword-overlap ranking.

* ``topk_terms`` — texts are cut into terms once (``term_counts``), df per
  term is a partial aggregate.  The ``COMMON`` most frequent terms and their df
  go to the tasks; for any other term a document bounds df between 1 and the
  least of those, and sends only terms that can still be among its k best to
  the tf x df join, which is keyed by term (a hot term is handled by AQE's skew
  split).  Top-k per document via ``row_number``.
* ``overlap_topk`` — documents ranked by shared keywords, through an index of
  term subsets that keeps k + 1 rows per subset; no pairs inside a keyword's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_RE = r"\p{L}[\p{L}\p{N}]{2,}"
#: Runs of these scripts have no blanks between words; their tokens are pairs of neighbouring characters.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
CATEGORIES = ["themes", "events", "entities", "actions"]
PREFIX = {"themes": "theme", "events": "event", "entities": "entity", "actions": "action"}
MAX_PER_CATEGORY = 5
MAX_TERM_LEN = 32

KEYWORDS_SCHEMA = T.StructType([
    T.StructField("keywords", T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in CATEGORIES])),
    T.StructField("relations", T.ArrayType(T.StructType([
        T.StructField("entity1", T.StringType()),
        T.StructField("entity2", T.StringType()),
        T.StructField("relation", T.StringType()),
    ]))),
])


def tokens(text: Column) -> Column:
    """Lower-cased word tokens (a letter then >= 2 letters/digits), and character pairs of unspaced scripts."""
    low = F.lower(text)
    spaced = F.regexp_extract_all(F.regexp_replace(low, UNSPACED + "+", " "), F.lit(TOKEN_RE), 0)
    runs = F.regexp_extract_all(low, F.lit(UNSPACED + "{2,}"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.when(low.rlike(UNSPACED), F.concat(spaced, pairs)).otherwise(F.regexp_extract_all(low, F.lit(TOKEN_RE), 0))


def counted(toks: Column) -> Column:
    """Array of (term, tf) of a token array: sorted, then the lengths of equal runs (a document is one row, so
    term counts need no shuffle)."""
    from inkstone.functions.bind import let

    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(st, lambda p, j: F.struct(
            F.get(s, p).alias("term"), (F.coalesce(F.get(st, j + 1), n) - p).cast("long").alias("tf"))))

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.array_sort(toks), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


#: Most frequent terms whose df is sent to every task (some MB); results never depend on it.
COMMON = 100_000


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, terms, tfs): the distinct tokens of every row and how often each occurs, in no fixed order."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("toks")
            at = np.repeat(np.arange(len(toks)), pc.list_value_length(toks).fill_null(0).to_numpy(zero_copy_only=False))
            words = toks.flatten().dictionary_encode()
            width = max(len(words.dictionary), 1)
            pairs, n = np.unique(at * width + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(toks) + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(pairs % width))),
                 pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))], ["doc_id", "terms", "tfs"])

    toks = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
    return toks.mapInArrow(run, f"doc_id {kind}, terms array<string>, tfs array<long>")


def _candidates(counts: DataFrame, terms: list[str], dfs: list[int], n_docs: int, k: int) -> DataFrame:
    """(doc_id, term, tf) of the terms that can be among the k best of their row.

    ``terms`` with their ``dfs`` are the most frequent ones; another term has at most the least of these df.
    """
    kind = counts.schema["doc_id"].dataType.simpleString()
    shared = counts.sparkSession.sparkContext.broadcast((terms, np.array(dfs, np.float64)))
    least = min(dfs, default=n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value[0], pa.string())
        idf = np.log(n_docs / shared.value[1])
        low, high = max(np.log(n_docs / least), 0.0), np.log(max(n_docs, 1))
        for batch in batches:
            rows, words = batch.column("terms"), batch.column("terms").flatten()
            size = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            found = pc.index_in(words, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
            exact = idf[found] if len(idf) else np.zeros(len(found))
            sure, most = tf * np.where(found < 0, low, exact), tf * np.where(found < 0, high, exact)
            # the k-th best lower bound of every row; rows of fewer terms keep all
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((-sure, row))
            first = np.cumsum(size) - size
            enough = size >= k
            limit = np.full(len(size), -np.inf)
            limit[enough] = sure[order[first[enough] + k - 1]]
            # ties and rounding stay
            use = pa.array(np.flatnonzero(most >= limit[row] - 1e-9 * (1 + np.abs(limit[row]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row).take(use)), words.take(use), pa.array(tf).take(use)],
                                             ["doc_id", "term", "tf"])

    return counts.mapInArrow(run, f"doc_id {kind}, term string, tf long")


def topk_terms(docs: DataFrame, id_col: str = "id", text_col: str = "content", k: int = 5, common: int = COMMON) -> DataFrame:
    """(doc_id, rank, term, tf, df, score) with score = tf * ln(N / df)."""
    from inkstone.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    # texts are cut once; df is read by its most frequent terms and by the join
    counts = term_counts(docs, id_col, text_col).checkpoint()
    df_ = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).checkpoint()
    n = docs.count()
    top = df_.orderBy(F.col("df").desc(), "term").limit(common).toPandas()  # at most ``common`` terms
    tf = _candidates(counts, top["term"].tolist(), top["df"].tolist(), n, k)
    scored = tf.join(df_, "term").withColumn("score", F.col("tf") * F.log(F.lit(n) / F.col("df")))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("term"))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("doc_id", "rank", "term", "tf", "df", "score"))


def capitalised(text: Column) -> Column:
    """Distinct capitalised words in order of first appearance (entity candidates)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{Ll}{2,}"), 0))


def keyword_struct(themes: Column, entities: Column) -> Column:
    """Keyword extractor output struct; events/actions are left for an external extractor.

    Categories hold MAX_PER_CATEGORY keywords; relations link all consecutive entities.
    """
    from inkstone.functions.bind import let

    def build(ents):
        rel = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ents) - 1, F.lit(1))), lambda i: F.struct(
            F.try_element_at(ents, i).alias("entity1"), F.try_element_at(ents, i + 1).alias("entity2"),
            F.lit("co_occurs").alias("relation")))
        rel = F.filter(rel, lambda r: r["entity2"].isNotNull())
        empty = F.array().cast("array<string>")
        return F.struct(F.struct(F.slice(themes, 1, MAX_PER_CATEGORY).alias("themes"), empty.alias("events"),
                                 F.slice(ents, 1, MAX_PER_CATEGORY).alias("entities"), empty.alias("actions")).alias("keywords"),
                        rel.alias("relations"))

    return let(entities, build)


def extract_with(df: DataFrame, text_col: str, fn, batch_size: int = 64, keep: list[str] | None = None) -> DataFrame:
    """(keep..., state, kw struct) using a keyword extractor ``fn(list[str]) -> list[dict | str]``.

    ``fn`` returns per text the keywords and relations as a dict, or a model
    reply that holds them as JSON; it runs on Arrow batches.  A failing call
    marks its rows ``error``, a reply without such JSON ``invalid``; the job goes on.
    """
    import json

    keep = keep or [c for c in df.columns if c != text_col]
    base = df.select(*keep, F.col(text_col).alias("_text"))
    fields = [f for f in base.schema.fields if f.name != "_text"]
    schema = T.StructType([*fields, T.StructField("state", T.StringType()), T.StructField("reply", T.StringType())])

    def run(batches):
        for pdf in batches:
            texts = pdf["_text"].fillna("").tolist()
            states, replies = [], []
            for s in range(0, len(texts), batch_size):
                part = texts[s:s + batch_size]
                try:
                    out = list(fn(part))
                    if len(out) != len(part):
                        raise ValueError("extractor returned a different number of replies")
                    replies += [r if isinstance(r, str) or r is None else json.dumps(r, ensure_ascii=False) for r in out]
                    states += [""] * len(part)
                except Exception:  # noqa: BLE001 - per-row error state, job continues
                    states += ["error"] * len(part)
                    replies += [None] * len(part)
            res = pdf.drop(columns=["_text"]).copy()
            res["state"], res["reply"] = states, replies
            yield res

    got = base.mapInPandas(run, schema)
    first, last = F.instr("reply", "{"), F.length("reply") - F.instr(F.reverse("reply"), "}") + 1
    kw = F.from_json(F.when((first > 0) & (last >= first), F.expr("substring(reply, instr(reply, '{'), length(reply))")), KEYWORDS_SCHEMA)
    ok = kw["keywords"].isNotNull()
    return got.select(*[f.name for f in fields], F.when((F.col("state") == "") & ~F.coalesce(ok, F.lit(False)), "invalid")
                      .otherwise(F.col("state")).alias("state"), F.when(ok, kw).alias("kw"))


def flatten(kw: Column) -> Column:
    """2.9.22: 'theme:x', 'event:x', 'entity:x', 'action:x' in that order (each capped at 5)."""
    def prefixer(p):
        return lambda x: F.concat(F.lit(p + ":"), x)

    parts = [F.transform(F.slice(F.coalesce(kw["keywords"][c], F.array().cast("array<string>")), 1,
                                 MAX_PER_CATEGORY), prefixer(PREFIX[c])) for c in CATEGORIES]
    return F.concat(*parts)


def relations(df: DataFrame, kw_col: str, id_col: str) -> DataFrame:
    """2.9.23: relation triples -> edge rows."""
    return df.select(F.col(id_col), F.posexplode(F.col(kw_col)["relations"]).alias("pos", "r")).select(
        id_col, "pos", F.col("r.entity1").alias("entity1"), F.col("r.relation").alias("relation"),
        F.col("r.entity2").alias("entity2"))


def distinct_keywords(csv: Column) -> Column:
    """2.9.26: split on ',' (no trimming), sort, drop duplicates."""
    return F.array_distinct(F.array_sort(F.split(csv, ",")))


def relevance_band(score: Column) -> Column:
    """2.9.28: [0.9,1.0] / [0.8,0.9) / [0.5,0.8) / [0.3,0.5) / [0.0,0.3)."""
    return (F.when(score.isNull() | (score < 0) | (score > 1), F.lit(None))
            .when(score >= 0.9, "excellent").when(score >= 0.8, "high").when(score >= 0.5, "moderate")
            .when(score >= 0.3, "limited").otherwise("irrelevant"))


# ---------------------------------------------------------------- overlap top-k

#: Term sets up to this size are indexed by all their subsets (2 ** 8 - 1 keys at most); larger ones are joined by term.
SUBSET_TERMS = 8


def _subsets(terms: Column) -> Column:
    """All non-empty subsets of a sorted array of distinct terms, each joined to one key."""
    n = F.size(terms)
    every = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 1)
    return F.transform(every, lambda m: F.array_join(F.filter(
        terms, lambda t, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1), "\x01"))


def overlap_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, exclude_self: bool = True,
                 subset_terms: int = SUBSET_TERMS) -> DataFrame:
    """Top-k corpus rows per query by keyword overlap (exact).

    queries(query_id, terms array<string>), corpus(id, terms array<string>)
    -> (query_id, id, shared, jaccard, rank); most similar first, then most
    shared, then smallest id.

    No pairs are listed inside a term's group.  Whatever set T of terms a
    query shares with a row, rows that hold T and come earlier by (set size,
    id) are at least as good, so the k + 1 earliest rows of every T (one may
    be the query itself) suffice.  Each row is therefore listed under all
    subsets of its terms, each subset keeps its k + 1 earliest rows (limited
    in the tasks before the shuffle, so a term of a third of the corpus costs
    k + 1 rows per task), and a query looks up its own subsets.  Sets of more
    than ``subset_terms`` terms, on either side, are joined by term instead.
    """
    def sized(df: DataFrame, id_col: str) -> DataFrame:
        terms = F.array_sort(F.array_distinct(F.filter("terms", lambda t: t.isNotNull())))
        return df.select(F.col(id_col), terms.alias("terms")).filter(F.size("terms") > 0)

    q, c = sized(queries, "query_id"), sized(corpus, "id")
    few_q, few_c = (x.filter(F.size("terms") <= subset_terms) for x in (q, c))
    many_q, many_c = (x.filter(F.size("terms") > subset_terms) for x in (q, c))

    listed = few_c.select("id", "terms", F.size("terms").alias("n"), F.explode(_subsets(F.col("terms"))).alias("key"))
    early = Window.partitionBy("key").orderBy("n", "id")
    best = listed.withColumn("nth", F.row_number().over(early)).filter(F.col("nth") <= k + 1)
    best = best.groupBy("key").agg(F.collect_list(F.struct("id", "terms")).alias("rows"))
    asked = few_q.select("query_id", F.col("terms").alias("asked"), F.explode(_subsets(F.col("terms"))).alias("key"))
    met = asked.join(best, "key").select("query_id", "asked", F.explode("rows").alias("r")).select(
        "query_id", F.col("r.id").alias("id"), F.size(F.array_intersect("asked", F.col("r.terms"))).alias("shared"),
        F.size("asked").alias("nq"), F.size("r.terms").alias("nc"))
    by_term = _shared_terms(many_q, c).unionByName(_shared_terms(few_q, many_c))
    cand = met.unionByName(by_term)
    if exclude_self:
        cand = cand.filter(F.col("query_id") != F.col("id"))
    cand = cand.withColumn("jaccard", F.col("shared") / (F.col("nq") + F.col("nc") - F.col("shared")))
    # equal rows share a dense rank, so a pair met under several subsets takes one place
    order = Window.partitionBy("query_id").orderBy(F.col("jaccard").desc(), F.col("shared").desc(), F.col("id"))
    top = cand.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return top.groupBy("query_id", "id", "rank").agg(
        F.max("shared").cast("long").alias("shared"), F.max("jaccard").alias("jaccard")).select(
        "query_id", "id", "shared", "jaccard", "rank")


def _shared_terms(q: DataFrame, c: DataFrame) -> DataFrame:
    """Shared terms of (query, row) pairs with at least one, counted over a join by term."""
    left = q.select("query_id", F.size("terms").alias("nq"), F.explode("terms").alias("term"))
    right = c.select("id", F.size("terms").alias("nc"), F.explode("terms").alias("term"))
    return left.join(right, "term").groupBy("query_id", "id", "nq", "nc").agg(
        F.count(F.lit(1)).cast("int").alias("shared")).select("query_id", "id", "shared", "nq", "nc")
