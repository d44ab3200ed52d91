"""Corpus pipeline: raw documents to token ids, stage by stage.

Every stage takes all documents that its predecessor kept and, but for the
last, returns documents with all their columns.  ``run`` writes each stage's
result to the shared folder and reads it back, so a lost executor never
repeats an earlier stage.

Edge cases are those of the operators: null and empty texts pass the
classifier by their statistics, are one group for exact dedup, link with
nothing, are taken 0 times by the mix and so leave there; an empty table stays
empty.  Rows that repeat a doc_id are decided each by their own text in the
dedup stages (of two equal rows one stays) and together, by doc_id, in the mix.
Columns may have any names, dots included.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from decimal import Decimal
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bpe, exactdedup, minhash, mixing, quality
from inkstone.llm.common import arrow_batches, read, stored, texts


def _numbered(docs: DataFrame) -> DataFrame:
    """(row_, row): unique numbers and whole rows (one column, so no name of documents can clash), as a stored table."""
    names = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]
    return stored(docs.select(F.monotonically_increasing_id().alias("row_"), F.struct(*names).alias("row")), "rows")


def _only(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """The numbered rows whose number is in ``keep`` (row_)."""
    # a shuffle join at every size: the numbers grow with the input
    return rows.join(keep.hint("merge"), "row_", "left_semi").select("row.*")


def _released(stage: Callable) -> Callable:
    """``stage``, begun after the driver has let go of earlier work.

    Spark removes broadcasts and shuffle files once the driver's JVM has collected the plans that refer to them, and Python
    holds such plans until its own cycles are collected; left alone, the driver's heap stays as large as it ever was.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)
    return run


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@_released
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go (a filter on the score; rows do not move)."""
    arrow_batches(spark)
    labels = read(spark, sf_dir, "labels")
    model = quality.train(texts(docs), labels.select("doc_id", quality.grade_of(labels).alias("grade")))
    if model is None or not len(model.known):
        return docs
    return docs.where(quality.scored(spark, model)(docs["text"])["p_top"] >= quality.KEEP)


@_released
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of equal texts stays."""
    rows = _numbered(docs)
    kept = exactdedup.kept_rows(rows.select("row_", "row.doc_id", "row.text"), "row_")
    return _only(rows, kept.withColumnRenamed("row", "row_"))


@_released
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, at its similarity of 0.85: one document of each group of near-duplicates stays, that of the smallest doc_id."""
    rows = _numbered(docs)
    found = minhash.near_duplicates(rows.select("row_", "row.text"), id_col="row_").select(
        F.col("doc_id").alias("row_"), "component_id")
    # (doc_id, row number) as one number that partial aggregation can hold; 93 * 10^17 is beyond every long
    step = F.lit(Decimal(10 ** 19))
    doc_id = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(93 * 10 ** 17)))
    least = found.join(rows.select("row_", "row.doc_id"), "row_").groupBy("component_id").agg(
        F.min(doc_id * step + F.col("row_").cast("decimal(19,0)")).alias("least"))
    return _only(rows, least.select(F.pmod("least", step).cast("long").alias("row_")))


@_released
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, longer documents likelier: every document as often as the mix takes it."""
    rows = _numbered(docs)
    taken = mixing.mix(rows.select("row_", "row.doc_id", "row.text", "row.source"), by_size=True).where("taken > 0").groupBy(
        F.col("doc_id").alias("taken_id")).agg(F.max("copies").cast("int").alias("copies"))
    taken = rows.select("row_", "row.doc_id").join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id"))).select("row_", "copies")
    whole = rows.join(taken.hint("merge"), "row_")
    return whole.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


@_released
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token counts and digests of ids and decoded text, one row per taken copy."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: The quality stage trains a model, which SQL cannot express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
