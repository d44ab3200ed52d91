"""Element-wise vector aggregates (pgvector ``AVG(vector)``, ``avg_embedding``).

``pyspark.ml.stat.Summarizer`` is a typed imperative aggregate: it combines
map-side, so a hot article (one key holding a third of the rows) is reduced
to one partial buffer per task before the shuffle instead of n x dim rows.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import vectors as V


def mean_by(df: DataFrame, keys: list[str], vec_col: str = "vector", out_col: str = "avg_vector") -> DataFrame:
    """(keys..., avg_vector array<double>, n) over valid (non-null, non-empty) vectors."""
    valid = df.filter(V.is_valid(F.col(vec_col)))
    agg = valid.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_mean"),
        F.count("*").alias("n"))
    return agg.select(*keys, vector_to_array(F.col("_mean")).alias(out_col), "n")


def avg_embedding(requests: DataFrame, embeddings: DataFrame, article_col: str = "article_id",
                  model_col: str = "model_id", vec_col: str = "vector") -> DataFrame:
    """SQL function ``avg_embedding(aid, mid)`` for a table of requested keys.

    Requests without any non-null vector get NULL, like the reference's
    ``CASE WHEN COUNT(*) = 0 THEN NULL``.  (The function only excludes NULL
    vectors; empty ones are also excluded since they cannot be averaged.)
    """
    means = mean_by(embeddings, [article_col, model_col], vec_col)
    return requests.join(means.drop("n"), [article_col, model_col], "left")
