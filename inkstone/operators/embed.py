"""Chunk embedding jobs.

* ``embed_hashed`` — the offline default: a hashed bag of tokens (bucket = md5
  prefix of the token mod dim), L2-normalised; tokens and buckets are column
  expressions, the counts one numpy call per row.
* ``embed_with`` — any user embedder ``fn(list[str]) -> list[list[float]]``
  run through ``mapInPandas`` in bounded sub-batches; a failing call marks
  its rows ``error`` instead of failing the job, a wrong length marks
  ``truncated``; row order inside a batch is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.operators.keywords import tokens


def token_bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim))


def _bincount_fn(dim: int, keep: list[str]):
    def run(batches):
        for pdf in batches:
            vecs = []
            for idx in pdf["_idx"]:
                v = np.bincount(np.asarray(idx if idx is not None else [], dtype=np.int64),
                                minlength=dim).astype(np.float64)
                n = np.sqrt((v * v).sum())
                vecs.append(v / n if n > 0 else v)
            out = pdf[keep].copy()
            out["vector"] = vecs
            out["state"] = ""
            yield out

    return run


def embed_hashed(df: DataFrame, text_col: str, dim: int = 64) -> DataFrame:
    """Hashed bag-of-tokens embedding of every row (state '' = ok), L2-normalised, zeros without tokens.

    Bucket numbers are computed JVM-side and counted per row with
    ``np.bincount``: work of tokens + dim at every dimension.
    """
    keep = list(df.columns)
    idx = F.transform(tokens(F.col(text_col)), lambda t: token_bucket(t, dim))
    schema = T.StructType(list(df.schema.fields) + [T.StructField("vector", T.ArrayType(T.DoubleType())),
                                                    T.StructField("state", T.StringType())])
    return df.withColumn("_idx", idx).mapInPandas(_bincount_fn(dim, keep), schema)


def embed_with(df: DataFrame, text_col: str, fn: Callable[[list[str]], list], dim: int,
               batch_size: int = 64, keep: list[str] | None = None) -> DataFrame:
    """(keep..., state, vector array<float>) using a Python embedder on Arrow batches."""
    keep = keep or [c for c in df.columns if c != text_col]
    base = df.select(*keep, F.col(text_col).alias("_text"))
    fields = [f for f in base.schema.fields if f.name != "_text"]
    schema = T.StructType(fields + [T.StructField("state", T.StringType()),
                                    T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            texts = pdf["_text"].fillna("").tolist()
            states, vecs = [], []
            for s in range(0, len(texts), batch_size):
                part = texts[s:s + batch_size]
                try:
                    out = fn(part)
                    if len(out) != len(part):
                        raise ValueError("embedder returned a different number of vectors")
                    for v in out:
                        arr = np.asarray(v, dtype=np.float32)
                        states.append("" if arr.shape == (dim,) else "truncated")
                        vecs.append(arr.tolist())
                except Exception:  # noqa: BLE001 - per-row error state, job continues
                    states.extend(["error"] * len(part))
                    vecs.extend([None] * len(part))
            res = pdf.drop(columns=["_text"]).copy()
            res["state"] = states
            res["vector"] = vecs
            yield res

    return base.mapInPandas(run, schema)


def hashed_fn(dim: int = 64):
    """Python twin of ``embed_hashed`` for ``embed_with`` (tests / local use)."""
    import hashlib

    import regex

    pat = regex.compile(r"\p{L}[\p{L}\p{N}]{2,}")

    def fn(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for tok in pat.findall(t.lower()):
                v[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim] += 1
            n = np.linalg.norm(v)
            out.append((v / n if n > 0 else v).tolist())
        return out

    return fn

