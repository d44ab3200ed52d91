import hashlib
import re
import struct

import xxhash

from inkstone.llm import fingerprint as fp
from pyspark.sql import functions as F
from tests.llm import odd


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def chain(hashes, seed=42):
    for h in hashes:
        seed = xxhash.xxh64(struct.pack("<q", h), seed=seed).intdigest()
    return signed(seed)


def sketch(text):
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    every = {chain(h[k:k + 5]) for k in range(len(h) - 4)} if len(h) >= 5 else ({chain(h)} if h else set())
    return sorted({x for x in every if x < -2 ** 63 + 2 ** 64 // fp.SCALE} | ({min(every)} if every else set()))


def printed(s):
    return ",".join("%016x" % (x % 2 ** 64) for x in s)


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def brute(rows):
    docs = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (
        r[0] is not None, r[0] or 0, signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())))
    out = {}
    for k, (i, t) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + follow[:q]
        a, b, c = sketch(t), sketch(edited), sketch(follow)
        out[i, t] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), round(alike(a, b), 9),
                     round(alike(a, c), 9))
    return sorted((out[i, t or ""] for i, t, *_ in rows), key=repr)


def values(df):
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=repr)


def test_odd_documents_match_brute_force(spark):
    rows = [(*r[:2],) for r in odd.rows() if r[1] is None or len(r[1]) < 10_000 or r[0] == 12]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert values(fp.edit_likeness(docs)) == brute(rows)


def test_clashing_columns_single_document_and_empty_table(spark):
    assert fp.edit_likeness(odd.documents(spark)).count() == len(odd.rows())
    one = [(5, "a b c d e f g h")]
    assert values(fp.edit_likeness(spark.createDataFrame(one, "doc_id long, text string"))) == brute(one)
    assert fp.edit_likeness(odd.empty(spark)).count() == 0


def test_sketches_merge_and_estimate_containment(spark):
    texts = [odd.words(__import__("random").Random(k), 900) for k in range(2)]
    df = spark.createDataFrame([tuple(texts)], "a string, b string")
    a, b = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    both = fp.sketch(F.concat_ws(" ", "a", "b"))
    r = df.select(fp.merged(a, b).alias("m"), both.alias("t"), fp.containment(a, both).alias("c"), a.alias("a")).first()
    # the joined text has four more shingles, across the seam
    assert set(r["m"]) <= set(r["t"]) and len(r["t"]) - len(r["m"]) <= 4 and r["c"] == 1.0
    assert abs(len(r["a"]) - 896 / fp.SCALE) < 50
    assert df.select(fp.printed(fp.sketch(F.lit("")))).first()[0] == ""


def test_fingerprints_alone(spark):
    got = fp.fingerprints(odd.documents(spark)).where("doc_id IN (4, 5)").select("fingerprint").distinct()
    assert got.count() == 1
