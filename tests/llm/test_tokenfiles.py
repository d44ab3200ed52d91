"""Token files: exact round trips against the library, alone read documents, order, odd tables."""
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from inkstone.llm import bytebpe, tokenfiles
from tests.llm import odd

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["<|endoftext|> in the <|endoftext|>text", "it's we'll 'sx  x \n\n y\t", "漢字 👍🏽 ԱՙՙԲ ok", "a" * 3000, " ", "\x00\x1c\x85\xa0 b", "İ ß Σας"]


def ids_of(texts):
    return [np.array(e.ids, "<u4") for e in Tokenizer.from_file(PATH).encode_batch(list(texts), add_special_tokens=False)]


def brute(rows):
    """rows: (doc_id, text), ascending ids, none last; equal ids by checksum."""
    arrays = [np.append(a, np.uint32(0)) for a in ids_of([t or "" for _, t in rows])]
    keyed = sorted((i is None, i or 0, zlib.crc32(a.tobytes()), len(a)) for (i, _), a in zip(rows, arrays, strict=True))
    out, at = [], 0
    for none, i, crc, n in keyed:
        out.append((None if none else i, at, n, crc))
        at += n
    return out


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_words_are_cut_as_the_library_cuts_them():
    cut, mine = Tokenizer.from_file(PATH).pre_tokenizer, regex.compile(P.PATTERN)
    for c in range(0x500):
        s = f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}x"
        assert [s[i:j] for _, (i, j) in cut.pre_tokenize_str(s)] == mine.findall(s), hex(c)


def test_encoder_equals_the_library(tmp_path):
    rng = random.Random(3)
    some = ["".join(rng.choice("ab cd'st1é \n.,漢<|endoftext|>") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts = TEXTS + some + [r[1] for r in odd.rows() if r[1]]
    want = [a.astype("<u2").tobytes() for a in ids_of(texts)]
    coder = bytebpe.ByteBpe(PATH)
    assert coder.dtype == np.dtype("<u2")
    assert coder.encode(texts) == want == coder.encode(texts)
    assert coder._fast is not None
    # a file whose ids are not in the order of its merges is left to the library
    spec = json.loads(open(PATH, encoding="utf-8").read())
    vocab = spec["model"]["vocab"]
    a, b = "".join(spec["model"]["merges"][0]), "".join(spec["model"]["merges"][7])
    vocab[a], vocab[b] = vocab[b], vocab[a]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    swapped = bytebpe.ByteBpe(str(other))
    assert swapped._fast is None
    assert swapped.encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(str(other)).encode_batch(
        texts, add_special_tokens=False)]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    assert bytebpe.ByteBpe(PATH, special_as_text=True).encode(TEXTS) == [
        np.array(e.ids, "<u2").tobytes() for e in plain.encode_batch(TEXTS, add_special_tokens=False)]


def test_round_trip_of_odd_tables(spark):
    rows = [(r[0], r[1]) for r in odd.rows()]
    df = odd.documents(spark)
    assert in_order(tokenfiles.round_trip(df, PATH)) == brute(rows)
    # many ranges, a file per few documents
    index = tokenfiles.write(df, PATH, ranges=13, file_bytes=400)
    assert index.select("file").distinct().count() > 13
    assert in_order(tokenfiles.read(index)) == brute(rows)
    assert tokenfiles.round_trip(odd.empty(spark), PATH).collect() == []


def test_repeated_ids_are_spread_over_ranges(spark):
    rng = random.Random(8)
    rows = [(7, odd.words(rng, rng.randint(1, 9))) for _ in range(300)] + [(k, odd.words(rng, 4)) for k in range(-50, 200)]
    rows += [(None, odd.words(rng, 5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index = tokenfiles.write(df, PATH, ranges=8)
    parts = [r[0] for r in index.where("doc_id = 7").groupBy("part").count().collect()]
    assert len(parts) > 2
    assert index.where("doc_id IS NULL").select("part").distinct().count() > 1
    assert in_order(tokenfiles.read(index)) == brute(rows)


def test_ids_come_back_whole_and_documents_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    want = {i: [*a.tolist(), 0] for (i, _), a in zip(rows, ids_of([t or "" for _, t in rows]), strict=True)}
    index = tokenfiles.write(docs, PATH, ranges=3)
    back = tokenfiles.read(index, with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in back} == want
    some = [i for i, _ in rows][::17]
    alone = tokenfiles.documents(index, spark.createDataFrame([(i,) for i in some], "doc_id int")).collect()
    assert {r["doc_id"]: r["ids"] for r in alone} == {i: want[i] for i in some}
    path = index.first()["file"]
    with_it = tokenfiles.TokenFile(path)
    k = with_it.find(some[0]) or [0]
    assert with_it.document(k[0]).tolist() == want[int(with_it.entries["doc_id"][k[0]])]
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.TokenFile(path, b"other")


def test_dictionary_helps_short_documents_and_is_named_by_its_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    dictionary = tokenfiles.shared_dictionary(docs, PATH, 0)
    assert dictionary and dictionary == tokenfiles.shared_dictionary(docs.repartition(7), PATH, 0)
    import zstandard
    ids = [a.astype("<u2").tobytes() for a in ids_of([r[0] for r in docs.where("length(text) < 1500").select("text").collect()])]
    bare = zstandard.ZstdCompressor(level=tokenfiles.LEVEL)
    shared = zstandard.ZstdCompressor(level=tokenfiles.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
    assert sum(len(shared.compress(x)) for x in ids) < 0.95 * sum(len(bare.compress(x)) for x in ids)


def test_damaged_files_are_errors(tmp_path, spark):
    df = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string")
    index = tokenfiles.write(df, PATH, folder=str(tmp_path), ranges=1)
    path = index.first()["file"]
    data = bytearray(open(path, "rb").read())
    data[-30] ^= 255
    bad = tmp_path / "bad.ids"
    bad.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="no whole token file"):
        tokenfiles.TokenFile(str(bad))
