import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkstone.llm import bpe
from tests.llm import odd

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def strange(seed, n):
    rng = random.Random(seed)
    blocks = [(32, 127), (0x80, 0x250), (0x300, 0x590), (1, 32), (0x2000, 0x2200), (0x3000, 0x3100), (0x1F300, 0x1F700)]
    return ["".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


SPECIAL = ["a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|><|endoftext|>", "<|endoftext|", "it's we'LL 've 12345 ½ ²",
           "Σίσυφος ΟΔΟΣ Σ", "İstanbul K Å ẛ̣ ﬁ", "'s'S 'RE'd", "x" * 3000, "ab" * 2000, "a\x85b\xa0c\x1cd"]


def test_words_and_merges_match_the_library(vocabulary, library):
    split = vocabulary.words()
    for text in [t or "" for _, t, *_ in odd.rows()] + SPECIAL + strange(1, 1500):
        ids = [i for w in split(text) for i in vocabulary.merged(w)]
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_digests_match_the_library_whatever_the_lexicon(spark, library):
    texts = [t for _, t, *_ in odd.rows()] + SPECIAL + strange(2, 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for size in (0, 30, 5000):
        assert sorted(map(tuple, bpe.digests(docs, PATH, lexicon_words=size).collect())) == want


def test_empty_table(spark):
    assert bpe.digests(odd.empty(spark), PATH).count() == 0


def test_the_transducer_is_minimal_and_returns_its_outputs(tmp_path, vocabulary):
    rng = random.Random(3)
    words = {w.encode() for w in odd.words(rng, 3000).split()} | {b"tap", b"taps", b"top", b"tops", b"a", b""}
    entries = {w: vocabulary.merged(w.decode()) for w in words}
    path = str(tmp_path / "lexicon.bin")
    bpe.compile_lexicon(entries, path)
    lexicon = bpe.Lexicon(path)
    for w in words - {b""}:
        assert lexicon[w] == entries[w]
        for other in (w[:-1], w + b"q", b"q" + w):
            assert lexicon[other] == (entries[other] if other in words and other else None)
    # one state per distinct set of continuations
    ends = {}
    for w in words - {b""}:
        for k in range(len(w) + 1):
            ends.setdefault(w[:k], set()).add(w[k:])
    assert len(lexicon.final) == len({frozenset(s) for s in ends.values()})
