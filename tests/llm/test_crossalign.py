"""Cross-tokenizer alignment against brute force over every byte offset and link."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm import crossalign
from tests.llm import odd

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def brute(rows):
    """rows: (doc_id, text); figures per row by the library's own tokens."""
    coder, model, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    coder.encode_special_tokens = True
    docs = []
    for doc_id, text in rows:
        text = text or ""
        e = coder.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(table[c] for c in coder.id_to_token(i))) for i in e.ids]
        b = []
        for i in model.encode(text):
            piece = model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
        data = (" " + text).encode()
        if not text or any(b"".join(x for _, x in side) != data for side in (a, b)):
            docs.append((doc_id, [], [], []))
            continue

        def ends(side):
            return {sum(len(x) for _, x in side[:k + 1]) for k in range(len(side))}

        cuts = sorted(ends(a) & ends(b))

        def deal(side):
            out, at, g = [[] for _ in cuts], 0, 0
            for i, x in side:
                at += len(x)
                while cuts[g] < at:
                    g += 1
                out[g].append(i)
            return out

        docs.append((doc_id, [i for i, _ in a], [i for i, _ in b], list(zip(deal(a), deal(b), strict=True))))
    count = Counter()
    for _, _, _, groups in docs:
        count.update({(i, j) for x, y in groups for i in x for j in y})
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for doc_id, a, b, groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in crossalign.align(df, A, B, **kw).collect()), key=repr)


SHORT = [(r[0], r[1]) for r in odd.rows() if len(r[1] or "") < 2000]
SPECIAL = [(101, "a<|endoftext|>b <s> x </s><unk> é"), (102, "tab\tand  two   blanks\n\n end "), (103, "a▁b"), (104, "nul\x00byte"),
           (105, "​ zero width"), (106, "漢字仮名交じり文" * 30), (107, "x" * 300), (108, " leading"), (109, "👍🏽 ok 👍"),
           (110, "aé " * 50), (110, "aé " * 50), (None, "no id"), (111, "Áé combining"), (112, "\r\n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_equals_brute_force(spark):
    rows = SHORT + SPECIAL
    want = brute(rows)
    assert sum(r[1] == 0 for r in want) >= 4
    assert run(frame(spark, rows)) == want
    # blocks of one document and kept windows change nothing
    assert run(frame(spark, rows), block_pairs=1) == want


def test_kept_windows_change_nothing(spark, monkeypatch):
    texts = [t for _, t in SHORT + SPECIAL if t]
    aligner = crossalign.Aligner(A, B)
    first = [aligner.align(*x) for x in aligner.encode(texts) if x]
    again = [aligner.align(*x) for x in aligner.encode(texts) if x]
    monkeypatch.setattr(crossalign, "WINDOW_TOKENS", 0)
    bare = crossalign.Aligner(A, B)
    never = [bare.align(*x) for x in bare.encode(texts) if x]
    assert not bare._held and aligner._held
    for x, y, z in zip(first, again, never, strict=True):
        for k in range(3):
            assert x[k] == y[k] == z[k]
        for k in (3, 4):
            assert x[k].tolist() == y[k].tolist() == z[k].tolist()


def test_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2500").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(docs) == brute(rows)


def test_odd_tables(spark):
    got = run(odd.documents(spark))
    assert len(got) == len(odd.rows())
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:] == by_id[2][1:] == (0, 0, 0, 0, 0, 0, "")
    assert by_id[12][3] > 0  # 60,000 times the same letter, without a blank
    assert run(odd.empty(spark)) == []
    assert crossalign.align(odd.empty(spark).withColumn("a.b", F.lit(1)), A, B).count() == 0


def test_lengths_tell_whether_b_gives_a_text_back(spark):
    import random
    aligner = crossalign.Aligner(A, B)
    assert aligner._plain_b
    rng = random.Random(9)
    texts = [crossalign.PROBE, "▁", "a▁", "\x00", *(t for _, t in SHORT + SPECIAL if t)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x2500, 0x2600), rng.randrange(0x10000, 0x1F700), 32]))
                      for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    short = aligner.encode(texts)
    aligner._plain_b = False
    for x, y, t in zip(short, aligner.encode(texts), texts, strict=True):
        assert (x is None) == (y is None), t
    assert any(x is None for x in short)


def test_blocks_hold_a_row_per_document(spark):
    rows = [(k, f"{t or ''} word{k}") for k, (_, t) in enumerate(SHORT + SPECIAL)]
    got = crossalign.blocks(frame(spark, rows).coalesce(1), A, B, block_pairs=40).collect()
    assert sorted(r["doc_id"] for r in got) == [k for k, _ in rows]
    # only the first row of a block lists its pairs; a document's places lie within them
    blocks = {r["block"] for r in got}
    assert len(blocks) > 1
    for block in blocks:
        mine = [r for r in got if r["block"] == block]
        size = {len(r["pairs"]) for r in mine if r["pairs"]}
        assert len(size) <= 1
        assert all(max(np.frombuffer(r["at"], "<i4"), default=-1) < max(size, default=0) for r in mine)


def test_kept_windows_are_bounded_and_change_nothing(monkeypatch):
    aligner = crossalign.Aligner(A, B)
    texts = [f"alpha beta{k} gamma{k % 3}" for k in range(60)]
    want = [aligner.align(*both)[:3] for both in aligner.encode(texts)]
    monkeypatch.setattr(crossalign, "HELD_WINDOWS", 16)
    few = crossalign.Aligner(A, B)
    for both, w in zip(few.encode(texts), want, strict=True):
        assert few.align(*both)[:3] == w
        assert len(few._held) + len(few._older) <= 16 + len(both[0])
    assert few._older
    big = np.array([1, 1 << 31])
    assert crossalign._narrow(big).dtype.itemsize == 8 and crossalign._narrow(big[:1]).dtype.itemsize == 4
