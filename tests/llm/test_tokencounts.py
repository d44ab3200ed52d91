import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from inkstone.llm import tokencounts
from tests.llm import odd

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(text, rule):
    """Every character's section, then every token's characters, one by one."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, line in enumerate(lines) for _ in line]
    n = [0] * len(lines)
    data, at = text.encode(), 0
    char = [k for k, c in enumerate(text) for _ in c.encode()]
    ranks = {v: k for k, v in tokencounts.read_ranks(PATH).items()}
    for i in t.encode(text, add_special_tokens=False).ids:
        size = len(ranks[i])
        # a character belongs to the token that holds its last byte
        mine = sorted({char[b] for b in range(at, at + size) if b + 1 == len(data) or char[b + 1] != char[b]})
        sections = [owner[c] for c in mine] or [owner[char[at]]]
        first = owner[char[at]]
        best = first if rule == "first" else max(sorted(set(sections)), key=sections.count)
        n[best] += 1
        at += size
    return n


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_sections_match_brute_force(spark, rule):
    texts = [t or "" for _, t, *_ in odd.rows() if len(t or "") < 5000]
    texts += ["a\n\n\nb  \n c", "\n", "x\n", " \n \n", "one\r\ntwo\n\n\n\n\nthree", "   \n      x\n\n y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in tokencounts.section_counts(docs, PATH, rule).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert [r["start"] for r in got[i]][0] == 0 and got[i][-1]["end"] == len(text)
        assert sum(r["n_tokens"] for r in got[i]) == sum(brute(text, rule)) if text else got[i][0]["n_tokens"] == 0
        if text.isascii() and text:
            assert [r["n_tokens"] for r in got[i]] == brute(text, rule), text


def test_a_crossing_token_goes_where_the_rule_says():
    ends, edges = np.array([2, 7, 9]), np.array([0, 3, 9])
    assert tokencounts.allocate(ends, edges, "first")[0].tolist() == [2, 1]
    n, crossing = tokencounts.allocate(ends, edges, "most")
    assert n.tolist() == [1, 2] and crossing.sum() == 1
    assert tokencounts.allocate(np.array([4]), np.array([0, 2, 4]), "most")[0].tolist() == [1, 0]  # tie: the earlier


def test_whole_documents_odd_rows_and_empty_table(spark):
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokencounts.read_ranks(PATH), special_tokens={})
    got = tokencounts.section_counts(odd.documents(spark), PATH).groupBy("doc_id").sum("n_tokens").collect()
    want = {}
    for i, t, *_ in odd.rows():
        want[i] = want.get(i, 0) + len(coder.encode_ordinary(t or ""))
    assert {r[0]: r[1] for r in got} == want
    assert tokencounts.section_counts(odd.empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        tokencounts.section_counts(odd.empty(spark), PATH, rule="last")
