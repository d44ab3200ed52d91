"""Chunk geometry against a direct model of the specification, on crafted texts."""

import pytest
from pyspark.sql import functions as F

from inkstone.operators import chunking as C


def model_offsets(n, size=256, overlap=32, base=0):
    """start/offset_left/offset_right/end for a text of n code points."""
    u, h = size - overlap, overlap // 2
    out, i = [], 0
    while i < n:
        start = max(0, i - h)
        out.append((base + start, i - start, min(n, i + u) - start, base + min(n, i + size - h)))
        i += u
    return out


def model_triples(t, size=256, overlap=32):
    lo, lu = overlap // 2, size - overlap
    if not t:
        return [("", "", "")]
    out, lhs = [], 0
    while lhs < len(t):
        rhs = min(lhs + lu, len(t))
        out.append((t[max(lhs - lo, 0):lhs], t[lhs:rhs], t[rhs:min(rhs + lo, len(t))]))
        lhs += lu
    return out


TEXTS = ["", "a", "x" * 224, "x" * 225, "y" * 448, "新北市" * 150, "é" * 1000 + "z" * 7]


@pytest.mark.parametrize("text", TEXTS)
def test_offsets_match_model(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, content string")
    got = [(r.start, r.offset_left, r.offset_right, r.end)
           for r in C.offsets(df).orderBy("chunk_no").collect()]
    assert got == model_offsets(len(text))


def test_paragraph_offsets_skip_empty_and_shift(spark):
    paras = ["新" * 300, "", "ab", "c" * 600]
    df = spark.createDataFrame([(7, paras)], "id long, paragraphs array<string>")
    got = [(r.start, r.offset_left, r.offset_right, r.end)
           for r in C.paragraph_offsets(df).orderBy("chunk_no").collect()]
    exp, base = [], 0
    for p in paras:
        exp += model_offsets(len(p), base=base)
        base += len(p)
    assert got == exp
    # the measured example: a 600-char paragraph at 256/32 starts at 0, 208, 432
    assert [s for s, *_ in model_offsets(600)] == [0, 208, 432]


def test_unique_parts_concatenate_to_text(spark):
    text = "Été 新聞 " * 137
    arts = spark.createDataFrame([(1, text)], "id long, content string")
    parts = C.parts(C.offsets(arts), arts).orderBy("chunk_no").collect()
    assert "".join(r.unique for r in parts) == text
    for r in parts:
        assert r.chunk == r.left_overlap + r.unique + r.right_overlap


@pytest.mark.parametrize("text", TEXTS)
def test_text_triples_match_model(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, content string")
    got = [(r.left, r.body, r.right) for r in C.text_triples(df).orderBy("chunk_no").collect()]
    assert got == model_triples(text)


def model_context(paras, size=256, overlap=32, compat=False):
    lo, lu = overlap // 2, size - overlap
    out = []
    for i, p in enumerate(paras):
        if not p:
            continue
        prev = paras[i - 1][max(0, len(paras[i - 1]) - lo):] if i > 0 else ""
        nxt = paras[i + 1][:lo] if i < len(paras) - 1 else ""
        if len(p) <= lu:
            out.append((prev, p, nxt))
            continue
        cs = [list(t) for t in model_triples(p, size, overlap)]
        if i > (1 if compat else 0):
            cs[0][0] = prev
        if i < len(paras) - 1:
            cs[-1][2] = nxt
        out += [tuple(c) for c in cs]
    return out


@pytest.mark.parametrize("compat", [False, True])
def test_context_triples(spark, compat):
    paras = ["first paragraph", "x" * 500, "", "中文段落" * 80, "tail"]
    df = spark.createDataFrame([(1, paras)], "id long, paragraphs array<string>")
    got = [(r.left, r.body, r.right)
           for r in C.context_triples(df, compat=compat).orderBy("chunk_no").collect()]
    assert got == model_context(paras, compat=compat)


def test_compat_flag_changes_second_paragraph_context(spark):
    paras = ["short", "y" * 600]  # chunk 1 = first chunk of the long second paragraph
    df = spark.createDataFrame([(1, paras)], "id long, paragraphs array<string>")
    fixed = C.context_triples(df).orderBy("chunk_no").collect()[1]
    compat = C.context_triples(df, compat=True).orderBy("chunk_no").collect()[1]
    assert fixed.left == "short" and compat.left == ""


@pytest.mark.parametrize("size,overlap", [(0, 2), (10, 1), (10, 3), (10, 10), (10, 12)])
def test_bad_parameters(size, overlap):
    with pytest.raises(ValueError):
        C.check_params(size, overlap)


def test_join_split_roundtrip_multibyte(spark):
    paras = ["第一段", "second", "", "三"]
    df = spark.createDataFrame([(paras,)], "p array<string>")
    r = df.select(F.array_join("p", "").alias("t"), C.byte_cuts(F.col("p")).alias("cuts")).select(
        "cuts", C.split_by_cuts(F.col("t"), F.col("cuts")).alias("pieces")).first()
    assert r.cuts == [9, 15, 15, 18]
    assert r.pieces == ["第一段", "second", "三"]  # the empty piece is skipped


def test_split_without_cuts_is_whole_text(spark):
    df = spark.createDataFrame([("abc", [])], "t string, cuts array<int>")
    assert df.select(C.split_by_cuts(F.col("t"), F.col("cuts")).alias("p")).first().p == ["abc"]


def test_paragraph_starts(spark):
    df = spark.createDataFrame([(["ab", "", "新聞x"],)], "p array<string>")
    assert df.select(C.paragraph_starts(F.col("p")).alias("s")).first().s == [0, 2, 2]


def test_paragraph_chunks_equal_join_based_parts(spark):
    paras = ["新" * 300, "", "ab", "c" * 600, "Ünïcødé " * 40]
    arts = spark.createDataFrame([(5, paras, "".join(paras))], "id long, paragraphs array<string>, content string")
    inline = C.paragraph_chunks(arts).orderBy("chunk_no").collect()
    joined = C.parts(C.paragraph_offsets(arts), arts).orderBy("chunk_no").collect()
    cols = ["start", "end", "chunk", "left_overlap", "unique", "right_overlap"]
    assert [[r[c] for c in cols] for r in inline] == [[r[c] for c in cols] for r in joined]


def test_offsets_property_random(spark):
    """Randomised texts and parameters (hypothesis), all checked in one Spark job."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    cases = []

    @settings(max_examples=40, deadline=None, database=None)
    @given(st.text(alphabet=st.sampled_from(list("ab 新聞é\n")), max_size=700),
           st.integers(min_value=1, max_value=20), st.integers(min_value=3, max_value=300))
    def collect(text, half, size):
        overlap = 2 * half
        if overlap >= size:
            return
        cases.append((len(cases), text, size, overlap))

    collect()
    assert cases
    got = {}
    for size, overlap in {(c[2], c[3]) for c in cases}:
        rows = [(i, t) for i, t, s, o in cases if (s, o) == (size, overlap)]
        df = spark.createDataFrame(rows, "id long, content string")
        for r in C.offsets(df, size=size, overlap=overlap).collect():
            got.setdefault(r.article_id, []).append((r.chunk_no, (r.start, r.offset_left, r.offset_right, r.end)))
    for i, text, size, overlap in cases:
        assert [o for _, o in sorted(got.get(i, []))] == model_offsets(len(text), size, overlap)


def test_join_split_property_random(spark):
    """Random paragraph lists (incl. multi-byte and empty): splitting the joined
    text by its byte cuts returns exactly the non-empty paragraphs."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    cases = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab 新聞é")), max_size=12), max_size=8))
    def collect(paras):
        cases.append((len(cases), paras))

    collect()
    df = spark.createDataFrame(cases, "id long, p array<string>")
    out = df.select("id", "p", C.split_by_cuts(F.array_join("p", ""), C.byte_cuts(F.col("p"))).alias("pieces"))
    for r in out.collect():
        exp = [x for x in r.p if x] if r.p else [""]
        assert r.pieces == exp, (r.p, r.pieces)


def test_sql_table_functions_match_the_operator(spark):
    from inkstone.plans import sql
    sql.register_functions(spark)
    df = spark.createDataFrame([(1, "abcdefghij" * 7), (2, "xy"), (3, ""), (4, None)], "id long, content string")
    df.createOrReplaceTempView("chunk_source")
    for size, overlap in ((20, 4), (7, 2)):
        got = spark.sql(f"""SELECT s.id AS article_id, o.chunk_no, o.start, o.offset_left, o.offset_right, o.`end`
                            FROM chunk_source s, LATERAL chunk_offsets(s.content, {size}, {overlap}) o""")
        exp = C.offsets(df, size=size, overlap=overlap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect())) and got.count() > 4
        texts = spark.sql(f"SELECT s.id, t.chunk FROM chunk_source s, LATERAL chunk_texts(s.content, {size}, {overlap}) t")
        assert texts.filter("id = 2").first().chunk == "xy"
    with pytest.raises(Exception, match="bad chunk size"):
        spark.sql("SELECT o.* FROM chunk_source s, LATERAL chunk_offsets(s.content, 8, 3) o").collect()


def test_a_document_of_many_paragraphs_takes_linear_time(spark):
    import time
    from inkstone.functions.bind import running_sums
    from inkstone.sources.adapters import running_byte_cuts
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.repeat(F.lit("é"), (i % 7).cast("int"))).alias("p"))
    lengths = [k % 7 for k in range(1, 100_001)]
    df.select(F.size(running_byte_cuts(F.slice("p", 1, 100)))).collect()  # start-up
    begin = time.perf_counter()
    cuts = df.select(running_byte_cuts(F.col("p")).alias("c")).first()["c"]
    starts = df.select(C.paragraph_starts(F.col("p")).alias("s")).first()["s"]
    took = time.perf_counter() - begin
    total = 0
    for k, n in enumerate(lengths):
        assert starts[k] == total
        total += n
        assert cuts[k] == 2 * total
    assert took < 4, took  # two documents
    back = df.select(F.size(C.split_by_cuts(F.array_join("p", ""), running_byte_cuts(F.col("p"))))).first()[0]
    assert back == sum(n > 0 for n in lengths)
    for n in (0, 1, 63, 64, 65, 4096, 5000):
        xs = spark.range(1).select(F.slice(F.sequence(F.lit(1), F.lit(6000)), 1, n).alias("x"))
        assert xs.select(running_sums(F.col("x")).alias("s")).first()["s"] == [k * (k + 1) // 2 for k in range(1, n + 1)]
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS x").select(running_sums(F.col("x")).alias("s")).first()["s"] is None
