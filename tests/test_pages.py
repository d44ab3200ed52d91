"""HTML extraction job on crafted (malformed) pages."""

from pyspark.sql import functions as F

from inkstone.operators import pages as PG

PAGES = [
    (1, "https://a.example.com/x/1", "<html><head><title>T &amp; U</title><script>var s='</p>';</script></head>"
        "<body><article><h1>Head</h1><p>one <b>bold</b><br><p>two</p><p>  </p><p>更多 related</p></article>"
        "<a href=\"/rel\">r</a><a href=\"https://b/\">b</a></body></html>"),
    (2, "https://a.example.com/x/2", "<html><body><article><div>alpha</div><div>beta <i>x</i></div></article></body></html>"),
    (3, "https://a.example.com/x/3", "<html><body><article>para one\n\npara two</article></body></html>"),
    (4, "https://a.example.com/x/4", "<html><body><p>outside</p></body></html>"),
    (5, "https://a.example.com/x/5", "<html><body><time datetime=\"2024-05-21\">x</time><article><p>dated</p></article></body></html>"),
]


def test_extract(spark):
    pages = spark.createDataFrame(PAGES, "id long, url string, html string")
    r = {x.id: x for x in PG.extract(pages, as_of="2030-01-01 00:00:00").collect()}
    assert r[1].title == "T&U" and r[1].headline == "Head"
    assert r[1].contents == ["onebold", "two", "更多related"]          # implied </p>; empty blocks dropped
    assert r[2].contents == ["alpha", "betax"] and "content from fallback" in r[2].warnings
    assert r[3].contents == ["paraone", "paratwo"]
    assert r[4].error == "no content"
    assert str(r[5].date) == "2024-05-20 16:00:00" and r[5].warnings == []
    assert str(r[1].date) == "2030-01-01 00:00:00" and r[1].warnings == ["date not found, using as_of"]


DPP = """<body><article class="news_content x"><h2>T 1</h2><h2>T 2</h2><p class="news_content_date">{date}</p>
<div id="{box}">{body}</div></article></body>"""
KMT = """<body><div id="recentwork"><div id="Blog1"><div id="div1"><h3>A</h3><div class="post-body y">{body}</div>
<div class="post-footer-line"><i class="pdt">{date}</i></div></div></div></div></body>"""
TPP = """<div class="news_container"><div class="content_topic">Topic</div><div class="content_date">2024/05/21</div>{body}</div>"""
YAHOO = """<div class="caas-container"><script type="application/ld+json">{ld}</script><h1 id="caas-lead-header-undefined">H</h1>
<div class="caas-attr-meta"><div class="caas-attr-item-author"><span>Ann</span></div>
<span class="caas-attr-time-style"><time{attr}>2025年5月21日 週三 下午4:01</time></span></div><div class="caas-body">{body}</div></div>"""
ABBR = '<abbr class="published" title="2024-05-21T08:01:50.250+08:00">x</abbr>'
DPP_URL = "https://www.dpp.org.tw/media/contents/1"

SITE_PAGES = {
    1: ("dpp", DPP_URL, DPP.format(date="2024-05-21", box="media_contents",
                                   body="<p>a&nbsp;b</p><div><p>inner</p></div><p> 　</p><p><span>更多</span>x</p>")),
    2: ("dpp", DPP_URL, DPP.format(date="bad", box="media_contents", body="<p> </p><div>d 1</div><section><div>no child</div></section>")),
    3: ("dpp", "https://www.dpp.org.tw/x/1", DPP.format(date="2024-05-21", box="media_contents", body="<p>a</p>")),
    4: ("dpp", "https://www.dpp.org.tw/anti_rumor/1", DPP.format(date="2024-05-21", box="media_contents", body="<p>a</p>")),
    5: ("kmt", "https://k/2023/07/blog-post_1.html", KMT.format(date=ABBR, body="<p>first</p><div><p>second</p></div>")),
    6: ("kmt", "https://k/2023/07/blog-post_1.html", KMT.format(date="", body="<p>first</p><p>113.05.07 text</p>")),
    7: ("kmt", "https://k/2023/07/blog-post_1.html", KMT.format(date="", body="<p>only</p><description><div>fall</div></description>")),
    8: ("tpp", "https://t/1", TPP.format(body='<div class="content_description">one<p>two</p></div>')),
    9: ("tpp", "https://t/1", TPP.format(body='<div class="content_description"> </div>')),
    10: ("yahoo", "https://tw.news.yahoo.com/a", YAHOO.format(
        ld='{"description": "d  e", "keywords": ["b", "a", "b"], "datePublished": "2024-05-21T08:01:50.123Z"}', attr="",
        body="<p>更多 is text</p><p><span>延伸閱讀</span>x</p><p><b><span>更多</span></b> deep</p><p>t &amp; u<br>v</p>")),
    11: ("yahoo", "https://tw.news.yahoo.com/a", YAHOO.format(ld="not json", attr="", body="<p>" + "x" * 120 + "</p>")),
    12: ("yahoo", "https://tw.news.yahoo.com/a", YAHOO.format(ld="{}", attr=' datetime="2024-05-22T00:00:00.5+08:00"', body="<p></p>")),
    13: ("nowhere", "https://x", "<p>a</p>"), 14: ("dpp", DPP_URL, None), 15: ("dpp", DPP_URL, "<<>&#xZZ;</p></div><article"),
}


def test_site_layouts(spark):
    rows = [(i, u, h, s) for i, (s, u, h) in SITE_PAGES.items()]
    pages = spark.createDataFrame(rows, "id long, url string, html string, site string")
    r = {x.id: x for x in PG.extract(pages, as_of="2030-01-01 00:00:00").collect()}
    assert r[1].title == "T1" and r[1].contents == ["ab", "更多x"] and str(r[1].date) == "2024-05-20 16:00:00"
    assert r[2].contents == ["d1"] and r[2].warnings == ["date not found, using as_of", "content from fallback"]
    assert r[3].error == r[4].error == "no content"
    assert r[5].title == "A" and r[5].contents == ["second"] and str(r[5].date) == "2024-05-21 00:01:50.250000"
    assert r[6].contents == ["113.05.07text"] and str(r[6].date) == "2024-05-06 16:00:00"
    assert r[7].contents == ["fall"] and str(r[7].date) == "2023-06-30 16:00:00"
    assert r[8].contents == ["onetwo"] and str(r[8].date) == "2024-05-20 16:00:00" and r[8].error is None
    assert r[9].contents == [] and r[9].error is None and r[9].warnings == ["no content found"]
    assert r[10].contents == ["更多istext", "更多deep", "t&uv"] and r[10].keywords == ["a", "b"] and r[10].author == "Ann"
    assert str(r[10].date) == "2024-05-21 08:01:50.123000" and r[10].modified == r[10].date and r[10].description == "de"
    assert str(r[11].date) == "2025-05-21 16:01:00" and r[11].description == "x" * 100 + "..." and r[11].keywords is None
    assert r[12].error == "no content" and str(r[12].date) == "2024-05-21 16:00:00.500000"
    assert "KeyError" in r[13].error and r[14].error == r[15].error == "no content"


def test_selectors():
    page = PG.tree("<div id=a class='x y'><p>1<div><p class=z>2</div><ul><li t='v w'>3</li><li>4</ul></div><p>5")
    text = lambda s: [n.text() for n in PG.select(page, s)]
    assert text("#a > p") == ["1"] and text("#a p") == ["1", "2"] and text(".x.y .z") == ["2"] and text("p") == ["1", "2", "5"]
    assert text("div div > p.z") == ["2"] and text("li[t]") == text("li[t='v w']") and text("li[t='q']") == [] and text("#b p") == []


def test_links_and_status(spark):
    html = """<a href='n?page=2'>q</a><a href="//h.org/x#f">p</a><a href="a&amp;b">e</a><link href="/no"><a href="mailto:x@y">m</a>
              <a href="http://[bad">b</a><a href="/ok">o</a><a name="x">n</a><a href=" https://z.org/t "> s</a>"""
    pages = spark.createDataFrame([*PAGES[:1], (2, "https://s.org/d/e?f=1", html)], "id long, url string, html string")
    got = {}
    for r in PG.links(pages).collect():
        got.setdefault(r.page_id, set()).add(r.link)
    assert got[1] == {"https://a.example.com/rel", "https://b/"}
    assert got[2] == {"https://s.org/d/n?page=2", "https://h.org/x", "https://s.org/d/a&b", "https://s.org/ok", "https://z.org/t"}
    assert {r.link for r in PG.links(pages, allow=[r"^https://s\.org/", "h.org"]).collect()} == got[2] - {"https://z.org/t"}
    df = spark.createDataFrame([(None, [], False), ("e", [], False), (None, ["w"], False), ("e", ["w"], False),
                                (None, [], True)], "e string, w array<string>, s boolean")
    got = [r.st for r in df.select(PG.status(F.col("e"), F.col("w"), F.col("s")).alias("st")).collect()]
    assert got == ["OK", "ERROR", "WARNING", "WARNING", "SKIPPED"]


def test_assemble_cuts(spark):
    pages = spark.createDataFrame(PAGES[:1], "id long, url string, html string")
    a = PG.assemble(PG.extract(pages)).first()
    assert a.content == "oneboldtwo更多related" and a.cuts == [7, 10, 23] and a.source == "user"


def test_sink_and_known_keys(spark, sf):
    import tempfile

    from inkstone.plans import q_pages
    from inkstone.sources import sinks
    d = tempfile.mkdtemp(prefix="sink-", dir="/tmp")
    rec = q_pages.sink_records(spark, sf)
    sinks.write_records(rec, d)
    keys = {r.key for r in sinks.known_keys(spark, d).collect()}
    exp = {r.file_name.split("_")[-1][:32] for r in rec.collect()}
    assert keys == exp == {r.key for r in q_pages.known_pages(spark, sf).collect()} and len(keys) > 0


def test_sql_surface(spark, sf):
    from inkstone.plans import sql
    assert "articles" in sql.register(spark, sf)
    n = spark.sql("SELECT count(*) AS n FROM articles a JOIN chunks c ON c.article_id = a.id").first().n
    assert n > 0


def test_sql_functions_match_column_builders(spark):
    import datetime as dt

    from inkstone.functions import keys as KY
    from inkstone.functions import text as TX
    from inkstone.functions import vectors as V
    from inkstone.plans import sql
    sql.register_functions(spark)
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 0.5], "a  b\\tc　d", "0123456789abcdef", "T", "https://x/y",
                                 dt.datetime(2024, 5, 1, 3, 0))],
                               "a array<double>, b array<double>, s string, k string, t string, u string, p timestamp_ntz")
    df.createOrReplaceTempView("fx")
    got = spark.sql("""SELECT l2_distance(a, b) AS l2, cosine_distance(a, b) AS c, neg_inner_product(a, b) AS ip,
                              normalize_text(s) AS n, mask_secret(k) AS m, link_key(u) AS lk,
                              article_key(t, u, p) AS ak FROM fx""").first()
    exp = df.select(V.l2("a", "b").alias("l2"), V.cosine_distance("a", "b").alias("c"),
                    V.neg_inner_product("a", "b").alias("ip"), TX.normalize(F.col("s")).alias("n"),
                    TX.mask_secret(F.col("k")).alias("m"), KY.link_key(F.col("u")).alias("lk"),
                    KY.article_key(F.col("t"), F.col("u"), F.col("p")).alias("ak")).first()
    assert got.asDict() == exp.asDict()
