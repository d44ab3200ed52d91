"""Article extraction from raw HTML pages as one Spark job.

Only tree building and selection are Python: one ``mapInPandas`` runs the
stdlib ``html.parser`` over each Arrow batch and returns raw strings (title,
blocks, dates, metadata, link targets).  Normalisation, the related-block
filter, date cascades, metadata fields, keys and status are JVM-side column
expressions.  Site layouts are plain data (``SITES``), so one job serves them
all; a page's site is a column.
"""

from __future__ import annotations

import re
from functools import cache
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions import dates as D
from inkstone.functions import keys as KY
from inkstone.functions import text as TX

# The site layouts.
#   container   element that everything is looked up in (the first match; default: the page)
#   title       selector; "title_all" joins all matches, else the first counts
#   content     list of (part of the page's link, selector); the first whose part occurs in the link
#   fallback    the same, for pages without content
#   fallback_if "empty": nothing but blank blocks, "absent": no match at all
#   fallback_split  the fallback is one text whose paragraphs are separated by blank lines
#   skip_first  the first content match is no content
#   related     drop blocks whose direct spans hold a "read more" phrase
#   date        selector of the date; "date_attr" names the attribute that holds it
#   no_content  "error" or "warning"
SITES = {
    "generic": {
        "title": "title", "headline": "h1", "content": [("", "article p")], "fallback": [("", "article div")],
        "text_of": "article", "date": "time", "date_attr": "datetime", "no_content": "error"},
    "dpp": {
        "container": "article.news_content", "title": "h2",
        "content": [("media", "#media_contents > p"), ("anti_rumor", "#news_contents > p")],
        "fallback": [("media", "#media_contents > div"), ("anti_rumor", "#news_contents > div")],
        "date": "p.news_content_date", "no_content": "error"},
    "kmt": {
        "container": "body #recentwork #Blog1", "title": "#div1 h3", "title_all": True,
        "content": [("", "#div1 div.post-body p")], "skip_first": True,
        "fallback": [("", "#div1 div.post-body description div")],
        "date": "#div1 div.post-footer-line i.pdt abbr.published", "date_attr": "title", "no_content": "error"},
    "tpp": {
        "container": ".news_container", "title": ".content_topic", "content": [("", ".content_description")],
        "fallback": [("", ".content_description span span")], "fallback_if": "absent", "fallback_split": True,
        "date": ".content_date", "no_content": "warning"},
    "yahoo": {
        "title": "#caas-lead-header-undefined", "title_all": True, "content": [("", ".caas-body p")], "related": True,
        "date": ".caas-attr-meta .caas-attr-time-style time", "date_attr": "datetime",
        "author": ".caas-attr-meta .caas-attr-item-author span", "publisher": ".caas-header .caas-logo .caas-attr-provider",
        "jsonld": ".caas-container script[type='application/ld+json']", "no_content": "error"},
}

# Phrases marking "related / read more" blocks, in the reference's order.
RELATED_PHRASES = ["更多", "延伸閱讀", "相關新聞", "相關報導", "相關文章", "相關內容", "延伸內容", "延伸報導", "延伸文章"]

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                    "main nav ol p pre section table ul".split())


class _Node:
    __slots__ = ("tag", "attrs", "up", "below")

    def __init__(self, tag: str, attrs: dict, up: _Node | None) -> None:
        self.tag, self.attrs, self.up, self.below = tag, attrs, up, []

    def nodes(self):
        """All elements below, in document order (no recursion: pages nest arbitrarily deep)."""
        todo = [x for x in reversed(self.below) if isinstance(x, _Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [x for x in reversed(n.below) if isinstance(x, _Node)]

    def text(self) -> str:
        out, todo = [], list(reversed(self.below))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.below)
        return "".join(out)


class _Tree(HTMLParser):
    """A page as nodes.  A block element ends an open paragraph; end tags without a start are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            n = self.at
            while n.up is not None and n.tag in ("b", "strong", "i", "em", "u", "span", "a", "font", "small"):
                n = n.up
            if n.tag == "p":
                self.at = n.up
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.below.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag:
            self.at = self.at.up

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.below.append(data)


_PART = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]")


@cache
def _steps(selector: str) -> tuple:
    """Compounds of a selector, left to right: (is a child step, tag, id, classes, attributes)."""
    out, child = [], False
    for word in re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+|>", selector):
        if word == ">":
            child = True
            continue
        tag = re.match(r"[\w-]*", word)[0].lower()
        parts = _PART.findall(word[len(tag):])
        ids = [v for mark, v, _, _ in parts if mark == "#"]
        out.append((child, tag, ids[0] if ids else None, tuple(v for mark, v, _, _ in parts if mark == "."),
                    tuple((a, v) for mark, _, a, v in parts if a)))
        child = False
    return tuple(out)


def _fits(n: _Node, step: tuple) -> bool:
    _, tag, id_, classes, attrs = step
    if (tag and n.tag != tag) or (id_ is not None and n.attrs.get("id") != id_):
        return False
    mine = n.attrs.get("class", "").split() if classes else ()
    return all(c in mine for c in classes) and all(a in n.attrs and (not v or n.attrs[a] == v) for a, v in attrs)


def _reached(n: _Node, steps: tuple) -> bool:
    if not _fits(n, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    up = n.up
    while up is not None and up.tag:
        if _reached(up, steps[:-1]):
            return True
        if steps[-1][0]:
            return False
        up = up.up
    return False


def select(root: _Node, selector: str | None) -> list[_Node]:
    """Elements below ``root`` that match tags, ids, classes, attributes, descendants and children."""
    return [n for n in root.nodes() if _reached(n, _steps(selector))] if selector else []


def tree(html: str) -> _Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _by_link(choices: list, link: str) -> str | None:
    return next((s for part, s in choices if part in link), None)


_SPACE = re.compile(r"[\s　\xa0]+")


def _filled(texts: list[str]) -> bool:
    return any(_SPACE.sub("", t) for t in texts)


def _resolved(base: str, hrefs: list[str]) -> list[str]:
    """Distinct absolute targets without fragments."""
    out = {}
    for href in hrefs:
        try:
            out[urldefrag(urljoin(base, href.strip()))[0]] = None
        except ValueError:  # not a URL at all
            continue
    return list(out)


def pick(html: str, link: str, site: dict) -> dict:
    """Raw strings of one page."""
    page = tree(html)
    root = page
    if site.get("container"):
        found = select(page, site["container"])
        root = found[0] if found else _Node("", {}, None)
    title = select(root, site["title"])
    blocks = select(root, _by_link(site["content"], link))
    matched = bool(blocks)
    blocks = blocks[1:] if site.get("skip_first") else blocks
    content = [(b.text(), "".join(x.text() for x in b.below if isinstance(x, _Node) and x.tag == "span")
                if any(isinstance(x, _Node) and x.tag == "span" for x in b.below) else None) for b in blocks]
    source = "block"
    lacking = not matched if site.get("fallback_if") == "absent" else not _filled([t for t, _ in content])
    if lacking and site.get("fallback"):
        other = [n.text() for n in select(root, _by_link(site["fallback"], link))]
        if site.get("fallback_split"):
            parts = [p for p in (other[0] if other else "").split("\n\n") if _filled([p])]
            other = parts or other[:1]
        if _filled(other):
            content, source = [(t, None) for t in other], "fallback"
    if site.get("text_of") and not _filled([t for t, _ in content]):
        whole = "".join(n.text() for n in select(root, site["text_of"])[:1])
        content = [(p, None) for p in re.split(r"\n\s*\n", whole) if p.strip()]
        source = "text"
    date = select(root, site.get("date"))
    jsonld = select(root, site.get("jsonld"))
    return {
        "raw_title": "".join(n.text() for n in (title if site.get("title_all") else title[:1])),
        "raw_headline": "".join(n.text() for n in select(root, site.get("headline"))[:1]),
        "raw_blocks": [{"text": t, "span": s} for t, s in content], "block_source": source,
        "date_attr": date[0].attrs.get(site.get("date_attr")) if date else None,
        "date_text": date[0].text() if date else None,
        "jsonld": jsonld[0].text() if jsonld else None,
        "author": "".join(n.text() for n in select(root, site.get("author"))),
        "publisher": "".join(n.text() for n in select(root, site.get("publisher"))),
        "targets": _resolved(link, [n.attrs["href"] for n in page.nodes() if n.tag == "a" and "href" in n.attrs]),
    }


_BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("span", T.StringType())])
PARSED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("link", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("raw_title", T.StringType()),
    T.StructField("raw_headline", T.StringType()),
    T.StructField("raw_blocks", T.ArrayType(_BLOCK)),
    T.StructField("block_source", T.StringType()),
    T.StructField("date_attr", T.StringType()),
    T.StructField("date_text", T.StringType()),
    T.StructField("jsonld", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("parse_error", T.StringType()),
])
_NOTHING = {"raw_title": "", "raw_headline": "", "raw_blocks": [], "block_source": "none", "date_attr": None, "date_text": None,
            "jsonld": None, "author": "", "publisher": "", "targets": []}


def _parser(sites: dict):
    def run(batches):
        for pdf in batches:
            out = []
            for pid, link, site, html in zip(pdf["id"], pdf["link"], pdf["site"], pdf["html"], strict=True):
                row, error = _NOTHING, None
                try:
                    row = pick(html or "", link or "", sites[site])
                except Exception as e:  # noqa: BLE001 - a page that cannot be parsed is an error row
                    error = f"{type(e).__name__}: {e}"
                out.append({"id": pid, "link": link, "site": site, **row, "parse_error": error})
            yield pd.DataFrame(out, columns=PARSED_SCHEMA.fieldNames())

    return run


def parse(pages: DataFrame, sites: dict | None = None) -> DataFrame:
    """Raw strings per page of (id, url, html[, site]); a page without a site is ``generic``."""
    site = F.coalesce("site", F.lit("generic")) if "site" in pages.columns else F.lit("generic")
    return pages.select("id", F.col("url").alias("link"), site.alias("site"), "html").mapInPandas(
        _parser({**SITES, **(sites or {})}), PARSED_SCHEMA)


_RELATED_RE = "|".join(re.escape(p) for p in RELATED_PHRASES)


def kept_blocks(site: Column, blocks: Column) -> Column:
    """2.10.3: blocks whose direct spans hold no "read more" phrase (on sites that mark them so)."""
    marked = site.isin([s for s, spec in SITES.items() if spec.get("related")])
    return F.filter(blocks, lambda b: ~(marked & F.coalesce(b["span"].rlike(_RELATED_RE), F.lit(False))))


def contents(site: Column, blocks: Column) -> Column:
    """Normalised texts of the kept blocks, without those that are empty then."""
    return F.filter(F.transform(kept_blocks(site, blocks), lambda b: TX.normalize(b["text"])), lambda t: t != "")


def jsonld_fields(doc: Column) -> dict[str, Column]:
    """2.9.25: description, keywords (sorted, distinct; string or array) and dates of a JSON-LD text."""
    words = F.get_json_object(doc, "$.keywords")
    listed = F.from_json(words, "array<string>", {"mode": "PERMISSIVE"})
    kw = F.when(words.startswith("["), F.filter(listed, lambda x: x.isNotNull())).otherwise(F.split(words, ","))
    return {"description": TX.normalize(F.get_json_object(doc, "$.description")), "keywords": F.array_distinct(F.array_sort(kw)),
            "published": D.rfc3339(F.get_json_object(doc, "$.datePublished")),
            "modified": D.rfc3339(F.get_json_object(doc, "$.dateModified"))}


def extract(pages: DataFrame, sites: dict | None = None, as_of: str = "2024-06-01 00:00:00") -> DataFrame:
    """2.10.1-2.10.4: id, link, site, title, headline, contents, date, modified, description, keywords, author,
    publisher, error, warnings.

    Dates by site: the dash, slash or RFC 3339 date of the date element; on
    ``kmt`` its attribute, else the ROC date of the first block or the month
    in the link; on ``yahoo`` JSON-LD, else the time element's attribute, else
    its Taiwanese text.  Without any, ``as_of``.
    """
    j = parse(pages, sites).withColumn("contents", contents(F.col("site"), F.col("raw_blocks")))
    site, ld = F.col("site"), jsonld_fields(F.col("jsonld"))
    attr, text = F.col("date_attr"), F.col("date_text")
    kmt = F.when(attr.isNotNull(), D.rfc3339(attr)).otherwise(D.roc_date(F.get("contents", F.lit(0)), F.col("link")))
    yahoo = F.coalesce(ld["published"], F.when(attr.isNotNull(), D.rfc3339(attr)).otherwise(D.taiwan_datetime(text)))
    generic = F.coalesce(D.site_date(attr), D.site_date(F.trim(text)))
    date = F.when(site == "kmt", kmt).when(site == "yahoo", yahoo).when(site.isin("dpp", "tpp"), D.site_date(text)).otherwise(generic)
    j = j.withColumn("found_date", date)
    date = F.coalesce("found_date", F.lit(as_of).cast("timestamp_ntz"))
    empty = F.size("contents") == 0
    soft = site.isin([s for s, spec in SITES.items() if spec["no_content"] == "warning"])
    warnings = F.filter(F.array(
        F.when(site.isin("generic", "dpp") & F.col("found_date").isNull(), F.lit("date not found, using as_of")),
        F.when((F.col("block_source") != "block") & ~empty, F.concat(F.lit("content from "), F.col("block_source"))),
        F.when(empty & soft, F.lit("no content found")),
    ), lambda w: w.isNotNull())
    return j.select(
        "id", "link", "site", TX.normalize(F.col("raw_title")).alias("title"),
        TX.normalize(F.col("raw_headline")).alias("headline"), "contents", date.alias("date"),
        F.coalesce(ld["modified"], date).alias("modified"),
        F.when(~empty, TX.description_fallback(ld["description"], F.col("contents"))).otherwise(ld["description"]).alias("description"),
        ld["keywords"].alias("keywords"), TX.normalize(F.col("author")).alias("author"), "publisher",
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(empty & ~soft, F.lit("no content")).alias("error"),
        warnings.alias("warnings"),
    )


def status(error: Column, warnings: Column, skipped: Column) -> Column:
    """2.4.5: OK / SKIPPED / ERROR, and WARNING overrides everything."""
    base = F.when(skipped, "SKIPPED").when(error.isNotNull(), "ERROR").otherwise("OK")
    return F.when(F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0, "WARNING").otherwise(base)


def assemble(extracted: DataFrame) -> DataFrame:
    """2.10.5: contents -> users.articles row (content, cuts, md5 key, source 'user')."""
    from inkstone.sources.adapters import running_byte_cuts
    ok = extracted.filter(F.col("error").isNull() & (F.size("contents") > 0))
    return ok.select(
        "id", "title", F.col("link").alias("url"), F.lit("user").alias("source"),
        F.array_join("contents", "").alias("content"),
        running_byte_cuts(F.col("contents")).alias("cuts"),
        KY.article_key(F.col("title"), F.lit("user"), F.col("date")).alias("md5"),
        F.col("date").alias("published_at"),
    )


def links(pages: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """2.10.6: (page_id, link) distinct absolute web links of each page's ``<a href>``, without fragments.

    Targets come decoded from the parser and are resolved against the page's
    URL; ``allow`` (2.2.11) lists patterns of which a link must match one.
    """
    found = parse(pages).select(F.col("id").alias("page_id"), F.explode("targets").alias("link"))
    web = found.filter(TX.url_well_formed(F.col("link")) & F.col("link").rlike("^(?i:https?)://"))
    if allow:
        web = web.filter(F.col("link").rlike("|".join(f"(?:{p})" for p in allow)))
    return web.distinct()
