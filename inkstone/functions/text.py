"""String column functions (JVM-side ``pyspark.sql.functions`` only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Go's strings.TrimSpace removes (unicode.IsSpace), as a Java/RE2 class body.
GO_SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Full-width -> ASCII overrides applied before the generic
# U+FF01..U+FF5E shift, in the reference's order.
FULLWIDTH_MAP = [
    ("！", "!"), ("？", "?"), ("，", ","), ("。", "｡"), ("：", ":"), ("；", ";"),
    ("（", "("), ("）", ")"), ("［", "["), ("］", "]"), ("｛", "{"), ("｝", "}"),
    ("【", "["), ("】", "]"), ("「", '"'), ("」", '"'), ("『", '"'), ("』", '"'),
    ("、", ","), ("《", "<"), ("》", ">"), ("〈", "<"), ("〉", ">"), ("～", "~"),
    ("＃", "#"), ("％", "%"), ("＆", "&"), ("＊", "*"), ("＠", "@"), ("＄", "$"),
    ("＾", "^"), ("＿", "_"), ("＋", "+"), ("－", "-"), ("＝", "="), ("｜", "|"),
    ("＼", "\\"), ("／", "/"), ("＂", '"'), ("＇", "'"), ("｀", "`"), ("＜", "<"),
    ("＞", ">"),
]


def fullwidth_tables() -> tuple[str, str]:
    """(from, to) strings for ``translate``: the override map, then the rest of
    the U+FF01..U+FF5E block shifted down by 0xFEE0."""
    src = [a for a, _ in FULLWIDTH_MAP]
    dst = [b for _, b in FULLWIDTH_MAP]
    seen = set(src)
    for cp in range(0xFF01, 0xFF5F):
        ch = chr(cp)
        if ch not in seen:
            src.append(ch)
            dst.append(chr(cp - 0xFEE0))
    return "".join(src), "".join(dst)


def fullwidth_to_ascii(s: Column) -> Column:
    a, b = fullwidth_tables()
    return F.translate(s, a, b)


def normalize(s: Column, keep_spaces: bool = False) -> Column:
    """NBSP -> space; whitespace runs -> one space; drop control chars and U+3000.

    The reference's deletion class also contains an ordinary space, so by
    default all spaces vanish ("a b" -> "ab"); ``keep_spaces=True`` keeps them.
    """
    s = F.regexp_replace(s, "\u00a0", " ")
    s = F.regexp_replace(s, r"[\t\n\f\r ]+", " ")
    cls = r"[\x00-\x1F\x7F-\x9F\x{3000}" + ("" if keep_spaces else " ") + "]"
    return F.regexp_replace(s, cls, "")


def go_trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{GO_SPACE}]+|[{GO_SPACE}]+$", "")


def mask_secret(s: Column, mark: str = "●", cap: int | None = 10) -> Column:
    """Show 5 leading and 5 trailing bytes; of at most 10 bytes all are masked.

    ``cap`` limits the number of mask marks (None = the template variant).  A
    character that the cut splits stays as its remaining bytes.
    """
    data = s.cast("binary")
    n = F.octet_length(s)
    middle = n - 10 if cap is None else F.least(n - 10, F.lit(cap))
    return F.when(n <= 10, F.repeat(F.lit(mark), n)).otherwise(F.concat(
        F.substring(data, 1, 5).cast("string"), F.repeat(F.lit(mark), middle), F.substring(data, n - 4, F.lit(5)).cast("string")))


def title_and_body(text: Column) -> Column:
    """struct(title, lines): first line starting with '#' is the title, the rest
    are trimmed and empty lines dropped."""
    lines = F.split(text, "\n")
    first = F.element_at(lines, 1)
    has_title = first.startswith("#")
    title = F.when(has_title, go_trim(F.substring(first, 2, 1 << 30))).otherwise(F.lit(""))
    rest = F.when(has_title, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    body = F.filter(F.transform(rest, lambda x: go_trim(x)), lambda x: F.length(x) > 0)
    return F.struct(title.alias("title"), body.alias("lines"))


def description_fallback(description: Column, contents: Column, n: int = 100) -> Column:
    """Description, or contents joined by a space cut to n code points + '...'."""
    joined = F.array_join(contents, " ")
    cut = F.when(F.length(joined) > n, F.concat(F.substring(joined, 1, n), F.lit("..."))).otherwise(joined)
    return F.when(F.coalesce(description, F.lit("")) == "", cut).otherwise(description)


def log_level(line: Column) -> Column:
    """``"level":"x"`` value or 'unknown' (RE2 ``\\s`` / ``\\w`` semantics)."""
    lvl = F.regexp_extract(line, r'"level"[\t\n\f\r ]*:[\t\n\f\r ]*"([A-Za-z0-9_]+)"', 1)
    return F.when(lvl == "", F.lit("unknown")).otherwise(lvl)


def instruct_query(instruct: Column, query: Column) -> Column:
    """Prompt template ``Instruct: {instruct}\\nQuery: {query}``."""
    return F.concat(F.lit("Instruct: "), instruct, F.lit("\nQuery: "), query)


def prefixed(prefix: Column, content: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), content)


def is_uuid_v4(s: Column, canonicalise: bool = False) -> Column:
    """Version-4 UUID text.  The path rule is lowercase-only; ``canonicalise``
    first lower-cases (an id that was parsed and re-printed)."""
    v = F.lower(s) if canonicalise else s
    return v.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)


def url_well_formed(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+[^\s]*$")
