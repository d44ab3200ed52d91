"""Content keys (hashes) used for de-duplication and skip sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _b64_md5(*parts: Column) -> Column:
    return F.base64(F.unhex(F.md5(F.concat(*parts))))


def article_key(title: Column, url: Column, published_at: Column) -> Column:
    """base64(md5(title || url || UTC date 'yyyy-MM-dd')).

    User articles pass their *source* in the url slot.
    """
    return _b64_md5(F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")),
                    F.date_format(published_at, "yyyy-MM-dd"))


def page_key(url: Column, title: Column, published: Column, modified: Column) -> Column:
    """base64(md5(url || title || published || modified)), times as RFC3339 UTC."""
    fmt = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return _b64_md5(url, title, F.date_format(published, fmt), F.date_format(modified, fmt))


def link_key(link: Column) -> Column:
    """Hex md5 of the link without its ``https://`` prefix (one canonical key)."""
    return F.md5(F.regexp_replace(link, "^https://", ""))
