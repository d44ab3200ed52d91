"""Registered injection scans (2.9.10, 2.9.11)."""

from __future__ import annotations

from inkstone.functions import regexes as R
from inkstone.operators import scan as S
from inkstone.plans.registry import register
from inkstone.sources.tables import table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GO_CASE = "CAST(CASE " + " ".join(
    f"WHEN regexp_matches(text, {_q(p)}) THEN {i}" for i, p in enumerate(R.GO_INJECTION_PATTERNS, 1)) + " END AS BIGINT)"


@register("injection_scan", f"""
SELECT doc_id, first_pattern, first_pattern IS NOT NULL AS matched
FROM (SELECT doc_id, {_GO_CASE} AS first_pattern FROM documents)
""")
def injection_scan(spark, sf_dir):
    """2.9.10: first matching server-side injection pattern per document."""
    d = table(spark, sf_dir, "documents")
    return S.injection_scan(d).select("doc_id", "first_pattern", "matched")


_UI_RE2 = [(f, R.js_to_re2(s, fl)) for f, s, fl in R.UI_INJECTION_PATTERNS]
_UI_HITS = " + ".join(f"CAST(regexp_matches(text, {_q(p)}) AS BIGINT)" for _, p in _UI_RE2)
_UI_FIRST = "CAST(CASE " + " ".join(
    f"WHEN regexp_matches(text, {_q(p)}) THEN {i}" for i, (_, p) in enumerate(_UI_RE2, 1)) + " END AS BIGINT)"
_UI_FAMS = "concat_ws(',', " + ", ".join(
    "CASE WHEN " + " OR ".join(f"regexp_matches(text, {_q(p)})" for f2, p in _UI_RE2 if f2 == fam)
    + f" THEN {_q(fam)} END" for fam in R.UI_FAMILIES) + ")"


@register("injection_scan_ui", f"""
SELECT doc_id, {_UI_HITS} AS n_hits, {_UI_FIRST} AS first_pattern, {_UI_FAMS} AS families
FROM documents
""")
def injection_scan_ui(spark, sf_dir):
    """2.9.11: browser-side pattern table: hit count, first pattern and families hit."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.injection_scan_families(d).select("doc_id", "n_hits", "first_pattern", "families")
