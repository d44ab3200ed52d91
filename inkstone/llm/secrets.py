"""Secret scans by grammar inference.

Three base patterns find labelled credentials: assignments, access keys and
hexadecimal strings.  From a bounded sample of them, one probabilistic
automaton per kind is inferred: the values form a prefix tree with counts, and
states whose outgoing frequencies agree within a Hoeffding bound, all the way
down, are merged, the most frequent first.  Every other long token with a digit is then scored (in
pieces where it has dots) by its likelihood under each automaton, per character and against tokens of evenly
mixed characters.  Tokens at least as likely as the weakest hundredth of the
labelled values are added as spans of kind ``format_<kind>``; base spans stay.

Spans are code points, end exclusive, and cover the whole match.

Edge cases: a null or empty text has no spans; with fewer than 20 distinct
labelled values of a kind that kind has no automaton; an empty table gives an empty result; rows
that repeat a doc_id are scanned each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_batches, stored, texts

KINDS = ("assign", "access", "hex")
#: The base patterns, the group that holds the value, and its least length.
PATTERNS = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Tokens that are scored: long runs with a digit, outside base spans.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: Distinct labelled values of each kind that the inference sees at most, and the most characters of one; whole tokens
#: of any length are scored.
PER_KIND, VALUE_CHARS = 500, 256
#: Confidence of the Hoeffding bound: smaller merges more.
ALPHA = 0.05
SYMBOLS = 67

_SPAN = "struct<kind:int,start:int,end:int,value:string>"
_span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all base matches, by start, then kind."""
    found = []
    for k, kind in enumerate(KINDS):
        pattern, group, least = _BASE[kind]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((k, m.start(), m.end(), m.group(group)))
    return sorted(found, key=lambda s: (s[1], s[0]))


# a run shorter than the least length fails as a whole, so the last two patterns can ask for the length at once
_BASE = {"assign": (re.compile(PATTERNS["assign"][0]), 2, 6),
         "access": (re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),
         "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24)}
_CANDIDATE = re.compile(CANDIDATE)
_DIGIT = re.compile("[0-9]")


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens to be scored, without those that touch a base span (``taken``, by start)."""
    out, at, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        # both lists are in order: spans that begin before the token's end, and how far any of them reaches
        while at < len(taken) and taken[at][1] < m.end():
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= m.start() and _DIGIT.search(m.group()):
            out.append((-1, m.start(), m.end(), m.group()))
    return out


class Automaton:
    """A probabilistic automaton: per state arrivals, ends, and edges with counts."""

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.arrive, self.end, self.edge = [0], [0], [{}]
        for word in words:
            s = 0
            self.arrive[0] += 1
            for c in word:
                if c not in self.edge[s]:
                    self.edge[s][c] = [0, len(self.edge)]
                    self.arrive.append(0)
                    self.end.append(0)
                    self.edge.append({})
                step = self.edge[s][c]
                step[0] += 1
                s = step[1]
                self.arrive[s] += 1
            self.end[s] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrive[a], self.arrive[b]
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for c in self.edge[a].keys() | self.edge[b].keys():
                x, y = self.edge[a].get(c), self.edge[b].get(c)
                if self._differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y and x[1] != y[1] and x[1] != a:
                    todo.append((x[1], y[1]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the counts of the tree below ``b`` to ``a`` and what follows it."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrive[a] += self.arrive[b]
            self.end[a] += self.end[b]
            for c, (n, t) in self.edge[b].items():
                if c in self.edge[a]:
                    self.edge[a][c][0] += n
                    todo.append((self.edge[a][c][1], t))
                else:
                    self.edge[a][c] = [n, t]

    def _infer(self) -> None:
        kept = [0]
        while True:
            fringe = [(self.arrive[t], s, c, t) for s in kept for c, (_, t) in self.edge[s].items() if t not in kept]
            if not fringe:
                break
            _, s, c, t = max(fringe, key=lambda x: (x[0], -x[1], x[2]))  # the most frequent first
            for r in kept:
                if self._compatible(r, t):
                    self.edge[s][c][1] = r
                    self._fold(r, t)
                    break
            else:
                kept.append(t)
        self.states = len(kept)
        number = {s: k for k, s in enumerate(kept)}
        self.arrive = [self.arrive[s] for s in kept]
        self.end = [self.end[s] for s in kept]
        self.edge = [{c: (n, number[t]) for c, (n, t) in self.edge[s].items()} for s in kept]

    def score(self, word: str) -> float:
        """Log likelihood per character, above that of evenly mixed characters of any length."""
        s, total = 0, 0.0
        for c in word:
            n, t = self.edge[s].get(c, (0, s))  # unseen characters cost most and keep the state
            total += math.log((n + 0.01) / (self.arrive[s] + 0.01 * (SYMBOLS + 1)))
            s = t
        total += math.log((self.end[s] + 0.01) / (self.arrive[s] + 0.01 * (SYMBOLS + 1)))
        return total / (len(word) + 1) + math.log(SYMBOLS)


class Grammar:
    """One automaton per kind and the score from which a token counts."""

    def __init__(self, values: dict[str, list[str]]) -> None:
        self.automata = {}
        for kind, words in values.items():
            if len(words) >= 20:
                a = Automaton(words)
                scores = sorted(a.score(w) for w in words)
                self.automata[kind] = (a, scores[len(scores) // 100])

    def kind_of(self, token: str) -> str | None:
        """The kind whose format the token has, or None."""
        scores = ((a.score(token), least, k) for k, (a, least) in self.automata.items())
        # each automaton by its own threshold; of those that accept, the one with the highest score
        best = max((s for s in scores if s[0] >= max(s[1], 0.0)), default=None)
        return best[2] if best else None


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, other) of (doc_id, text): base spans and tokens to be scored, in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, other = [], []
            for text in batch.column("text").to_pylist():
                base.append(base_spans(text))
                other.append(candidates(text, base[-1]))
            named = [[[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in row] for row in col]
                     for col in (base, other)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(col, pa.list_(_span)) for col in named)], ["doc_id", "base", "other"])

    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, base array<{_SPAN}>, other array<{_SPAN}>")


def learn(found: DataFrame, per_kind: int = PER_KIND) -> Grammar:
    """Infer the automata from at most ``per_kind`` distinct labelled values of each kind, those that hash lowest.

    Values of more than ``VALUE_CHARS`` characters are not learned from, so the driver sees at most
    ``per_kind * VALUE_CHARS`` characters of a kind.
    """
    values = found.select(F.explode("base").alias("s")).where(F.length("s.value") <= VALUE_CHARS).select(
        "s.kind", "s.value").distinct()
    rows = []
    for k in range(len(KINDS)):
        rows += values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(per_kind).collect()
    return Grammar({kind: sorted(r["value"] for r in rows if r["kind"] == k) for k, kind in enumerate(KINDS)})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_kind: int = PER_KIND) -> DataFrame:
    """doc_id, base (spans of the patterns), added (spans by format likelihood); spans: kind, start, end, value."""
    found = stored(extract(texts(docs, id_col, text_col)), "spans")
    shared = docs.sparkSession.sparkContext.broadcast(learn(found, per_kind))

    @F.pandas_udf("array<string>")
    def formats(tokens):
        # per distinct token once; None where no automaton accepts
        known: dict[str, str | None] = {}
        out = []
        for row in tokens:
            for token in row:
                if token not in known:
                    known[token] = shared.value.kind_of(token)
            out.append([known[t] for t in row])
        return tokens.__class__(out)

    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.struct(
        kinds[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    tokens = found.withColumn("format", F.when(F.size("other") > 0, formats(F.transform("other", lambda s: s["value"]))))
    added = F.transform("other", lambda s, i: F.struct(
        F.concat(F.lit("format_"), F.col("format")[i]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["value"].alias("value")))
    return tokens.select("doc_id", base.alias("base"), F.filter(added, lambda s: s["kind"].isNotNull()).alias("added"))


def joined(spans) -> F.Column:
    """kind:start:end of spans that are in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = [_number(k).alias(f"n_{k}") for k in KINDS]
    # added spans never touch base spans, so start alone orders them among these
    order = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(_rank(a) - _rank(b)))
    return scanned.select("doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined(order).alias("spans"))


def _number(kind: str) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _rank(span):
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"]).cast("int")
