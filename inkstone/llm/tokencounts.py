"""Token counts of document sections by offset-mapped attribution.

Each whole document is encoded once by a byte-level BPE.  Its tokens follow
each other byte by byte, so their lengths give the characters that each one
covers; the sorted token spans are joined with the sorted section spans, and a
token that crosses a boundary is allocated by rule:

* ``first``: to the section of its first character,
* ``most``: to the section with most of its characters, the earlier on a tie.

Counts of a document's sections therefore add up to its tokens.  Sections here
are the text's lines, each with the line break that ends it.

Edge cases: a null or empty text has one empty section without tokens; a final
line break does not open a section; very long texts are encoded whole; rows
that repeat a doc_id are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from inkstone.llm.common import arrow_batches, texts

RULES = ("first", "most")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def line_sections(data: np.ndarray) -> np.ndarray:
    """Starts and final end, in bytes, of the lines of UTF-8 ``data``."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(data)], [len(data)]))


def allocate(token_ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and, of those, tokens that cross a boundary.

    ``token_ends``: ends of consecutive tokens; ``edges``: section starts and
    the final end; both count characters from 0.
    """
    sections = len(edges) - 1
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(edges[1:], starts, side="right")
    first = np.minimum(first, sections - 1)
    last = np.minimum(np.searchsorted(edges[1:], np.maximum(token_ends - 1, starts), side="right"), sections - 1)
    chosen = first.copy()
    if rule == "most":
        for k in np.flatnonzero(last > first).tolist():
            parts = np.arange(first[k], last[k] + 1)
            share = np.minimum(edges[parts + 1], token_ends[k]) - np.maximum(edges[parts], starts[k])
            chosen[k] = parts[int(np.argmax(share))]
    return np.bincount(chosen, minlength=sections), np.bincount(chosen[last > first], minlength=sections)


def attribute(text: str, encode: Callable[[str], np.ndarray], lengths: np.ndarray, rule: str) -> list[tuple]:
    """(section, start, end, n_tokens, n_crossing) of one text, in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    # characters that begin up to each byte: a token counts where its first byte's character is
    char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    edges = char[line_sections(data)]
    ends = np.cumsum(lengths[encode(text)]) if len(data) else np.zeros(0, np.int64)
    n, crossing = allocate(char[ends], edges, rule) if len(ends) else (np.zeros(len(edges) - 1, int),) * 2
    return list(zip(range(len(n)), edges[:-1].tolist(), edges[1:].tolist(), n.tolist(), crossing.tolist(), strict=True))


def section_counts(docs: DataFrame, ranks_path: str, rule: str = "most", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: one row per section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    plain = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        coder = tiktoken.Encoding("lines", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        for batch in batches:
            rows = [attribute(t, coder.encode_to_numpy, lengths, rule) for t in batch.column("text").to_pylist()]
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            flat = [x for r in rows for x in r]
            cols = [pa.array(c, pa.int64()) for c in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), *cols],
                                             ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    arrow_batches(docs.sparkSession)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")
