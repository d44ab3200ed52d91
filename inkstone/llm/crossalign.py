"""Cross-tokenizer alignment by whitespace-token anchors.

Every text, with a blank before it, is fully encoded by a byte-level BPE (A)
and by a SentencePiece model (B).  Where a token of either ends at the same
byte they share an end; shared ends cut a document into groups, and all A and B
tokens of a group are linked.  A shared end before which both go on with a
space-marked token is an anchor.  Anchors cut the two id sequences into windows
of about a word, and as an id determines its token's bytes, a window's groups
and links depend on its ids alone: they are found once per pair of id tuples
and kept.  Whether ends are really shared is verified for every document: the
joined bytes of both sequences must equal the text, or it has no tokens.

An id pair counts once per document that holds it linked.  Documents go through
the job in blocks: a block lists each of its pairs once, with the number of its
documents, so only those lists are shuffled; counts, and whether a count is the
highest of its A id (at most one row per id of A's vocabulary), go back to the
blocks in the same form.  A pair that every document holds is one row per block.

Edge cases: a null or empty text, and one that either tokenizer does not give
back byte by byte (control characters that SentencePiece drops, its blank mark
in a text), has zeros and an empty digest; special tokens' strings are ordinary
text; rows that repeat a doc_id are documents each; a text without blanks is
one window, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.bytebpe import ByteBpe
from inkstone.llm.common import arrow_batches, stored, texts

#: Pairs that the documents of a block hold, in all, before it is closed, and the most documents of a block.
BLOCK_PAIRS, BLOCK_DOCS = 1_000_000, 20_000
#: Windows kept by a worker, half of them found lately and half before those, and the most tokens of a window that is
#: kept; results never depend on it.
HELD_WINDOWS = 240_000
WINDOW_TOKENS = 48
#: Links of a group beyond which its distinct pairs are found first.
LARGE_GROUP = 1024
SPACE = 0x20
_MARK = "▁"
#: Characters that normalising models change: compatibility forms, composed and decomposed letters, blanks, case.
PROBE = "Ａﬁ①²½ÅÅé e\u0301 ﾊﾟ\u00a0x\u3000y  z\tT\r\nİßΣς한\u1112\u1161\u11ab "


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of every piece: UTF-8 with the mark as a blank, and the byte itself for byte pieces."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_MARK, " ").encode())
    return out


def _distinct(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a * width + b) of a group and how often each is linked."""
    x, nx = np.unique(a.astype(np.int64), return_counts=True)
    y, ny = np.unique(b.astype(np.int64), return_counts=True)
    return (x[:, None] * width + y[None, :]).ravel(), (nx[:, None] * ny[None, :]).ravel()


class Groups:
    """The groups of a document, of which windows are runs: group g has the A tokens cut_a[g] to cut_a[g + 1], and so B."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, width: int, size_a: int):
        self.a, self.b, self.width = a.astype(np.int64), b.astype(np.int64), width
        self.cut_a, self.cut_b = cut_a, cut_b
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        self.token = (cut_a + cut_b).tolist()
        # a token's string with what follows it: see Aligner._strings
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a[1:] - 1] = last_b[cut_b[1:] - 1] = True
        codes[np.arange(len(a)) + np.repeat(cut_b[:-1], n_a)] = self.a + size_a * last_a
        codes[np.arange(len(b)) + np.repeat(cut_a[1:], n_b)] = self.b + 2 * size_a + width * last_b
        self.codes = codes.tolist()
        # links of ordinary groups one by one; those of large groups as distinct pairs, when a window asks for them
        self.large = np.flatnonzero(n_a * n_b > LARGE_GROUP).tolist()
        each = np.where(n_a * n_b > LARGE_GROUP, 0, n_a * n_b)
        first = np.concatenate(([0], np.cumsum(each)))
        at = np.arange(first[-1]) - np.repeat(first[:-1], each)
        per = np.repeat(n_b, each)
        self.pairs = (self.a[np.repeat(cut_a[:-1], each) + at // per] * width + self.b[
            np.repeat(cut_b[:-1], each) + at % per]).tobytes()
        self.place = (8 * first).tolist()

    def window(self, g: int, h: int, strings: list[str]) -> tuple[str, bytes, bytes | None]:
        """Text, linked pairs, and how often each (None: as often as it is listed) of groups g to h."""
        text = "".join(map(strings.__getitem__, self.codes[self.token[g]:self.token[h]]))[:-1]
        pairs, times = self.pairs[self.place[g]:self.place[h]], None
        if self.large and (large := [k for k in self.large if g <= k < h]):
            more = [_distinct(self.a[self.cut_a[k]:self.cut_a[k + 1]], self.b[self.cut_b[k]:self.cut_b[k + 1]], self.width)
                    for k in large]
            times = np.concatenate([np.ones(len(pairs) // 8, np.int64), *(t for _, t in more)]).tobytes()
            pairs += b"".join(p.tobytes() for p, _ in more)
        return text, pairs, times


class Aligner:
    """Alignment in one worker."""

    def __init__(self, path_a: str, path_b: str):
        self._a = ByteBpe(path_a, special_as_text=True)
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self._bytes_a, self._bytes_b = self._a.token_bytes, piece_bytes(self._b)
        self._length_a = np.array([len(t) for t in self._bytes_a], np.int64)
        self._length_b = np.array([len(t) for t in self._bytes_b], np.int64)
        self._space_a = np.array([t[:1] == b" " for t in self._bytes_a])
        self._space_b = np.array([t[:1] == b" " for t in self._bytes_b])
        #: A pair is a * width + b.
        self.width = len(self._bytes_b)
        sides = (range(len(self._bytes_a)), ",|"), (range(self.width), ",;")
        self._strings = [f"{i}{mark}" for ids, marks in sides for mark in marks for i in ids]
        # windows found or met lately, and those before them, which go when the former are half of what may be held
        self._held: dict[bytes, tuple] = {}
        self._older: dict[bytes, tuple] = {}
        # B rewrites nothing but its mark, three bytes, as a blank: lengths then tell whether bytes are the text's
        self._plain_b = self._b.normalize(PROBE) == _MARK + PROBE.replace(" ", _MARK)

    def encode(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of either side per text; None where a side does not give the text back."""
        side_a = self._a.encode([" " + t for t in batch])
        side_b = self._b.encode(batch, num_threads=1)
        out = []
        for text, a, ids in zip(batch, side_a, side_b, strict=True):
            a, b = np.frombuffer(a, self._a.dtype), np.frombuffer(array("I", ids), np.uint32)
            size = len(text.encode()) + 1
            # a byte-level BPE only cuts a text's bytes, and so does a model that changes no characters but to shorten them
            same = text and int(self._length_a[a].sum()) == size == int(self._length_b[b].sum())
            if same and not self._plain_b:
                same = b"".join(map(self._bytes_b.__getitem__, ids)) == (" " + text).encode()
            out.append((a, b) if same else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, str, np.ndarray, np.ndarray]:
        """Groups, links, the groups as text, distinct linked pairs and how often each is linked."""
        end_a, end_b = np.cumsum(self._length_a[a]), np.cumsum(self._length_b[b])
        shared = np.zeros(int(end_a[-1]) + 1, np.uint8)
        shared[end_a] = 1
        shared[end_b] += 2
        cut_a, cut_b = np.flatnonzero(shared[end_a] == 3) + 1, np.flatnonzero(shared[end_b] == 3) + 1
        # anchors: shared ends before space-marked tokens of both sides; the text's end closes the last window
        anchor = self._space_a[a[cut_a[:-1]]] & self._space_b[b[cut_b[:-1]]]
        cut_a, cut_b = np.concatenate(([0], cut_a)), np.concatenate(([0], cut_b))
        edge = np.concatenate(([0], np.flatnonzero(anchor) + 1, [len(cut_a) - 1]))
        # a window's key: its A ids, then its B ids with A's size added, so one tuple of numbers names both
        edge_a, edge_b, held = cut_a[edge], cut_b[edge], self._held
        both = np.empty(len(a) + len(b), np.uint32)
        both[np.arange(len(a)) + np.repeat(edge_b[:-1], np.diff(edge_a))] = a
        both[np.arange(len(b)) + np.repeat(edge_a[1:], np.diff(edge_b))] = b + np.uint32(len(self._bytes_a))
        raw = both.tobytes()
        keys = [raw[i:j] for i, j in pairwise((4 * (edge_a + edge_b)).tolist())]
        found = list(map(held.get, keys))
        if None in found:
            groups, older = None, self._older
            for k in [k for k, made in enumerate(found) if made is None]:
                key = keys[k]
                made = older.get(key)
                if made is None:
                    if groups is None:
                        groups, edge = Groups(a, b, cut_a, cut_b, self.width, len(self._bytes_a)), edge.tolist()
                    made = groups.window(edge[k], edge[k + 1], self._strings)
                found[k] = made
                if len(key) <= 4 * WINDOW_TOKENS:
                    held[key] = made
            if len(held) > HELD_WINDOWS // 2:
                self._held, self._older = {}, held
        text, pairs, times = zip(*found, strict=True)
        all_pairs = np.frombuffer(b"".join(pairs), np.int64)
        if not any(times):
            distinct, counts = np.unique(all_pairs, return_counts=True)
        else:
            distinct, at = np.unique(all_pairs, return_inverse=True)
            each = [np.ones(len(p) // 8, np.int64) if t is None else np.frombuffer(t, np.int64) for p, t in zip(pairs, times, strict=True)]
            counts = np.zeros(len(distinct), np.int64)
            np.add.at(counts, at, np.concatenate(each))
        return len(cut_a) - 1, int(np.diff(cut_a) @ np.diff(cut_b)), ";".join(text), distinct, counts


_DOC = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary())])
_BLOCK = ("block string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "at binary, times binary, pairs array<long>, docs array<int>")


def blocks(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Aligned documents, a row each, in blocks: their figures, and the block's distinct pairs with numbers of documents.

    ``at`` holds a document's pairs as places in its block's ``pairs`` (int32),
    ``times`` how often each is linked (int32, or int64 where a number is larger).
    ``pairs`` and ``docs`` stand on the block's first row, other rows have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, n, size = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        rows: list[tuple] = []
        held: list[np.ndarray] = []

        def close():
            at, distinct = pd.factorize(np.concatenate([*held, np.zeros(0, np.int64)]))
            count = np.bincount(at, minlength=len(distinct))
            places = np.split(at.astype("<i4"), np.cumsum([len(h) for h in held])[:-1])
            cols = list(zip(*rows, strict=True))
            made = [cols[0], cols[1], cols[2], cols[3], cols[4], [p.tobytes() for p in places], cols[5]]
            out = [pa.array([f"{part}-{n}"] * len(rows), pa.string()), pa.concat_arrays(ids)]
            out += [pa.array(c, f.type) for c, f in zip(made, _DOC, strict=True)]
            out += [_first(pa.array(x), len(rows)) for x in (distinct, count.astype(np.int32))]
            names = ["block", "doc_id", *_DOC.names, "pairs", "docs"]
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for k, both in enumerate(aligner.encode(batch.column("text").to_pylist())):
                if both is None:
                    row, pairs = (0, 0, 0, 0, "", b""), np.zeros(0, np.int64)
                else:
                    groups, links, text, pairs, times = aligner.align(*both)
                    row = (len(both[0]), len(both[1]), groups, links, hashlib.sha256(text.encode()).hexdigest(), _narrow(times).tobytes())
                ids.append(batch.column("doc_id").slice(k, 1))
                rows.append(row)
                held.append(pairs)
                size += len(pairs)
                if size >= block_pairs or len(rows) >= BLOCK_DOCS:
                    yield close()
                    n, size, ids, rows, held = n + 1, 0, [], [], []
        if rows:
            yield close()

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, _BLOCK.format(kind=kind))


def _first(values: pa.Array, rows: int) -> pa.Array:
    """A list of all ``values``, then empty ones."""
    return pa.ListArray.from_arrays(pa.array([0] + [len(values)] * rows, pa.int32()), values)


def _narrow(times: np.ndarray) -> np.ndarray:
    return times.astype("<i4") if not len(times) or times.max() < 1 << 31 else times.astype("<i8")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no pair of its A id is in more."""
    each = aligned.select(F.inline(F.arrays_zip("pairs", "docs")))
    n = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").cast("long").alias("n")), "pair-counts")
    first = F.expr(f"pair div {width}")
    # at most one row per id of A's vocabulary
    top = n.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    return n.withColumn("a", first).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document."""
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned = stored(blocks(texts(docs, id_col, text_col), path_a, path_b, block_pairs), "aligned")
    listed = aligned.select("block", F.posexplode("pairs").alias("pos", "pair"))
    answers = listed.join(pair_counts(aligned, width), "pair").select(F.col("block").alias("of"), "pos", "n", "best")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        pos = right.column("pos").to_numpy()
        n[pos], best[pos] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sums, bests = [], []
        for at, times in zip(left.column("at"), left.column("times"), strict=True):
            at, times = np.frombuffer(at.as_buffer(), "<i4"), times.as_buffer()
            times = np.frombuffer(times, "<i4" if times.size == at.nbytes else "<i8").astype(np.int64)
            sums.append(int(times @ n[at]))
            bests.append(int(times[best[at]].sum()))
        cols = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table({**cols, "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()),
                         "groups_sha256": left.column("groups_sha256")})

    # both sides of a block: a row per document, and one per distinct pair; a block is bounded by its documents' pairs
    return aligned.drop("pairs", "docs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
