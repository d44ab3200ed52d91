"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words that are most frequent in the corpus (counted over every document)
are compiled, with their token ids as output, into a minimal acyclic automaton
whose equal suffixes are shared.  The automaton is one flat file; Spark hands
it to every executor and tasks map it into memory.  A word's number, the count
of words before it in order, is the sum of the numbers on its edges, and leads
to its ids.  Words outside the lexicon go through the merge table, exactly, so
the lexicon never changes a result.

The vocabulary is a ``tokenizers`` JSON file with BPE word ends (lower case,
white space dropped), given by path.  Special tokens in a text are matched
verbatim before anything else, as the library does.  Decoding joins the
tokens' strings with a blank (the file names no decoder).

Edge cases: a null, empty or blank text has no ids and decodes to the empty
text; rows that repeat are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm.common import arrow_batches, stored, texts

#: Words compiled into the lexicon: the bound of what the driver gathers.
LEXICON_WORDS = 50_000
#: Distinct words that a worker holds in memory from batch to batch.
MEMO_WORDS = 200_000
WORD_END = "</w>"
_NEVER = 1 << 30
_SHIFT = 1 << 24  # beyond every token id
_BYTES = [bytes([b]) for b in range(256)]


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte (rule of the format)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(moved)) for b in range(256)]


@cache
def unassigned() -> re.Pattern:
    """Characters that this Python's Unicode version does not know yet."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class Vocabulary:
    """What a worker needs of a vocabulary file: pattern, merges, ids and tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        spec = json.loads(self.source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in chain(self.ids.items(), self.special.items()):
            self.tokens[i] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
        self.letters = byte_letters()
        # merges as sorted numbers of token pairs, with rank and resulting token
        key = [self.ids[a] * _SHIFT + self.ids[b] for a, b in pairs]
        order = np.argsort(key, kind="stable")
        self._pair = np.array(key, np.int64)[order]
        self._rank = order.astype(np.int32)
        self._made = np.array([self.ids[a + b] for a, b in pairs], np.int32)
        self._inner = np.array([self.ids[c] for c in self.letters], np.int32)
        self._final = np.array([self.ids[c + WORD_END] for c in self.letters], np.int32)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of token pairs; ``_NEVER`` where there is none or no second token."""
        key = a.astype(np.int64) * _SHIFT + b
        at = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
        return np.where((self._pair[at] == key) & (b >= 0), self._rank[at], _NEVER).astype(np.int32)

    def merged_all(self, words: list[str]) -> list[np.ndarray]:
        """``merged`` for many words: one merge per word and round, words of like length together."""
        data = [w.encode() for w in words]
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(data[k]))
        for a in range(0, len(order), 8192):
            group = [k for k in order[a:a + 8192] if 0 < len(data[k]) <= 64 and words[k] not in self.special]
            for k, ids in zip(group, self._merge_rounds([data[k] for k in group]), strict=True):
                out[k] = ids
        return [np.array(self.merged(w), np.int32) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _merge_rounds(self, data: list[bytes]) -> list[np.ndarray]:
        if not data:
            return []
        size = np.array([len(d) for d in data])
        wide = int(size.max())
        flat = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        part = np.full((len(data), wide + 1), -1, np.int32)
        part[row, col] = self._inner[flat]
        part[np.arange(len(data)), size - 1] = self._final[flat[np.cumsum(size) - 1]]
        rank = self._ranks_of(part[:, :-1], part[:, 1:])
        rank[part[:, :-1] < 0] = _NEVER
        live = np.arange(len(data))
        cols = np.arange(wide)
        while len(live):
            p, r = part[live], rank[live]
            k = r.argmin(axis=1)  # the lowest rank, from the left
            best = r[np.arange(len(live)), k]
            go = best < _NEVER
            live, p, r, k, best = live[go], p[go], r[go], k[go], best[go]
            at = np.arange(len(live))
            gone = cols[None, :] > k[:, None]
            p[at, k] = self._made[best]
            p[:, :-1] = np.where(gone, p[:, 1:], p[:, :-1])
            p[:, -1] = -1
            r[:, :-1] = np.where(gone[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = _NEVER
            r[at, k] = self._ranks_of(p[at, k], p[at, k + 1])
            before = np.maximum(k - 1, 0)
            r[at, before] = np.where(k > 0, self._ranks_of(p[at, before], p[at, k]), r[at, before])
            part[live], rank[live] = p, r
        return [p[:n] for p, n in zip(part, (part >= 0).sum(axis=1).tolist(), strict=True)]

    def words(self) -> Callable[[str], list[str]]:
        """Splitter of texts into normalised words; special tokens come out as they are."""
        word = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}")).findall
        # the same pattern for texts of the first 256 characters, which have few classes and are normal already
        few = self.pattern
        for kind in (r"\p{L}", r"\p{N}"):
            few = few.replace(kind, "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))))
        fast = re.compile(few.replace(r"\s", r"\t-\r \x85\xa0")).findall
        apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

        byte = {c: b for b, c in enumerate(self.letters)}
        library: list[Tokenizer] = []

        def by_library(text: str) -> list[str]:
            # characters younger than this Python's Unicode tables: take the library's
            if not library:
                library.append(Tokenizer.from_str(self.source))
            t = library[0]
            pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
            return [bytes(byte[c] for c in p).decode() for p, _ in pieces]

        def plain(text: str) -> list[str]:
            try:
                text.encode("latin-1")
                return fast(text.lower())
            except UnicodeEncodeError:
                if unassigned().search(text):
                    return by_library(text)
            # lower case letter by letter: no final form of sigma
            return word(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

        def split(text: str) -> list[str]:
            if apart is None or "<" not in text:
                return plain(text)
            parts = apart(text)
            if len(parts) == 1:
                return plain(text)
            return list(chain.from_iterable([p] if k % 2 else plain(p) for k, p in enumerate(parts)))

        return split

    def merged(self, word: str) -> list[int]:
        """Token ids of one word: the lowest-ranked pair merges first, from the left."""
        if word in self.special:
            return [self.special[word]]
        part = [self.letters[b] for b in word.encode()]
        if not part:
            return []
        part[-1] += WORD_END
        if len(part) > 32:
            return self._merged_long(part)
        rank = self.ranks.get
        while len(part) > 1:
            found = [rank(pair, _NEVER) for pair in pairwise(part)]
            least = min(found)
            if least == _NEVER:
                break
            k = found.index(least)
            part[k:k + 2] = [part[k] + part[k + 1]]
        return [self.ids[p] for p in part]

    def _merged_long(self, part: list[str]) -> list[int]:
        """The same with a queue of pairs, for words of many letters."""
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap = [(r, i, i + 1) for i in range(len(part) - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if right[i] != j or self.ranks.get((part[i], part[j])) != rank:
                continue  # one side has merged meanwhile
            part[i] += part[j]
            part[j] = ""
            right[i] = right[j]
            right[j] = -2
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, b))
        return [self.ids[p] for p in part if p]


def compile_lexicon(entries: dict[bytes, list[int]], path: str) -> None:
    """Write the minimal acyclic transducer of ``entries`` (word bytes to ids) to ``path``.

    Words are added in order; the part of the previous word that the new one
    leaves behind can no longer change, and a state of it that equals a known
    one (same finality, edges and targets) is replaced by that one.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # settled: (final, ((byte, target), ...))
    path_states: list[list] = [[False, []]]  # open: [final, edges], edge [byte, target or None]
    last = b""

    def settle(depth: int) -> None:
        while len(path_states) > depth + 1:
            final, edges = path_states.pop()
            key = (final, tuple(map(tuple, edges)))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            path_states[-1][1][-1][1] = known[key]

    ordered = sorted(w for w in entries if w)
    for word in ordered:
        same = len(os.path.commonprefix([last, word]))
        settle(same)
        for b in word[same:]:
            path_states[-1][1].append([b, None])
            path_states.append([False, []])
        path_states[-1][0] = True
        last = word
    settle(0)
    root = (False, tuple(map(tuple, path_states[0][1])))
    states.append(root)

    held = np.zeros(len(states), np.int64)  # words below each state
    labels, target, skip, first, final = bytearray(), [], [], [0], []
    for s, (is_final, edges) in enumerate(states):  # targets precede their sources
        total = int(is_final)
        for b, t in edges:
            labels.append(b)
            target.append(t)
            skip.append(total)
            total += int(held[t])
        held[s] = total
        first.append(len(target))
        final.append(int(is_final))
    ids = [entries[w] for w in ordered]
    begin = np.cumsum([0, *map(len, ids)])
    arrays = [np.array(x, np.int32) for x in (target, skip, first, final, begin, list(chain.from_iterable(ids)))]
    with open(path, "wb") as f:
        f.write(np.array([len(labels), len(states) - 1, *map(len, arrays)], np.int32).tobytes())
        for a in arrays:
            f.write(a.tobytes())
        f.write(bytes(labels))


class Lexicon:
    """A compiled lexicon mapped into memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        head = view[:32].cast("i")
        self.n_edges, self.root = head[0], head[1]
        at = 32
        for name, n in zip(("target", "skip", "first", "final", "begin", "ids"), head[2:], strict=True):
            setattr(self, name, view[at:at + 4 * n].cast("i"))
            at += 4 * n
        self._labels = at

    def __getitem__(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if the lexicon lacks it."""
        s, number, base, find, first = self.root, 0, self._labels, self._map.find, self.first
        for b in word:
            e = find(_BYTES[b], base + first[s], base + first[s + 1]) - base
            if e < 0:
                return None
            number += self.skip[e]
            s = self.target[e]
        if not word or not self.final[s]:
            return None
        return self.ids[self.begin[number]:self.begin[number + 1]].tolist()


class _Memo:
    """Ids of the words a worker has met: from the lexicon, else by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        found = [None if w in self.vocabulary.special else self.lexicon[w.encode()] for w in words]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.vocabulary.merged_all([words[k] for k in rest]), strict=True):
            found[k] = ids
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate([self.ids, *(np.asarray(ids, np.int32) for ids in found)])

    def encode(self, texts_: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as words, and where each text's ids begin (one more entry than texts)."""
        if len(self.number) >= MEMO_WORDS:
            self._forget()
        words = list(chain.from_iterable(texts_))
        fresh = set(words).difference(self.number)
        if fresh:
            self._learn(list(fresh))
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, size = self.begin[which], self.begin[which + 1] - self.begin[which]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return ids, ends[np.concatenate(([0], np.cumsum([len(t) for t in texts_], dtype=np.int64)))]


_memos: dict[str, _Memo] = {}


def _memo(name: str, vocabulary: Vocabulary) -> _Memo:
    """One mapping and memo per worker process; tasks of an earlier lexicon leave theirs behind."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = _Memo(vocabulary, Lexicon(SparkFiles.get(name)))
    return _memos[name]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all of (doc_id, text): runs of letters in lower case.

    The lexicon only speeds encoding up, so its words need not be cut exactly as the encoder cuts them.
    """
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    return docs.select(word).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(docs: DataFrame, words: int) -> DataFrame:
    """The most frequent words, at most ``words``: all above a count that a histogram of counts gives."""
    counts = stored(word_counts(docs).where("n > 1").withColumn("level", F.floor(F.log2("n") * 32).cast("int")), "words")
    total, least = 0, None
    levels = counts.groupBy("level").agg(F.count(F.lit(1)).alias("c")).collect()  # at most 32 * 63 rows
    for r in sorted(levels, key=lambda x: -x["level"]):
        total += r["c"]
        if total > words:
            break
        least = r["level"]
    return counts.where(F.lit(False) if least is None else F.col("level") >= least).select("word")


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, at most ``words``, and hand the file to the executors; returns its name."""
    frequent = [r["word"] for r in frequent_words(docs, words).collect()] if words else []
    frequent = [w for w in frequent if w not in vocabulary.special]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)  # Spark copies it from the driver to the executors
    ids = vocabulary.merged_all(frequent)
    compile_lexicon({w.encode(): i.tolist() for w, i in zip(frequent, ids, strict=True)}, path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def _encoder(vocabulary: Broadcast, lexicon: str):
    """(doc_id, text) batches to (doc_id, ids) batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, memo = vocabulary.value.words(), _memo(lexicon, vocabulary.value)
        for batch in batches:
            ids, begins = memo.encode([split(t) for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def _decoder(vocabulary: Broadcast):
    """(doc_id, ids) batches to (doc_id, ids, decoded) batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array(vocabulary.value.tokens, object)
        for batch in batches:
            lists = batch.column("ids")
            flat = tokens[lists.flatten().to_numpy()].tolist()
            ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            out = [" ".join(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(out, pa.string())],
                                             ["doc_id", "ids", "decoded"])

    return run


def _prepared(docs: DataFrame, vocabulary_path: str, lexicon_words: int, id_col: str, text_col: str):
    plain = texts(docs, id_col, text_col)
    vocabulary = Vocabulary(vocabulary_path)
    lexicon = build_lexicon(plain, vocabulary, lexicon_words)
    arrow_batches(docs.sparkSession)
    return plain, docs.sparkSession.sparkContext.broadcast(vocabulary), lexicon, plain.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the token ids of every whole text."""
    plain, vocabulary, lexicon, kind = _prepared(docs, vocabulary_path, lexicon_words, id_col, text_col)
    return plain.mapInArrow(_encoder(vocabulary, lexicon), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with a column ``decoded``: the tokens joined by blanks."""
    arrow_batches(encoded.sparkSession)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary), f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: ``encode`` and ``decode`` of every whole text in one Python worker per task."""
    plain, vocabulary, lexicon, kind = _prepared(docs, vocabulary_path, lexicon_words, id_col, text_col)
    to_ids, to_text = _encoder(vocabulary, lexicon), _decoder(vocabulary)
    return plain.mapInArrow(lambda batches: to_text(to_ids(batches)), f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    both = round_trip(docs, vocabulary_path, lexicon_words, id_col, text_col)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
