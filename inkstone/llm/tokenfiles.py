"""Token ids in files: one zstandard frame per document, all against one shared dictionary.

Short documents compress badly alone, so a dictionary is trained on serialised
id arrays of a bounded sample of short documents and shared by all files.
Every document is compressed separately against it and can be read alone: a
file's header names the dictionary by its SHA-256, and its footer holds the
documents' ids, places and token counts.  A file is

    magic, SHA-256 of the dictionary, bytes per id           (header)
    a zstandard frame per document, ids little-endian        (body)
    doc_id, has-id flag, offset, token count per document    (footer)
    documents, place and CRC-32 of the footer, magic         (tail)

Documents are put in ascending doc_id order over all files.  Texts are encoded
and compressed where they are read; only frames are shuffled, once, into ranges
of doc_id whose bounds are approximate quantiles of the ids.  An id that fills
several ranges is spread over them by a checksum of its ids, so a repeated id
is no single task.  Tasks write files of names of their own below the shared
folder and report them in the stored index; files of lost tasks are in no index.

Edge cases: a null or empty text has the end id alone; rows that repeat a doc_id
are documents each, in order of (CRC-32, ids); documents without a doc_id come
last; where too few documents are short enough to train on, the dictionary is
empty; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.bytebpe import ByteBpe
from inkstone.llm.common import arrow_batches, shared_path, stored, texts
from inkstone.llm.warc import filesystem

MAGIC = b"INKTOK01"
_HEADER = struct.Struct("<8s32sB")
_TAIL = struct.Struct("<QQI8s")
_ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n", "<u8")])
LEVEL = 3
#: A task opens a new file beyond so many bytes.
FILE_BYTES = 64 << 20
#: The sample that the dictionary is trained on: whole documents of at most so many characters, those of the smallest
#: hashes.  Documents and characters bound what one task holds; the ids in the files do not depend on it.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 4_000
DICTIONARY_BYTES = 64 << 10
#: Accuracy of the quantiles: a range is off by 1 / ACCURACY of the rows at most.
ACCURACY = 10_000
#: Bytes of files that one read task is dealt.
READ_BYTES = 32 << 20


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for arrays like ``samples``; empty where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def shared_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """The dictionary for ``docs`` (doc_id, text), trained in one task on the bounded sample."""
    short = docs.where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    sample = short.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_DOCS).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        arrays = [ids + end for b in batches for ids in coder.encode(b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([train(arrays)], pa.binary())], ["dictionary"])

    rows = sample.coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def _bounds(docs: DataFrame, ranges: int) -> tuple[np.ndarray, int]:
    """Upper bounds of the ranges of doc_id, and the ranges for rows without one."""
    at = [k / ranges for k in range(1, ranges)] or [0.5]
    row = docs.agg(F.percentile_approx("doc_id", at, ACCURACY).alias("b"), F.count(F.lit(1)).alias("n"),
                   F.count("doc_id").alias("with_id")).first()
    bare = row["n"] - row["with_id"]
    return np.array(row["b"] or [], np.int64), max(1, round(ranges * bare / row["n"])) if bare else 0


def place(ids: pa.Array, crc: np.ndarray, bounds: np.ndarray, bare: int) -> np.ndarray:
    """Range of each row: ids between the same bounds share one, an id that is itself several bounds is spread by ``crc``."""
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    none = ids.is_null().to_numpy(zero_copy_only=False)
    low = np.searchsorted(bounds, value, "left")
    wide = np.searchsorted(bounds, value, "right") - low + 1
    low, wide = np.where(none, len(bounds) + 1, low), np.where(none, max(bare, 1), wide)
    return (low + (crc.astype(np.float64) / 2 ** 32 * wide).astype(np.int64)).astype(np.int32)


def frames(docs: DataFrame, tokenizer: str, dictionary: bytes, end_id: int, bounds: np.ndarray, bare: int) -> DataFrame:
    """(part, doc_id, n_tokens, crc, frame): every document encoded and compressed on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        shared = _dictionary(dictionary)
        if shared is not None:
            shared.precompute_compress(level=LEVEL)  # else it is digested anew for every document
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for batch in batches:
            arrays = [a + end for a in coder.encode(batch.column("text").to_pylist())]
            crc = np.array([checksum(a, coder.dtype) for a in arrays], np.int64)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(place(ids, crc, bounds, bare)), ids,
                 pa.array([len(a) // coder.dtype.itemsize for a in arrays], pa.int64()), pa.array(crc),
                 pa.array([press.compress(a) for a in arrays], pa.binary())],
                ["part", "doc_id", "n_tokens", "crc", "frame"])

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, "part int, doc_id long, n_tokens long, crc long, frame binary")


def checksum(ids: bytes, dtype: np.dtype) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())


class _File:
    """One file being written."""

    def __init__(self, folder: str, dictionary: bytes, width: int):
        system, where = filesystem(folder)
        system.create_dir(where, recursive=True)
        self.name = f"{uuid.uuid4().hex}.ids"
        self._out = system.open_output_stream(f"{where}/{self.name}", compression=None)
        self._out.write(_HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))
        self.at, self._entries = _HEADER.size, []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self._entries.append((doc_id or 0, doc_id is not None, self.at, n))
        self._out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        footer = np.array(self._entries, _ENTRY).tobytes()
        self._out.write(footer)
        self._out.write(_TAIL.pack(len(self._entries), self.at, zlib.crc32(footer), MAGIC))
        self._out.close()


_INDEX = "file string, part int, seq int, pos long, doc_id long, offset long, length long, n_tokens long"


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, ranges: int | None = None,
          file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all ``docs`` with ``end_id`` appended, write the files below ``folder`` and return the stored index.

    The index has a row per document: file, part and seq (files in order of
    both hold ascending ids), pos in the file, doc_id, offset, length, n_tokens.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    plain = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    dictionary = shared_dictionary(plain, tokenizer, end_id)
    system, where = filesystem(folder)
    system.create_dir(where, recursive=True)
    with system.open_output_stream(f"{where}/{dictionary_name(dictionary)}", compression=None) as out:
        out.write(dictionary)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, bare = _bounds(plain, ranges)
    width = ByteBpe(tokenizer).dtype.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seq, pos, now = None, 0, 0, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or out.at >= file_bytes or r["part"] != now:
                    if out is not None:
                        out.close()
                        seq += 1
                    out, pos, now = _File(folder, dictionary, width), 0, r["part"]
                rows.append((out.name, now, seq, pos, r["doc_id"], out.at, len(r["frame"]), r["n_tokens"]))
                out.add(r["doc_id"], r["n_tokens"], r["frame"])
                pos += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _index_types, strict=True)], _index_names)
        if out is not None:
            out.close()

    rows = frames(plain, tokenizer, dictionary, end_id, bounds, bare)
    rows = rows.repartitionById(len(bounds) + 1 + bare, "part").sortWithinPartitions("part", "doc_id", "crc", "frame")
    index = rows.select("part", "doc_id", "n_tokens", "frame").mapInArrow(run, _INDEX)
    return stored(index.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file")), "token-index")


_index_names = [c.split()[0] for c in _INDEX.split(", ")]
_index_types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def dictionary_name(dictionary: bytes) -> str:
    return f"{hashlib.sha256(dictionary).hexdigest()}.zdict"


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, path: str, dictionary: bytes | None = None):
        system, where = filesystem(path)
        self._in = system.open_input_file(where)
        size = self._in.size()
        magic, self.sha, width = _HEADER.unpack(self._in.read_at(_HEADER.size, 0))
        n, at, crc, end = _TAIL.unpack(self._in.read_at(_TAIL.size, size - _TAIL.size))
        footer = self._in.read_at(n * _ENTRY.itemsize, at)
        if magic != MAGIC or end != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{path} is no whole token file")
        #: doc_id, has_id, offset and n (tokens) per document.
        self.entries = np.frombuffer(footer, _ENTRY)
        self.dtype = np.dtype(f"<u{width}")
        self._ends = np.append(self.entries["offset"][1:], np.uint64(at))
        if dictionary is None:
            with system.open_input_stream(f"{where.rpartition('/')[0]}/{self.sha.hex()}.zdict", compression=None) as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.sha:
            raise ValueError(f"{path} was written with another dictionary")
        self._press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _ids(self, k: int, frame: bytes) -> bytes:
        ids = self._press.decompress(frame)
        if len(ids) != int(self.entries["n"][k]) * self.dtype.itemsize:
            raise ValueError(f"document {k} has not the tokens that its index entry states")
        return ids

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; reads its frame alone."""
        start, end = int(self.entries["offset"][k]), int(self._ends[k])
        return np.frombuffer(self._ids(k, self._in.read_at(end - start, start)), self.dtype)

    def find(self, doc_id: int) -> list[int]:
        """Places of a doc_id."""
        return np.flatnonzero((self.entries["doc_id"] == doc_id) & (self.entries["has_id"] == 1)).tolist()

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self) -> Iterator[bytes]:
        """Serialised ids of all documents in order, read in passes of about a megabyte."""
        k = 0
        while k < len(self):
            start = int(self.entries["offset"][k])
            upto = max(k + 1, int(np.searchsorted(self._ends, start + (1 << 20), "right")))
            data = self._in.read_at(int(self._ends[upto - 1]) - start, start)
            for j in range(k, upto):
                yield self._ids(j, data[int(self.entries["offset"][j]) - start:int(self._ends[j]) - start])
            k = upto

    def close(self) -> None:
        self._in.close()


def files(index: DataFrame) -> DataFrame:
    """(file, start, n_docs, n_tokens, bytes) per file in order; start: ids in all files before it."""
    each = index.groupBy("part", "seq", "file").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        F.max(F.col("offset") + F.col("length")).alias("bytes"))
    # a row per file of many megabytes, never per document
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("file", (F.sum("n_tokens").over(before) - F.col("n_tokens")).alias("start"), "n_docs",
                       "n_tokens", "bytes")


def read(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids] of every document in the files."""
    spark = index.sparkSession
    listed = stored(files(index).select("file", "start", "bytes"), "token-file-list")
    total = listed.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # dealt by the bytes to fetch, not by the list's own size
    tasks = max(1, min(total[0], -(-(total[1] or 0) // READ_BYTES), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                source = TokenFile(path)
                entries, rows = source.entries, []
                for k, ids in enumerate(source):
                    e = entries[k]
                    rows.append((int(e["doc_id"]) if e["has_id"] else None, at, int(e["n"]), checksum(ids, source.dtype),
                                 np.frombuffer(ids, source.dtype).tolist() if with_ids else None))
                    at += int(e["n"])
                    if len(rows) == (500 if with_ids else 20_000):
                        yield _rows(rows, with_ids)
                        rows = []
                source.close()
                yield _rows(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return listed.select("file", "start").repartition(tasks).mapInArrow(run, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    n = 5 if with_ids else 4
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[k], kinds[k]) for k in range(n)], names[:n])


def documents(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in ``wanted`` (doc_id), reading their frames alone."""
    picked = index.join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != path:
                    if source is not None:
                        source.close()
                    path, source = r["file"], TokenFile(r["file"])
                out.append(source.document(r["pos"]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])
        if source is not None:
            source.close()

    near = picked.select("file", "pos", "doc_id").repartition("file").sortWithinPartitions("file", "pos")
    return near.mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents, then read them back."""
    return read(write(docs, tokenizer, end_id=end_id))
