"""WARC archives: write, index first, read by coalesced byte ranges.

Every record is a gzip member of its own, so any record can be read alone.
Of records with equal payloads one is a response and the others revisit it.
Writing returns the index: one row per record with file, offset, length, URL
and digest.  The index is stored as a table before anything is read.  Reading
starts from selected index rows: their byte ranges are sorted per file, ranges
that lie close together become one read, and each read is parsed in the task
that fetched it.

Archives lie in the shared folder.  A file's name is unique to the attempt
that wrote it, and the index, committed by Spark, names only the files of
attempts that succeeded; a lost executor's files are read by nobody.

Edge cases: a null html is an empty payload; a null url leaves the target
header out; line breaks in a url are escaped; of rows that repeat a page_id with equal payloads all
are responses or all are revisits; a null page_id never wins as response over
another id; an empty table writes no record and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_batches, shared_path, stored

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes between two wanted records that are read along rather than skipped, and the most that one read takes.
GAP = 64 << 10
READ_BYTES = 4 << 20
#: Bytes of records that one read task is dealt.
TASK_BYTES = 8 << 20
#: Pages carry no fetch time.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
_RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
           "payload binary")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI of any scheme that pyarrow knows, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    part = name.removeprefix("<urn:page:").removesuffix(">")
    return None if part == "none" else int(part)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: " + v.replace("\r", "%0D").replace("\n", "%0A") for k, v in headers]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, refers_to: int | None, revisit: bool, digest: str, size: int,
                payload: bytes) -> bytes:
    headers = [("WARC-Record-ID", _name(page_id))] + ([("WARC-Target-URI", url)] if url is not None else [])
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), and for responses the payload, of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[:int(out["content-length"])]
    out["payload"] = block.partition(b"\r\n\r\n")[2] if out["warc-type"] == "response" else None
    return out


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, revisit, refers_to: which record each page becomes.

    Digests are grouped without the pages' text; text moves once, by page, so
    a payload that a third of the pages share is no hot key for it.
    """
    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                         F.coalesce(pages["html"], F.lit("")).alias("html"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    narrow = plain.select("page_id", key.alias("key"), F.sha1("html").alias("sha"), F.octet_length("html").alias("size"))
    last = narrow.groupBy("sha").agg(F.max("page_id").alias("answer"))
    known = narrow.distinct().join(last, "sha").select(
        "key", "sha", "answer", (~F.col("page_id").eqNullSafe(F.col("answer")) & (F.col("size") >= least_bytes)).alias("revisit"))
    return plain.withColumn("key", key).withColumn("sha", F.sha1("html")).join(known, ["key", "sha"]).select(
        "page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("answer")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write one record per page below ``folder``; returns the stored index."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    else:
                        system.create_dir(place, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{place}/{name}", compression=None)
                    first = gzip.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), (
                        "Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), LEVEL, mtime=0)
                    out.write(first)
                    at = len(first)
                payload = page["html"].encode()
                digest = base32_sha1(payload)
                member = gzip.compress(page_record(page["page_id"], page["url"], page["refers_to"], page["revisit"], digest,
                                                   len(payload), payload), LEVEL, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), page["page_id"], page["url"], digest,
                             "revisit" if page["revisit"] else "response"))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _index_types, strict=True)], _index_names)
        if out is not None:
            out.close()

    arrow_batches(spark)
    index = decided(pages, least_bytes).mapInArrow(run, _INDEX)
    return stored(index.select(F.concat(F.lit(folder + "/"), "file").alias("file"), *_index_names[1:]), "warc-index")


_index_names = [c.split()[0] for c in _INDEX.split(", ")]
_index_types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
_record_names = [c.split()[0] for c in _RECORD.split(", ")]
_record_types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def byte_ranges(selected: DataFrame, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """(file, start, end, offsets) reads that cover the ``selected`` index rows.

    Records are sorted by place within windows of ``most`` bytes of a file;
    neighbours at most ``gap`` bytes apart share a read.
    """
    window = Window.partitionBy("file", "part").orderBy("offset")
    cut = selected.select("file", "offset", "length", F.floor(F.col("offset") / most).alias("part"))
    cut = cut.withColumn("new", F.when(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(window) <= gap, 0)
                         .otherwise(1))
    cut = cut.withColumn("read", F.sum("new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("file", "part", "read").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("offsets")).select("file", "start", "end", "offsets")


def read_records(selected: DataFrame, with_payload: bool = True, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """The records of ``selected`` index rows; a response whose payload does not match its digest is an error.

    page_id, url, record_type, refers_to, payload_digest, payload_bytes (both
    of the full payload, also for revisits), payload (null for revisits, and
    without ``with_payload``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for read in batch.to_pylist():
                system, place = filesystem(read["file"])
                with system.open_input_file(place) as f:
                    f.seek(read["start"])
                    data = f.read(read["end"] - read["start"])
                rows = []
                for one in read["offsets"]:
                    at = one["offset"] - read["start"]
                    r = parse(gzip.decompress(data[at:at + one["length"]]))
                    digest, size, payload = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"]), r["payload"]
                    if payload is not None and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{read['file']} at {one['offset']}: payload does not match its digest")
                    rows.append((_page(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"],
                                 _page(r["warc-refers-to"]) if "warc-refers-to" in r else None, digest, size,
                                 payload if with_payload else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _record_types, strict=True)], _record_names)

    # reads are dealt by the bytes to fetch: the index itself is small however much it points at
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // TASK_BYTES), 100_000))
    return byte_ranges(selected, gap, most).repartition(tasks, "file", "start").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page, then read all records back through the index; without the payloads."""
    return read_records(write_archives(pages, least_bytes=least_bytes), with_payload=False).drop("payload")


#: The same in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (('0x' || substr(sha, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY sha) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER (PARTITION BY sha) THEN max(page_id) OVER (PARTITION BY sha) END AS refers_to
FROM p
"""
