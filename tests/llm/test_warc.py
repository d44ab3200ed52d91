import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from inkstone.llm import warc

PAGES = "page_id long, url string, html string, sha string, key string, file string"


def pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, "<p>ü漢</p>"), (4, "u\r\nv", None), (5, "", ""),
            (6, "http://c", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n"), (7, "http://d", "z" * 300_000), (8, "http://e", "z" * 300_000),
            (None, "http://n", "<p>x</p>"), (None, "http://m", "alone"), (9, "http://f", "same"), (9, "http://f", "same"),
            (10, "é", "\x00 binary \x1f")]
    rows += [(100 + k, f"http://h/{k}", "hot" if k % 2 else f"page {k}") for k in range(60)]
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], PAGES).repartition(4), rows


def test_round_trip_matches_brute_force(spark):
    df, rows = pages(spark)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.round_trip(df).collect()), key=repr)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max([x for x in (last.get(h or ""), i) if x is not None], default=None)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = i != last[h or ""]
        want.append((i, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)


def test_payloads_and_urls_come_back_whole(spark):
    df, rows = pages(spark)
    index = warc.write_archives(df)
    got = {r["page_id"]: r for r in warc.read_records(index).where("record_type = 'response'").collect()}
    for i, url, html in rows:
        if i in got and i is not None:
            assert bytes(got[i]["payload"]) == (html or "").encode()
            assert got[i]["url"] == (url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None)


def test_archives_are_gzip_members_that_the_index_points_at(spark, tmp_path):
    df, rows = pages(spark)
    index = warc.write_archives(df, str(tmp_path / "arc")).collect()
    assert len(index) == len(rows)
    for name in {r["file"] for r in index}:
        data = open(name, "rb").read()
        mine = sorted((r["offset"], r["length"]) for r in index if r["file"] == name)
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == len(mine) + 1
        at = len(data) - sum(n for _, n in mine)  # after the warcinfo record
        for offset, length in mine:
            assert offset == at
            assert gzip.decompress(data[offset:offset + length]).startswith(b"WARC/1.1\r\n")
            at += length
    hot = hashlib.sha1(b"hot").digest()
    assert sum(r["digest"] == __import__("base64").b32encode(hot).decode() for r in index) == 30


def test_only_selected_records_are_read_in_coalesced_ranges(spark):
    df, _ = pages(spark)
    index = warc.write_archives(df)
    some = index.where("page_id % 7 = 0")
    assert {r["page_id"] for r in warc.read_records(some).collect()} == {r["page_id"] for r in some.collect()}
    files = index.select("file").distinct().count()
    assert warc.byte_ranges(index).count() <= files + 2  # neighbours share a read
    assert warc.byte_ranges(index, gap=-1).count() == index.count()
    assert warc.byte_ranges(index).agg(F.sum(F.size("offsets"))).first()[0] == index.count()


def test_short_payloads_need_not_be_revisits(spark):
    df, _ = pages(spark)
    got = warc.round_trip(df, least_bytes=4)
    assert got.where("payload_bytes < 4 AND record_type = 'revisit'").count() == 0
    assert got.where("payload_bytes >= 4 AND record_type = 'revisit'").count() > 0


def test_a_damaged_payload_is_an_error():
    raw = warc.page_record(1, "u", None, False, warc.base32_sha1(b"abc"), 3, b"abd")
    assert warc.parse(raw)["payload"] == b"abd"
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_reads_are_dealt_by_bytes(spark, monkeypatch):
    df, _ = pages(spark)
    index = warc.write_archives(df)
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    got = warc.read_records(index, most=1500)
    assert got.rdd.getNumPartitions() > 2
    assert {r["page_id"] for r in got.collect()} == {r["page_id"] for r in index.collect()}
