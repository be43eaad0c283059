import base64
import gzip
import hashlib
import random
import time

import pytest

from quarry.llm import warc

from .common import clashing

PAGES = [
    (5, "http://a/x", "<p>one é</p>"), (2, "http://a/y", "<p>one é</p>"), (9, None, None), (7, "http://b", ""), (1, "http://c\r\nx: y", "WARC/1.0\r\nfake\r\n\r\n"),
    (11, "http://d", "x" * 70_000), (3, "http://e", "<p>one é</p>"), (4, "u", "a\r\n\r\nb\nWARC/1.0 inside"),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    data = {p: (h or "").encode() for p, _, h in rows}
    out = {}
    for p, raw in data.items():
        first = min(q for q in data if data[q] == raw)
        out[p] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == first else "revisit", None if p == first else first)
    return out


def got(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_round_trip(spark):
    assert got(warc.round_trip(table(spark))) == expected(PAGES)


def test_every_page_comes_back_whatever_its_url(spark):
    rows = [(i, f"http://a/{chr(i)}b", f"p{i}") for i in range(33)] + [(40, "http://a/WARC/1.0/x", "q"), (41, "WARC/1.WARC/1.\x01", "r"), (42, "\t", "s")]
    assert got(warc.round_trip(table(spark, rows))) == expected(rows)


def test_own_archives_with_a_gap_fail(spark, monkeypatch):
    monkeypatch.setattr(warc, "escaped_uri", lambda url: url)
    with pytest.raises(Exception, match="own archive is damaged"):
        warc.round_trip(table(spark, [(1, "http://a/WARC/1.0/x", "q")])).collect()


def test_shuffled_join_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    assert got(warc.round_trip(table(spark))) == expected(PAGES)


def test_payloads_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(table(spark), path)
    rows = warc.read_archives(spark, path).collect()
    assert all(r.gap is None for r in rows)
    back = {int(r.record_id.rsplit(":")[-1]): bytes(r.payload) for r in rows if r.record_type == "response"}
    assert back == {p: (h or "").encode() for p, _, h in PAGES if expected(PAGES)[p][2] == "response"}


def test_empty_table_nulls_repeats_and_clashing_columns(spark):
    assert warc.round_trip(table(spark, [])).collect() == []
    rows = [(None, "u", "same"), (3, "u", "same"), (3, "u", "same"), (None, "u", "alone")]
    out = warc.round_trip(clashing(table(spark, rows), "payload", "refers_to")).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in out) == [(-1, "response", 0), (-1, "revisit", 3), (3, "response", 0), (3, "response", 0)]


def record(i, payload, digest=True):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: application/http\r\n"
    if digest:
        head += f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}\r\n"
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parts(data):
    records, gaps = [], []
    at = 0
    for x in warc.salvage(data):
        (gaps if isinstance(x, warc.Gap) else records).append(x)
        if x.offset >= at:
            assert x.offset == at
            at += x.length
    assert at == len(data)
    return records, gaps


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_of_every_kind_of_damage(packed):
    one = [record(i, f"payload {i} ".encode() * (i + 1)) for i in range(8)]
    units = [gzip.compress(r, mtime=0) for r in one] if packed else list(one)
    broken = list(units)
    broken[1] = broken[1][:-5]
    broken[3] = broken[3][:40] + b"\xff" + broken[3][41:] if packed else broken[3].replace(b"payload 3", b"payl0ad 3", 1)
    broken[5] = b"noise between records" + broken[5]
    broken[6] = broken[6].replace(b"Content-Length: ", b"Content-Length: x") if not packed else b"\x1f\x8b\x08garbage"
    records, gaps = parts(b"".join(broken))
    assert [r.headers["warc-record-id"] for r in records] == [f"<urn:page:{i}>" for i in (0, 2, 4, 5, 7)]
    assert len(gaps) == 4 and all(g.length and g.reason for g in gaps)


def test_salvage_of_random_damage_never_loses_untouched_records():
    r = random.Random(4)
    for _ in range(60):
        units = [(gzip.compress(x, mtime=0) if r.random() < 0.5 else x) for x in (record(i, bytes(r.randrange(256) for _ in range(r.randrange(200)))) for i in range(6))]
        hit = r.randrange(6)
        units[hit] = units[hit][: r.randrange(len(units[hit]))]
        records, _ = parts(b"".join(units))
        found = {x.headers["warc-record-id"] for x in records}
        assert {f"<urn:page:{i}>" for i in range(6) if i not in (hit, hit + 1)} <= found
    assert parts(b"") == ([], []) and parts(b"nothing here")[1][0].length == 12


def test_torn_attempts_are_quarantined_and_nothing_is_lost(spark):
    rows = PAGES + [(100 + i, "u", f"<p>{i} é</p>" * (i % 40 + 1)) for i in range(300)]
    out = warc.round_trip(table(spark, rows), torn_one_in=3)
    assert got(out) == expected(rows)
    assert 50 < out.where("gaps = 1").count() < 200


def test_many_gzip_members_are_read_in_proportion():
    r = random.Random(6)
    units = [gzip.compress(record(i, r.randbytes(2000)), mtime=0) for i in range(10_000)]
    torn = set(range(50, 10_000, 100))
    data = b"".join(x[: len(x) // 2] + x if i in torn else x for i, x in enumerate(units))
    began = time.monotonic()
    records, gaps = parts(data)
    assert time.monotonic() - began < 20
    assert [x.headers["warc-record-id"] for x in records] == [f"<urn:page:{i}>" for i in range(10_000)] and len(gaps) >= len(torn)
