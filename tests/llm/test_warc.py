from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import tracemalloc
from collections import defaultdict

import pytest

from menuspark.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"") for r in rows], "page_id long, url string, html string, digest string, row int, payload binary")


ROWS = [(5, "http://a", "<p>x</p>"), (2, "http://b\r\n: c", "<p>x</p>"), (9, None, None), (7, "u", ""), (1, "u", "é" * 70_000), (3, "u", "WARC/1.1\r\n\r\n\r\n\r\n"), (None, "u", "<p>x</p>"), (2, "u", "<p>x</p>")]


def test_round_trip(spark):
    read = warc.round_trip(pages(spark, ROWS))
    found = read.collect()
    assert len(found) == len(ROWS)
    assert warc.unmatched_revisits(read).isEmpty()
    ids = defaultdict(list)
    for i, _, h in ROWS:
        ids[h or ""].append(i)
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in found) == sorted(want)
    for h, own in ids.items():
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        rows = [r for r in found if r.payload_digest == digest]
        responses = [r for r in rows if r.record_type == "response"]
        first = min(i for i in own if i is not None)
        assert [r.page_id for r in responses] == [first]
        assert bytes(responses[0].payload) == h.encode() and responses[0].refers_to is None
        assert all(r.refers_to == responses[0].page_id and r.payload is None for r in rows if r.record_type == "revisit")


def test_small_payloads_are_all_responses(spark):
    found = warc.round_trip(pages(spark, ROWS), revisit_least=9).collect()
    assert all(r.record_type == "response" and r.refers_to is None for r in found)


def test_files_are_gzip_members_that_any_reader_opens(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, ROWS), str(tmp_path / "a"), archive_bytes=10).collect()
    assert sum(r.records for r in manifest) == len(ROWS) and len({r.path for r in manifest}) == len(manifest) > 2
    for r in manifest:
        packed = open(r.path.removeprefix("file:"), "rb").read()
        raw = gzip.decompress(packed)
        assert raw.count(b"WARC/1.1\r\nWARC-Type") == r.records + 1 == sum(1 for _ in warc.read(io.BytesIO(packed)))
    ids = [x.headers["warc-record-id"] for r in manifest for x in warc.read(open(r.path.removeprefix("file:"), "rb"))]
    assert len(set(ids)) == len(ids)
    assert warc.read_files(spark, str(tmp_path)).count() == len(ROWS)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, ROWS), str(tmp_path))
    (tmp_path / "pages-000000-lost-000000.warc.gz").write_bytes(b"half a fi")
    assert warc.read_archives(manifest).count() == len(ROWS)


def test_unmatched_revisits_are_found(spark, tmp_path):
    urn = warc.record_urn(1)
    (tmp_path / "x.warc.gz").write_bytes(warc.page_record(1, "u", b"one") + warc.page_record(2, "u", b"one", 0, urn) + warc.page_record(3, "u", b"two", 0, urn) + warc.page_record(4, "u", b"two", 0, warc.record_urn(9)))
    assert sorted(r.page_id for r in warc.unmatched_revisits(warc.read_files(spark, str(tmp_path))).collect()) == [3, 4]


def test_a_long_archive_is_read_in_bounded_memory(tmp_path):
    payload = os.urandom(1 << 16)
    with open(tmp_path / "long.warc.gz", "wb") as out:
        for i in range(1600):
            out.write(warc.page_record(i, "u", payload))
    assert os.path.getsize(tmp_path / "long.warc.gz") > 100 << 20
    tracemalloc.start()
    with open(tmp_path / "long.warc.gz", "rb") as stream:
        assert sum(len(r.payload) for r in warc.read(stream)) == 1600 << 16
    assert tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()


def test_reader_is_incremental_and_strict():
    data = b"".join(warc.page_record(i, "u", b"payload %d" % i) for i in range(5))
    assert [r.payload for r in warc.read(io.BytesIO(data), read_bytes=7)] == [b"payload %d" % i for i in range(5)]
    with pytest.raises(warc.WarcError, match="ends inside"):
        list(warc.read(io.BytesIO(data[:-3])))
    with pytest.raises(warc.WarcError):
        list(warc.read(io.BytesIO(data + b"junk")))
    bad = warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:AAAA")], b"x")
    with pytest.raises(warc.WarcError, match="block digest"):
        list(warc.read(io.BytesIO(bad)))
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(warc.WarcError, match="Content-Length"):
        list(warc.read(io.BytesIO(short)))
