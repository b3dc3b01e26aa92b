import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("size", [0, 1, 999, 1000, 1001, 5000])
def test_chunks_round_trip(size):
    payload = bytes(i % 251 for i in range(size))
    assert warc.dechunked(warc.chunked(payload)) == payload


def test_wrong_chunks_are_found():
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * (i * 40)) for i in range(12)]
    rows += [(100 + i, None, rows[4][2]) for i in range(5)] + [(200, "u\r\nX: y", None), (201, "u", ""), (None, "u", "q"), (7, "again", rows[7][2])]
    df = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("sha1", F.lit(2))
    got = warc.report(df).collect()
    assert len(got) == len(rows) and all(r.fault is None for r in got)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = best[h or ""] == (-1 if i is None else i)
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else best[h or ""]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(expected, key=key)


def test_reassembly_reports_faults():
    import zlib

    out = warc.records(1, "u", b"x" * 5000, 1, True)
    parts = [{"segment": int(h.get("warc-segment-number", 0)), "block": zlib.compress(b)} for r in out for h, b in warc.parsed(r)]
    total = sum(len(b) for r in out for _, b in warc.parsed(r))
    assert len(parts) > 2
    assert warc.reassembled(parts, total, "response", warc.digest(b"x" * 5000)) == (5000, warc.digest(b"x" * 5000), None)
    assert warc.reassembled(parts[:-1], None, "response", None)[2]
    assert warc.reassembled(parts[:1] + parts[2:], total, "response", None)[2]
    assert warc.reassembled(parts, total + 1, "response", None)[2]
    assert warc.reassembled(parts[1:], total, None, None)[2]
    assert warc.reassembled(parts, total, "response", "WRONG")[2]


def test_empty(spark):
    assert warc.report(spark.createDataFrame([], PAGES)).count() == 0


def test_broken_and_foreign_archives_are_told(spark, tmp_path):
    import gzip

    one, two, three = (b"".join(warc.records(i, f"u{i}", f"page {i} ".encode() * 300, i, True)) for i in (1, 2, 3))
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:x>")], b"software: none")
    (tmp_path / "a.warc").write_bytes(info + one + two.replace(b"Content-Length: 2048", b"Content-Length: 2047", 1) + three)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.records(i, "v", b"x" * i, i, True)[0]) for i in (10, 11)))
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(warc.records(20, "w", b"whole", 20, True)[0])[:-12])
    (tmp_path / "d.warc").write_bytes(b"no archive at all")
    (tmp_path / "e.warc").write_bytes(b"")
    (tmp_path / "f.html").write_bytes(b"<p>")
    got = warc.read(spark, f"file://{tmp_path}").collect()
    sound = {r.page_id: r.payload_bytes for r in got if r.fault is None}
    assert sound == {1: 2100, 3: 2100, 10: 10, 11: 11} or sound == {1: 2100, 3: 2100, 10: 10, 11: 11, 20: 5}
    faults = sorted(r.fault for r in got if r.fault is not None)
    assert any(f.startswith("a.warc: the record at byte") for f in faults) and any("the record that began it is missing" in f for f in faults)
    assert any(f.startswith("c.txt.gz: compressed data") for f in faults) and any(f.startswith("d.warc: no record at byte 0") for f in faults)
    assert len(got) == len(sound) + len(faults)
