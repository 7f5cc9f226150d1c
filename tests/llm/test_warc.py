import gzip
import hashlib
import io
import zlib

import pytest

from tessera.llm import warc
from tessera.llm.store import local_path

SCHEMA = "page_id long, url string, html string, digest string, n string"


def test_round_trip_with_copies_small_and_empty_payloads(spark):
    big, tail = "ü" * 60, "x" * 99
    rows = [(5, "u5", big), (2, "u2", big), (9, None, big), (1, "a\r\nb", tail), (3, "u3", tail), (4, "u4", None), (6, "u6", ""), (7, "u7", "é" + "z" * 3_000_000), (8, "u8", "é" + "z" * 3_000_000)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, _, t in rows:
        raw = (t or "").encode()
        first = min(j for j, _, u in rows if u == t)
        kind = "revisit" if len(raw) >= 100 and first < i else "response"
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), kind, first if kind == "revisit" else None)


def test_archives_are_members_that_gzip_reads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "y" * (90 + i), "", "") for i in range(20)]
    paths = [r.path for r in warc.archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w").collect()]
    text = b"".join(gzip.open(local_path(p)).read() for p in paths)
    assert text.count(b"WARC/1.1\r\n") == 20 and b"WARC-Target-URI: http://h/7\r\n" in text


def test_repeated_rows_and_no_rows(spark):
    table = spark.createDataFrame([(1, "u", "q" * 200, "", "")] * 3 + [(1, "u", "other" * 50, "", "")], SCHEMA)
    rows = warc.round_trip(table).collect()
    assert sorted(r.record_type for r in rows) == ["response", "response", "revisit", "revisit"]
    assert warc.round_trip(table.limit(0)).collect() == []


def test_chunks_are_read_in_order_with_their_digest(spark):
    payload = bytes(range(256)) * 5000
    sink = io.BytesIO()
    for i, body in enumerate((payload, b"", b"tail")):
        m = warc.Member(sink)
        m.write(warc.header(i, "", "response", hashlib.sha256(body).hexdigest(), len(body), None))
        m.write(body)
        m.write(b"\r\n\r\n")
        m.close()
    sink.seek(0)
    found = []
    for fields, pieces in warc.parts(sink, 100_000):
        own = list(pieces)
        assert all(len(p) <= 100_000 for p in own)
        found.append((fields["WARC-Record-ID"], b"".join(own)))
    assert [b for _, b in found] == [payload, b"", b"tail"]


@pytest.mark.parametrize("cut", [20, 300])
def test_a_broken_archive_is_an_error(cut):
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    body = warc.header(1, "", "response", "00", 5000, None) + bytes(5000) + b"\r\n\r\n"
    whole = z.compress(body) + z.flush()
    with pytest.raises((ValueError, zlib.error)):
        for _, pieces in warc.parts(io.BytesIO(whole[: len(whole) - cut] if cut < len(whole) else whole[:15])):
            list(pieces)


def test_null_page_ids_have_records(spark):
    rows = [(None, "u", "q" * 200), (None, "v", "r" * 200), (4, "w", "q" * 200), (None, None, None)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 200, "revisit", 4), (None, 200, "response", None), (4, 200, "response", None), (None, 0, "response", None)], key=str)


def test_a_payload_of_many_chunks_carries_its_digest(spark):
    text = "".join(chr(65 + i % 50) for i in range(70_001))
    rows = warc.chunks(spark.createDataFrame([(1, "u", "short", "", ""), (2, "u", text, "", ""), (3, "u", None, "", "")], SCHEMA).coalesce(1), 1000).orderBy("rec", "chunk_no").collect()
    big = [r for r in rows if r.page_id == 2]
    assert [r.chunk_no for r in big] == list(range(71)) and [r.last for r in big] == [False] * 70 + [True] and max(len(r.data) for r in big) == 1000
    assert b"".join(r.data for r in big) == text.encode() and big[-1].digest == hashlib.sha256(text.encode()).hexdigest() and big[-1].n == 70_001
    assert all(r.digest is None and r.n is None for r in big[:-1])
    assert [(r.n, r.digest) for r in rows if r.page_id == 3] == [(0, hashlib.sha256(b"").hexdigest())]
