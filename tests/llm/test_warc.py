"""WARC round trip, damage, and deduplicated payloads."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from verdictflow.llm import warc
from verdictflow.session import durable_path


def member(i, payload, refers=None, url="http://x/y z\r\nEvil: 1"):
    return gzip.compress(warc.record(i, url, payload, hashlib.sha1(payload).digest(), refers, "2024-01-01T00:00:00Z"))


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reads_what_it_writes(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    payloads = [b"", b"a\r\n\r\nb", bytes(range(256)) * 20, b"x" * 100_000 if piece > 1 else b"x" * 900]
    got = list(warc.read_archive(io.BytesIO(b"".join(member(i, p) for i, p in enumerate(payloads)))))
    assert [r["payload"] for r in got] == payloads and [r["error"] for r in got] == [None] * 4
    assert [r["payload_digest"] for r in got] == [hashlib.sha1(p).hexdigest() for p in payloads]
    assert got[0]["url"] == "http://x/y%20z%0D%0AEvil:%201"


def test_revisit_keeps_size_and_digest():
    (r,) = warc.read_archive(io.BytesIO(member(3, b"hello", 9)))
    assert (r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) == (3, "revisit", 9, 5, None)


def test_damage_is_reported_and_reading_goes_on():
    raw = warc.record(1, None, b"payload", hashlib.sha1(b"other").digest(), None, "2024-01-01T00:00:00Z")
    short = raw.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    got = list(warc.read_archive(io.BytesIO(gzip.compress(raw) + gzip.compress(short) + member(2, b"fine") + member(3, b"cut")[:-9])))
    assert "payload digest" in got[0]["error"] and got[1]["error"] and got[2]["payload"] == b"fine" and got[3]["error"]
    broken = bytearray(member(4, b"z" * 500))
    broken[30] ^= 255
    assert all(r["error"] for r in warc.read_archive(io.BytesIO(bytes(broken))))
    assert zlib.decompress(gzip.compress(b"q"), 31) == b"q"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, salt int, payload string")


def test_awkward_rows(spark):
    big, low = "é" * 600, "s" * 999
    data = [(1, "u", big), (2, None, big), (2, None, big), (None, "n", big), (3, "u", low), (4, "u", low), (5, "u", None),
            (6, "u", ""), (7, "a b", "<p>")]
    df = pages(spark, [(*r, "d", 1, "p") for r in data])
    got = warc.read_warc(warc.write_warc(df, durable_path(spark, "warc"), max_bytes=300)).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr)
    assert kinds == sorted([(1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200),
                            (None, "revisit", 2, 1200), (3, "response", None, 999), (4, "response", None, 999),
                            (5, "response", None, 0), (6, "response", None, 0), (7, "response", None, 3)], key=repr)
    assert all(r.error is None for r in got)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}[2] == big
    empty = warc.read_warc(warc.write_warc(df.limit(0), durable_path(spark, "warc")))
    assert empty.count() == 0


def test_against_sql(spark, sf, by_sql):
    import duckdb
    got = warc.op2_warc(spark, sf)
    pages = duckdb.sql(f"SELECT * FROM '{sf}/pages.parquet'").df()
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(warc.OP2_SQL, got.columns, pages=pages)


def test_copies_of_different_archives(spark):
    df = pages(spark, [(i, "u", "w" * 2000, "d", 1, "p") for i in range(50)])
    got = warc.read_warc(warc.write_warc(df, durable_path(spark, "warc"))).collect()
    assert sum(r.record_type == "response" for r in got) == 1 and {r.refers_to for r in got} == {None, 49}
    assert {base64.b16encode(hashlib.sha1(b"w" * 2000).digest()).decode().lower()} == {r.payload_digest for r in got}
