"""WARC archives: written with deduplicated payloads, read back record by record.

Writing: every row becomes one WARC/1.1 record in its own gzip member, holding an HTTP response with
the payload. Of rows with equal payloads of at least ``min_bytes``, the one with the largest id is
the ``response``; the others are ``revisit`` records that refer to it and carry the HTTP header only.
Each task writes archives of at most ``max_bytes`` into a folder of its own attempt; the manifest,
which Spark commits, names the finished ones, so a task that runs twice leaves no double records.

Reading: the archive is streamed in small pieces through an incremental zlib decompressor, a fresh
one for each gzip member. Headers end at the first empty line, ``Content-Length`` frames the block,
and the block and payload digests are computed on the way and compared.

Defined results: a null payload is written as empty; a null id is written without a number and read
back as null, and never becomes the response of a group that has an id; rows repeated with the
largest id of their group are all responses; a null url leaves out the target URI; control
characters and blanks in a url are percent-encoded; an empty table writes no record and reads none;
only the three named columns are read, so other columns may have any name. A record that is cut off
or fails a digest is returned with ``error`` set; reading goes on with the next member, unless the
compressed data itself is damaged, which ends the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.session import durable_path

SALTS = 32  # a payload shared by many rows is joined in this many parts
PIECE = 1 << 16  # bytes of an archive read at once
RECORD = re.compile(r"<urn:x-page:(-?\d+)>")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary, error string")


def label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None,
           date: str) -> bytes:
    """The bytes of one uncompressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}",
            "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: {label(digest)}", f"WARC-Block-Digest: {label(hashlib.sha1(block).digest())}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_referrals(df: DataFrame, id_col: str, payload_col: str, url_col: str, min_bytes: int) -> DataFrame:
    """Adds to each row the id its record refers to (null: it is a response)."""
    rows = (df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
            .withColumn("digest", F.sha1("payload"))
            .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")))
    groups = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    return (rows.join(groups, ["digest", "salt"], "left")
            .select("page_id", "url", "payload", F.unhex("digest").alias("digest"), refers.alias("refers_to")))


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
               min_bytes: int = 1000, max_bytes: int = 1 << 30, level: int = 4,
               date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives below ``folder`` (shared by all executors, in a scheme that pyarrow opens)
    and returns the manifest: path, records."""
    spark = df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, size, n, name = None, 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(f"{root}/archives", recursive=True)
                    name = f"archives/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(row["page_id"], row["url"], row["payload"].encode(), row["digest"],
                                              row["refers_to"], date)) + pack.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= max_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}])

    manifest = f"{folder}/manifest"
    (with_referrals(df, id_col, payload_col, url_col, min_bytes).mapInArrow(write, "path string, records long")
     .write.parquet(manifest))
    return spark.read.schema("path string, records long").parquet(manifest)


class Members:
    """The gzip members of a stream, one after the other, read forward only."""

    def __init__(self, stream):
        self.stream, self.left = stream, b""

    def more(self) -> bool:
        """Whether a member follows."""
        self.left = self.left or self.stream.read(PIECE)
        self.unzip, self.out = zlib.decompressobj(31), b""
        return bool(self.left)

    def fill(self) -> bool:
        """Decompresses a little more of this member; False at its end."""
        while not self.unzip.eof:
            piece = self.left or self.unzip.unconsumed_tail or self.stream.read(PIECE)
            self.left = b""
            got = self.unzip.decompress(piece, PIECE)  # with no input left, output may still be pending
            if not piece and not got and not self.unzip.eof:
                raise ValueError("archive ends inside a record")
            self.left = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.out:
            if not self.fill():
                raise ValueError("header does not end")
        got, _, self.out = self.out.partition(mark)
        return got

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.out and not self.fill():
                raise ValueError("block is shorter than its length")
            got, self.out = self.out[:n], self.out[n:]
            n -= len(got)
            yield got

    def skip(self) -> None:
        """To the end of this member, or of the archive if it is damaged beyond that."""
        try:
            while self.fill():
                self.out = b""
        except (zlib.error, ValueError):
            self.left = b""
            while self.stream.read(PIECE):
                pass


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def number(urn: str | None) -> int | None:
    found = RECORD.fullmatch(urn or "")
    return int(found[1]) if found else None


def read_member(m: Members, keep: bool) -> dict:
    """One record; raises on bad framing, sets ``error`` on a digest that differs."""
    row = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload",
                         "error"))
    try:
        warc = headers(m.until(b"\r\n\r\n"))
        row |= {"page_id": number(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"),
                "record_type": warc.get("warc-type"), "refers_to": number(warc.get("warc-refers-to"))}
        length = int(warc["content-length"])
        block, payload, body, head, kept = hashlib.sha1(), hashlib.sha1(), 0, b"", []
        inside = False
        for piece in m.take(length):
            block.update(piece)
            if not inside:
                head += piece
                if b"\r\n\r\n" not in head:
                    continue
                inside = True
                head, _, piece = head.partition(b"\r\n\r\n")
            payload.update(piece)
            body += len(piece)
            if keep:
                kept.append(piece)
        if b"".join(m.take(4)) != b"\r\n\r\n" or m.out or m.fill():
            raise ValueError("record does not end where its length says")
        stated = int(headers(head)["content-length"])
        if label(block.digest()) != warc["warc-block-digest"]:
            raise ValueError("block digest differs")
        if row["record_type"] == "response" and (stated != body or label(payload.digest()) != warc["warc-payload-digest"]):
            raise ValueError("payload digest differs")
        row |= {"payload_bytes": stated, "payload": b"".join(kept) if keep and row["record_type"] == "response" else None,
                "payload_digest": base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()}
    except (zlib.error, ValueError, KeyError) as e:
        row["error"] = f"{type(e).__name__}: {e}"
        m.skip()
    return row


def read_archive(stream, keep: bool = True) -> Iterator[dict]:
    """The records of one archive."""
    m = Members(stream)
    while m.more():
        yield read_member(m, keep)


def read_warc(paths: DataFrame, payloads: bool = True, batch: int = 500) -> DataFrame:
    """The records of the archives in column ``path``; without ``payloads`` that column is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows = []
                    for row in read_archive(stream, payloads):
                        rows.append(row)
                        if len(rows) == batch:
                            yield frame(rows)
                            rows = []
                    if rows:
                        yield frame(rows)

    return paths.select("path").repartition(max(1, paths.count())).mapInPandas(read, FIELDS)


def frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = pd.array([r[c] for r in rows], dtype="Int64")
    return out


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(pages, durable_path(spark, "warc"))
    records = read_warc(manifest, payloads=False)
    broken = F.raise_error(F.concat(F.lit("unreadable record: "), F.col("error")))
    return records.select(
        "page_id", F.when(F.col("error").isNotNull(), broken.cast("long")).otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN q.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN q.page_id < g.last THEN g.last END AS refers_to
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest
"""
