"""WARC archives: write captures as request, response or revisit, and metadata records; read and assemble them.

A capture is three records. Its response (or revisit) has the id the others name in WARC-Concurrent-To. Of captures
with equal payloads the one with the least id is the response, the others revisit it. Archives are read record by
record and assembled by joins on those identifiers, one nested row a capture.

Every row is a capture of its own, whose record ids are its own: one row of a page_id is named by it, further ones by
page_id and a row number. Rows without page_id are named "none" in its place, and come last where the least id counts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, put_in_place, stored

RECORD = "record_id string, concurrent_to string, type string, uri string, refers_to string, payload_digest string, payload_bytes long, capture_id long, body_bytes long"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str, kind: str) -> str:
    return f"<urn:heliograph:{kind}:{name}>"


def record(kind: str, at: str, uri: str, body: bytes, fields: dict[str, str]) -> bytes:
    """One WARC record as a gzip member of its own, as archives hold them."""
    head = {"WARC-Type": kind, "WARC-Record-ID": at, "WARC-Date": DATE, "WARC-Target-URI": uri, **fields, "Content-Length": str(len(body))}
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(raw.encode() + body + END, compresslevel=1, mtime=0)


def one_line(text: str | None) -> str:
    """A header's value: line breaks can't stand there, so they and per cents are escaped."""
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", text or "")


def capture(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """The records of one capture; name and refers_to tell it and the one it revisits from all others."""
    uri, digest = one_line(url), digest_of(payload)
    response, known = record_id(name, "response"), {"WARC-Payload-Digest": f"sha1:{digest}"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        main = record("response", response, uri, http + payload, {"Content-Type": "application/http; msgtype=response", **known})
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        main = record("revisit", response, uri, http, {"Content-Type": "application/http; msgtype=response", "WARC-Profile": profile, "WARC-Refers-To": record_id(refers_to, "response"), **known})
    asked = record("request", record_id(name, "request"), uri, f"GET {uri} HTTP/1.1\r\n\r\n".encode(), {"Content-Type": "application/http; msgtype=request", "WARC-Concurrent-To": response})
    about = record("metadata", record_id(name, "metadata"), uri, f"capture-id: {'none' if page_id is None else page_id}\r\n".encode(), {"Content-Type": "application/warc-fields", "WARC-Concurrent-To": response})
    return asked + main + about


def decisions(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages as name, page_id, url, payload (binary), refers_to: null for a response, else the name of the one it revisits.

    Payloads under least_bytes are responses all. Equal payloads are told by SHA-1 and length. Rows are numbered and
    stored, so that each is one row in all that follows. Ids and digests alone are grouped and joined, so a payload or
    a page_id of a third of all rows makes many small rows, which Spark splits; payloads move once, by their row.
    """
    id_name = F.coalesce(F.col(page_id).cast("long").cast("string"), F.lit("none"))
    pages = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"), id_name.alias("id_name"), "url", F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    pages = stored(pages.withColumn("bytes", F.octet_length("payload")).withColumn("sha", F.concat_ws(":", F.sha1("payload"), "bytes")), "pages")
    keys = pages.select("row", "page_id", "id_name", "sha", "bytes")
    repeated = keys.groupBy("id_name").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1").select("id_name", "least")
    name = F.when(F.col("row") > F.col("least"), F.concat_ws(".", "id_name", "row")).otherwise(F.col("id_name"))
    named = stored(keys.join(repeated, "id_name", "left").select("row", "page_id", "id_name", "sha", "bytes", name.alias("name")), "names")
    held = named.where(F.col("bytes") >= least_bytes)
    first = held.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "name")).alias("first"))
    revisits = held.join(first, "sha").where("row <> first.row").select("row", F.col("first.name").alias("refers_to"))
    odd = named.where("name <> id_name").select("row", "name").join(revisits, "row", "full")
    return pages.join(stored(odd, "odd"), "row", "left").select(F.coalesce("name", "id_name").alias("name"), "page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, path: str) -> int:
    """Write pages as archives under path, a file a task that has any; how many files.

    A file is named by its task's partition, so a repeated task makes the same file again: it writes to a name of
    its own, and takes the file's when whole unless that is there.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        at, token, out = TaskContext.get().partitionId(), int(np.random.default_rng().integers(1 << 62)), None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "page_id", "url", "payload", "refers_to")), strict=True):
                out = out or fs.open_output_stream(f"{base}/.{at}-{token}", compression=None)
                out.write(capture(*row))
        if out:
            out.close()
            put_in_place(fs, f"{base}/.{at}-{token}", f"{base}/{at:06d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([at] if out else [], pa.int32())], ["file"])

    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    return decisions(pages).mapInArrow(run, "file int").count()


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a compressed or plain archive."""
    head = stream.read(2)
    raw = _Members(head, stream) if head == b"\x1f\x8b" else io.BufferedReader(_Rest(head, stream))
    while line := raw.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := raw.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, raw.read(int(fields.get("content-length", 0)))


class _Rest(io.RawIOBase):
    """A stream with bytes put back at its start."""

    def __init__(self, head: bytes, stream) -> None:
        self.head, self.stream = head, stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.head or self.stream.read(len(into))
        got, self.head = got[: len(into)], got[len(into) :] if self.head else b""
        into[: len(got)] = got
        return len(got)


def _Members(head: bytes, stream) -> io.BufferedReader:  # noqa: N802
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(_Rest(head, stream), 1 << 20)), 1 << 20)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head."""
    return block.partition(b"\r\n\r\n")[2]


def records(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of the archives under path; each file is read once, as a stream.

    Digest and length are those of the payload itself where the record holds it, else what its header says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(name)
                rows: list[tuple] = []
                with fs.open_input_stream(at, compression=None) as file:
                    for fields, block in parse(file):
                        kind, payload = fields["warc-type"], None
                        said = fields.get("warc-payload-digest", "").partition(":")[2] or None
                        if kind == "response":
                            payload = payload_of(block)
                            said = digest_of(payload)
                        about = re.search(rb"capture-id: (-?\d+)", block) if kind == "metadata" else None
                        rows.append((fields["warc-record-id"], fields.get("warc-concurrent-to"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), said, None if payload is None else len(payload), int(about[1]) if about else None, len(block)))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    files = sorted(str(f.getPath().toString()) for f in found if f.getPath().getName().endswith((".warc", ".warc.gz")))
    tasks = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "n int, path string").repartitionById(max(1, len(files)), F.col("n")).select("path")
    return tasks.mapInArrow(run, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One row a capture: structs response, request, metadata, and for revisits the response they refer to.

    A response without request or metadata has null there; requests and metadata without response aren't captures.
    rows is read four times, so give a stored table.
    """
    part = lambda kind: rows.where(F.col("type").isin(*kind))
    main = part(["response", "revisit"]).select("record_id", F.struct("record_id", "type", "uri", "refers_to", "payload_digest", "payload_bytes", "body_bytes").alias("response"))
    request = part(["request"]).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "uri", "body_bytes").alias("request"))
    about = part(["metadata"]).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "capture_id", "body_bytes").alias("metadata"))
    return main.join(request, "record_id", "left").join(about, "record_id", "left")


def resolved(captures: DataFrame, rows: DataFrame) -> DataFrame:
    """captures with the payload's length and digest; revisits take them from the response that they refer to.

    A page that a third of all captures revisit is one row of the other side, and Spark splits its revisits.
    """
    held = rows.where("type = 'response'").select(F.col("record_id").alias("__held"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    return captures.join(held, F.coalesce(F.col("response.refers_to"), F.col("response.record_id")) == F.col("__held"), "left").drop("__held")


def write_and_read(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder; their captures, assembled from the archives alone."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    rows = stored(records(spark, path), "records")
    return resolved(stored(assemble(rows), "captures"), rows)
