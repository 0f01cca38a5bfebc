"""WARC archives: writing with revisit records, and a sequential reader.

Archives are WARC/1.1 with one gzip member for each record. The reader inflates a file piece by piece, frames records by
Content-Length, checks that every record ends with its member, and verifies payload digests. A payload that another page
has already is not stored again: a revisit record names the response and keeps the HTTP header with the full length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, out_batch, partitions, prepare, salted, saved, scratch

#: An archive is closed after so many bytes; a task writes as many as it needs.
ARCHIVE_BYTES = 256 << 20
#: Repeated payloads whose digests a broadcast may hold; beyond, the join is salted.
BROADCAST_DIGESTS = 500_000
#: Bytes that the reader takes from a file at once.
READ_BYTES = 1 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One record as a gzip member."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    target = "".join(c if c > " " else "%20" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n") + press.flush()


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def members(file: BinaryIO) -> Iterator[bytes]:
    """Each gzip member, inflated as the file is read; what is held is one member and READ_BYTES of the file."""
    inflate, parts, fresh = zlib.decompressobj(31), [], True
    while chunk := file.read(READ_BYTES):
        while chunk:
            fresh = False
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, fresh = zlib.decompressobj(31), [], True
            else:
                chunk = b""
    if not fresh:
        raise ValueError("the archive ends within a record")


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC fields and block of each record, in file order; digests are verified."""
    for raw in members(file):
        head, found, rest = raw.partition(b"\r\n\r\n")
        version, fields = headers(head)
        if not found or not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        n = int(fields["content-length"])
        block, end = rest[:n], rest[n:]
        if len(block) != n or end != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        if (said := fields.get("warc-block-digest", "").removeprefix("sha1:")) and said != base32(hashlib.sha1(block).digest()):
            raise ValueError("a block digest is wrong")
        yield fields, block


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) below the scratch folder; returns the list of archives.

    Null html is empty, a null url too. Of equal payloads of min_bytes or more the one with the smallest page_id is the
    response (all rows that repeat that id), the others revisit it; a null page_id is never the smallest unless all are
    null. Digests are grouped with partial aggregation, so a payload may fill any share of the rows.
    """
    spark = pages.sparkSession
    prepare(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(html, "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only payloads that occur more than once are joined back; a broadcast leaves the payloads where they are.
    shared = own.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    shared = saved(shared, "shared")
    joined = own.join(F.broadcast(shared), "digest", "left") if shared.count() <= BROADCAST_DIGESTS else salted(own, shared, "digest", "left")
    typed = joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    top = scratch(spark, "warc")
    where, base = pafs.FileSystem.from_uri(top)
    where.create_dir(base, recursive=True)
    listed = "path string, records long, bytes long"
    out = arrow_schema(listed)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(top)
        file, name, n, size = None, "", 0, 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if file is None:
                    # A name of its own for each attempt: the list holds those of the attempt that counts.
                    name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    file, n, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                raw = record(page_id, url, payload, refers_to, "response" if refers_to is None else "revisit")
                file.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    file.close()
                    file = None
                    yield out_batch(out, [[f"{top}/{name}"], [n], [size]])
        if file is not None:
            file.close()
            yield out_batch(out, [[f"{top}/{name}"], [n], [size]])

    return saved(typed.select("page_id", "url", "payload", "refers_to").mapInArrow(write, listed), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest (bare), record_type, refers_to and, if
    asked for, the payload (null for revisits). A damaged record fails the job."""
    ddl = RECORD + ", payload binary" * with_payload
    out = arrow_schema(ddl)

    def row(fields: dict[str, str], block: bytes) -> tuple:
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = fields["warc-type"]
        if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError("a payload digest is wrong")
        size = int(headers(http)[1]["content-length"])
        if kind == "response" and size != len(payload):
            raise ValueError("a payload's length is wrong")
        found = (page_of(fields["warc-record-id"]), fields.get("warc-target-uri", ""), size, digest, kind, page_of(fields.get("warc-refers-to")))
        return found + ((payload if kind == "response" else None,) if with_payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as file:
                    rows, held = [], 0
                    for fields, block in records(file):
                        rows.append(row(fields, block))
                        held += len(block)
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield out_batch(out, list(zip(*rows)))
                            rows, held = [], 0
                    if rows:
                        yield out_batch(out, list(zip(*rows)))

    return archives.repartition(partitions(archives.sparkSession)).mapInArrow(run, ddl)


def checked_revisits(records_read: DataFrame) -> DataFrame:
    """The same records, written once; fails if a revisit names no response, or one with another payload digest."""
    kept = saved(records_read, "records")
    revisits = kept.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    responses = kept.where("record_type = 'response'").select("page_id", "payload_digest").distinct()
    wrong = revisits.join(responses, ["page_id", "payload_digest"], "left_anti").first()
    if wrong is not None:
        raise ValueError(f"a revisit of page {wrong['page_id']} has another payload digest")
    return kept
