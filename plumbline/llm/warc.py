"""WARC archives: one gzip member per record, written and read in Spark tasks.

Every page becomes a record: ``response`` with the HTTP header and the payload, or, for a
repeat of another payload, ``revisit`` with the HTTP header alone. The reader walks the
members one after another, decompresses as it goes, frames records by Content-Length and
verifies the digests of block and payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_END = b"\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. Digests are ``sha1:`` with hexadecimal digits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + _END + block + _END) + pack.flush()


def members(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    held = b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(held))
            if unpack.eof:
                held = unpack.unused_data
                break
            held = stream.read(chunk)
            if not held:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header, block) of one record, framed by its Content-Length."""
    head, found, rest = member.partition(_END)
    first, *lines = head.decode().split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(header["content-length"])
    if rest[n:] != _END:
        raise ValueError("the block does not have its stated length")
    return header, rest[:n]


def verified(header: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """(payload length, payload SHA-1, payload or None) after checking the digests."""
    if "sha1:" + hashlib.sha1(block).hexdigest() != header["warc-block-digest"]:
        raise ValueError("the block does not match its digest")
    http, _, payload = block.partition(_END)
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    n, digest = int(fields["content-length"]), header["warc-payload-digest"].removeprefix("sha1:")
    if header["warc-type"] == "revisit":
        return n, digest, None
    if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload does not match its length or digest")
    return n, digest, payload


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html; others are ignored);
    returns the manifest (file, records).

    A null html is an empty payload. Among equal payloads of at least ``least`` bytes the
    one with the largest page_id is the response and the others revisit it; rows that
    share that page_id are all responses, and rows without a page_id are always
    responses. Digests are compared in a minimal table, so hot payloads are pre-aggregated
    and the pages move once. An empty table writes nothing.
    """
    spark = pages.sparkSession
    common.small_batches(spark, 500)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = page.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    digests = common.checkpoint(digests)
    originals = digests.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    repeats = digests.join(originals, "digest").filter("page_id <> original").select("page_id", "digest", "original").distinct()
    # a page_id may stand on rows with different payloads: the digest tells them apart
    own = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    marked = page.withColumn("digest", own).join(repeats, ["page_id", "digest"], "left").select("page_id", "url", "html", "original")
    fs, base = common.filesystem(path)
    fs.create_dir(base, recursive=True)

    def write(batches):
        fs, base = common.filesystem(path)
        name, out, n = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                out = out or fs.open_output_stream(name, compression=None)
                out.write(record_bytes(row[0], row[1], row[2].encode(), row[3]))
                n += 1
        if out:
            out.close()
            yield pa.record_batch([[name], [n]], ["file", "records"])

    return common.stored(marked.mapInArrow(write, "file string, records long"), "manifest")


def read_archives(manifest: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    url and payload if asked for. Wrong frames or digests raise."""

    def read(batches):
        fs, _ = common.filesystem(path)
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(file, compression=None) as stream:
                    for member in members(stream):
                        header, block = parse(member)
                        n, digest, payload = verified(header, block)
                        rows.append((_number(header["warc-record-id"]), n, digest, header["warc-type"], _number(header.get("warc-refers-to")), header["warc-target-uri"], payload))
                        if len(rows) == 500:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("url", pa.string()), ("payload", pa.binary())] * with_payload

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    files = manifest.select("file").repartition(2 * common.parts_for(manifest.sparkSession), "file")
    return files.mapInArrow(read, schema)
