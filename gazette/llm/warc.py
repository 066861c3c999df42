"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task looks for gzip magic from the
start of its range, takes a place for a record only if what decodes there begins a WARC header, and owns the records that
begin inside its range, reading past the end to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import checkpointed, file_system, slices

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, path string, position long"
#: Reading tasks for each core, at most; with fewer ranges a task reads one.
TASKS_PER_CORE = 16
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (html in UTF-8, null: empty), and the record each becomes.

    Of payloads that are equal and have at least ``least`` bytes, the one with the largest page_id is the response and
    the others revisit it (``refers_to``); smaller ones are responses. Equal means same SHA-1 and same length. Rows that
    repeat the largest id are responses too; a null id revisits any other. Only digests and ids are grouped; Spark may
    split a digest that many pages share, because the side it meets has one row for each digest.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("largest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")))
    return rows.join(first.hint("shuffle_hash"), ["sha1", "size"], "left").select("page_id", "url", "payload", F.when(again, F.col("largest")).alias("refers_to"))


def name_of(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP headers and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name_of(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 3) -> DataFrame:
    """Archives of all pages below ``folder`` (any store of Spark's tasks), a file for each task; returns their path and size.

    The list is checkpointed, so pages are written once; a task that runs again writes a new file, and only files of the
    list count. Empty input writes nothing. Needs page_id, url and html; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for whole in batches:
            for batch in slices(whole, "payload"):
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
                for row in zip(*columns):
                    if out is None:
                        store, inside = file_system(path)
                        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(inside, compression=None)
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(record(*row)) + pack.flush()
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])

    return checkpointed(revisits(pages, least).mapInArrow(run, "path string, size long"))


class Source:
    """Bytes of a file from any place on, read ahead in pieces."""

    def __init__(self, file, size: int, start: int, piece: int):
        self.file, self.size, self.piece, self.start, self.data = file, size, piece, start, bytearray()

    def more(self) -> bool:
        at = self.start + len(self.data)
        got = self.file.read_at(min(self.piece, self.size - at), at) if at < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, position: int) -> None:
        del self.data[: position - self.start]
        self.start = position

    def find(self, position: int, end: int) -> int:
        """First place of gzip magic from ``position`` on and before ``end``; -1 if none."""
        while True:
            at = self.data.find(MAGIC, position - self.start)
            if at >= 0:
                return self.start + at if self.start + at < end else -1
            seen = self.start + len(self.data)
            if seen >= end + len(MAGIC):
                return -1
            self.drop(max(position, seen - len(MAGIC) + 1))
            position = max(position, self.start)
            if not self.more():
                return -1

    def member(self, position: int) -> tuple[bytes, int] | None:
        """The decoded member at a place and its end, or None if no WARC record begins there."""
        unpack, parts, used, checked = zlib.decompressobj(31), [], 0, False
        try:
            while not unpack.eof:
                at = position - self.start + used
                if at >= len(self.data) and not self.more():
                    return None
                chunk = self.data[at : at + self.piece]
                parts.append(unpack.decompress(chunk))
                used += len(chunk) - len(unpack.unused_data)
                if not checked and sum(map(len, parts)) >= 6:
                    checked = b"".join(parts)[:6] == b"WARC/1"
                    if not checked:
                        return None
        except zlib.error:
            return None
        return (b"".join(parts), position + used) if checked else None


def parsed(data: bytes) -> dict | None:
    """Columns of one decoded record; None if its lengths don't agree, as in what only looks like a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    length = int(fields["content-length"])
    if len(rest) != length + 4:
        return None
    block = rest[:length]
    http, _, body = block.partition(b"\r\n\r\n")
    number = lambda text: int(text[10:-1]) if text and text[10:-1] != "none" else None
    whole = fields["warc-type"] == "response"
    declared = re.search(rb"(?i)content-length:\s*(\d+)", http)
    return {
        "page_id": number(fields.get("warc-record-id", "")),
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to", "")),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": len(body) if whole else int(declared[1]) if declared else 0,
        "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload": body if whole else None,
    }


def read(spark: SparkSession, files: DataFrame, split: int = 32 << 20, payload: bool = True, piece: int = 1 << 20) -> DataFrame:
    """The records of archives (rows path, size), by tasks over byte ranges of ``split`` bytes.

    Size and digest of a response are those of its payload; a revisit has them from its headers, as its payload is in
    the record it refers to. ``payload=False`` leaves the bodies out. No files: no rows. Bytes between ranges' records
    that are no record are passed over. A compressed archive that is itself stored without compression inside a record
    of another writer, and lies across the start of a range, could be taken for records; this writer compresses.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("position", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["start"] + split, row["size"])
                store, inside = file_system(row["path"])
                rows, held = [], 0
                with store.open_input_file(inside) as file:
                    source = Source(file, row["size"], row["start"], piece)
                    at = source.find(row["start"], end)
                    while at >= 0:
                        member = source.member(at)
                        found = parsed(member[0]) if member else None
                        if found:
                            held += found["payload_bytes"]
                            rows.append(found | {"path": row["path"], "position": at} | ({} if payload else {"payload": None}))
                            at = member[1]
                            source.drop(at)
                        else:
                            at += 1
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                        at = source.find(at, end) if at < end else -1
                yield pa.RecordBatch.from_pylist(rows, schema)

    # a number of its own: a range is a row of some bytes, and by their size all ranges would be dealt to one task
    tasks = max(1, min(ranges.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return ranges.repartition(tasks, F.col("path"), F.col("start")).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str, split: int = 32 << 20) -> DataFrame:
    """Pages written as archives and read back: a row per page with what its record says."""
    found = read(pages.sparkSession, write(pages, folder), split, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
