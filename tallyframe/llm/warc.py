"""WARC archives, written with an index and read back by it.

Each task writes its records as gzip members into files of its own in the shared folder
and returns the index: file, offset, length, URL and digest of each record. Only index
rows of tasks that succeeded are kept, so a file that a lost task left behind is never
read. Readers sort the index by place, join neighbouring byte ranges into few requests and
take the records out of what these return.

Files are opened by their URI with `pyarrow.fs`, so the folder may be in any store that it knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.common import settle, table
from tallyframe.shared import fresh_path

#: Payloads under this many bytes are never stored as revisits.
LEAST_REVISIT = 100
#: Bytes after which a task begins its next file; gap that a request may span; bytes of one request.
FILE_BYTES, GAP, REQUEST_BYTES = 1 << 28, 1 << 16, 1 << 22
#: Revisits of about 100 bytes that are broadcast to the writers at most; more are joined by a shuffle.
BROADCAST_COPIES = 200_000
DATE = "1970-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, url string, digest string"
READ = "page_id string, record_type string, refers_to string, url string, payload binary, payload_bytes long, payload_digest string"


def open_store(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    uri = uri if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", uri) else f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def header_value(value: str | None) -> str:
    """A value without line breaks or other controls: those are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value or "")


def plain_value(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member with one WARC/1.1 record. A revisit holds the headers of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", header_value(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", header_value(page_id)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers_to)}>"),
            ("X-Refers-To-Page-ID", header_value(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.fields["WARC-Type"]

    def http(self) -> tuple[int, bytes]:
        """The payload's length as the response says, and the bytes after its headers."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return int(re.search(rb"(?im)^content-length: *(\d+)", head)[1]), body


def parse(member: bytes) -> Record:
    """The record in one gzip member; its block must have the length and the digest it names."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError("damaged record " + fields["WARC-Record-ID"])
    return Record(fields, block)


def with_originals(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and, for revisits, the page they refer to.

    The smallest id of each digest is found by an aggregate that combines before the shuffle.
    Digests that stand alone need no join; only those with copies are joined back, by digest
    and id, so that no payload is shuffled by a digest that many pages share, and none at all
    where there are few.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    facts = pages.select("page_id", F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest")).where(f"size >= {least}")
    firsts = facts.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    copies = (
        facts.join(firsts.drop("n"), "digest").where("not (page_id <=> original)")
        .groupBy("page_id", "digest").agg(F.min("original").alias("original"))
    )
    copies = settle(copies.withColumnsRenamed({"page_id": "copy_id", "digest": "copy_digest"}), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest"))
    few = copies.count() <= BROADCAST_COPIES
    return rows.join(F.broadcast(copies) if few else copies, same, "left").select("page_id", "url", "payload", "digest", "original")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records of `with_originals` and return the index, from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, path, offset = None, "", 0
        for batch in batches:
            entries: list[tuple] = []
            for page_id, url, payload, digest, original in zip(*batch.columns):
                if out is None:
                    path, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                member = record(page_id.as_py() or "", url.as_py(), payload.as_py(), digest.as_py(), original.as_py())
                out.write(member)
                entries.append((path, offset, len(member), url.as_py(), digest.as_py()))
                offset += len(member)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
            if entries:
                columns = list(zip(*entries))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "offset", "length", "url", "digest"])
        if out is not None:
            out.close()

    text = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("original").cast("string"))
    return settle(text.mapInArrow(run, INDEX), "warc-index")


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted byte ranges joined into requests: start, length and the numbers of the records in them."""
    start = end = 0
    members: list[int] = []
    for k, (offset, length) in enumerate(zip(offsets, lengths)):
        if members and (offset - end > GAP or offset + length - start > REQUEST_BYTES):
            yield start, end - start, members
            members = []
        if not members:
            start = offset
        end = offset + length
        members.append(k)
    if members:
        yield start, end - start, members


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects: any rows of the index of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        opened, name = None, None
        for batch in batches:
            paths, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            first = 0
            while first < len(paths):
                last = first
                while last < len(paths) and paths[last] == paths[first]:
                    last += 1
                if name != paths[first]:
                    opened, name = store.open_input_file(f"{root}/{paths[first]}"), paths[first]
                for start, length, members in ranges(offsets[first:last], lengths[first:last]):
                    data = opened.read_at(length, start)
                    yield as_rows([data[offsets[first + k] - start :][: lengths[first + k]] for k in members])
                first = last

    def as_rows(found: list[bytes]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(7)]
        for member in found:
            one = parse(member)
            size, body = one.http()
            revisit = one.kind == "revisit"
            digest = one.fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if not revisit and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError("damaged payload " + one.fields["WARC-Record-ID"])
            refers = plain_value(one.fields["X-Refers-To-Page-ID"]) if revisit else None
            values = (plain_value(one.fields["X-Page-ID"]), one.kind, refers, plain_value(one.fields["WARC-Target-URI"]), None if revisit else body, size, digest)
            for column, value in zip(columns, values):
                column.append(value)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in READ.split(", ")])

    placed = index.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> tuple[DataFrame, str]:
    """Write one record for each row of ``pages`` (page_id, url, html); the index and the folder.

    A null html is an empty payload, a null url an empty one. Of equal payloads of at least
    ``least`` bytes the smallest id is the response. Rows that repeat a page's id and payload
    are written as often as they come, as revisits only if another page is the original.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return write_archives(with_originals(pages, least), folder), folder


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    index, folder = archive_pages(pages)
    found = read_archives(index, folder)
    return found.select(
        F.nullif("page_id", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
