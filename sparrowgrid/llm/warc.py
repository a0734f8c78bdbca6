"""WARC archives as a chunked record table.

The archive is a table of byte chunks: record, chunk number, bytes and the
SHA-1 of the payload up to and with that chunk.  A record's chunks in order are
its WARC bytes, so no step holds a whole record: the writer slices a payload in
place, the reader takes one chunk at a time and keeps a running digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import bounded, written

CHUNK = 64 << 10
CHUNKS = "record long, chunk int, bytes binary, running_sha1 string"
_ARROW = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("bytes", pa.binary()), ("running_sha1", pa.string())])
END = b"\r\n\r\n"


def _name(record) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(record))}>"


def _header(kind: str, record: int, page, url, first, digest: str, size: int) -> bytes:
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _name(record)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", size),
        ("X-Page-ID", "" if page is None else page),
    ]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("X-Refers-To-Page", first))
    fields.append(("Content-Type", "text/html; charset=utf-8"))
    fields.append(("Content-Length", size if kind == "response" else 0))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunks(record: int, page, url, first, sha1: str, size: int, payload: memoryview, chunk: int):
    """The rows of one record: its header, its payload in slices, its end."""
    kind = "response" if first is None or first == page else "revisit"
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    running, k = hashlib.sha1(), 0
    yield record, k, _header(kind, record, page, url, first, digest, size), running.hexdigest()
    for start in range(0, len(payload) if kind == "response" else 0, chunk):
        piece, k = payload[start : start + chunk], k + 1
        running.update(piece)
        yield record, k, bytes(piece), running.hexdigest()
    yield record, k + 1, END, running.hexdigest()


def write(df: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write one record per row as a chunk table in the shared folder and return it.

    Of rows with equal payloads of at least ``least`` bytes, those with the
    smallest page id are responses and the others revisit it; a null payload is
    empty, a null page id comes after all others.  Repeated rows each get a
    record of their own.  Other columns are not archived.
    """
    bytes_ = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(
        F.col(page).cast("long").alias("page"),
        F.col(url).cast("string").alias("url"),
        bytes_.alias("payload"),
        F.sha1(bytes_.cast("binary")).alias("sha1"),
        F.octet_length(bytes_).cast("long").alias("size"),
    )
    firsts = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.min("page").alias("first"))
    marked = rows.join(firsts, ["sha1", "size"], "left").withColumn("record", F.monotonically_increasing_id())

    names = ("record", "page", "url", "first", "sha1", "size", "payload")

    def run(batches):
        for part in bounded(batches, "payload"):
            out, held = [], 0
            for *plain, value in zip(*(part.column(part.schema.get_field_index(c)) for c in names), strict=True):
                for row in _chunks(*(x.as_py() for x in plain), memoryview(value.as_buffer()), chunk):
                    out.append(row)
                    held += len(row[2])
                    if held > 4 << 20:
                        yield _batch(out, _ARROW)
                        out, held = [], 0
            if out:
                yield _batch(out, _ARROW)

    return written(marked.mapInArrow(run, CHUNKS), "warc")


class _Reader:
    """The record that is being read: chunks go in, a row comes out at the end."""

    def __init__(self):
        self.head, self.fields, self.left, self.sha1, self.tail = b"", None, 0, hashlib.sha1(), b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if END not in self.head:
                return
            head, data = self.head.split(END, 1)
            version, *lines = head.decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            self.fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
            self.left = int(self.fields["Content-Length"])
        self.sha1.update(data[: self.left])
        self.tail += data[self.left :]
        self.left = max(0, self.left - len(data))

    def row(self) -> tuple:
        f = self.fields
        if f is None or self.left or self.tail != END:
            raise ValueError("a WARC record is cut short")
        kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and base64.b32encode(self.sha1.digest()).decode() != digest:
            raise ValueError(f"a payload differs from its digest: {f['WARC-Record-ID']}")
        number = lambda x: int(x) if x else None
        return number(f["X-Page-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, kind, number(f.get("X-Refers-To-Page"))


ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table; a damaged record is an error."""

    def run(batches):
        now, reader, out = None, None, []
        for batch in batches:
            for record, data in zip(batch.column(0), batch.column(1), strict=True):
                record = record.as_py()
                if record != now:
                    if reader:
                        out.append(reader.row())
                    now, reader = record, _Reader()
                reader.feed(data.as_py())
            if len(out) > 10_000:
                yield _batch(out, _ROWS)
                out = []
        if reader:
            out.append(reader.row())
        if out:
            yield _batch(out, _ROWS)

    ordered = chunks.repartition("record").sortWithinPartitions("record", "chunk")
    return ordered.select("record", "bytes").mapInArrow(run, ROWS)
