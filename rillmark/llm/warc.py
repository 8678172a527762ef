"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  A reading task owns a range of bytes: it looks for gzip
magic, takes a place for a member only if it inflates to a whole WARC header, and reads every
record that starts inside its range, to the record's end even beyond the range.  After a record
it goes on behind it, so nothing inside a member is taken for another one.

Pages with equal payloads of at least ``REVISIT_BYTES`` share one response record, that of the
largest identifier; the others become revisit records without the payload, which name it.

Archives and the list of them lie in the shared folder.  Only files named by finished tasks are in
the list, so a task that ran twice leaves no double records.

Defined cases: null html counts as empty; a null url gives a record without target; rows that
repeat a group's largest identifier are all responses; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.shared import lean, materialize, new_path, partitions

REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"


def _record_id(page_id: int | None) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    value = record_id.strip("<>").removeprefix(_URN)
    return None if value == "null" else int(value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39)).replace('%25', '%')}")
        lines.append(f"X-Target: {quote(url, safe='')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record; returns the list of archives (path, bytes)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    digest = F.concat(F.sha1("payload"), F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy(digest.alias("same")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = rows.withColumn("digest", F.sha1("payload")).join(groups, digest == F.col("same"), "left").drop("same")
    to_write = marked.withColumn("revisit", F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pyarrow.fs.FileSystem.from_uri(folder)
        out, path = None, f"{at}/part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit"))
            for row in zip(*columns, strict=True):
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(record_bytes(*row))
        if out is not None:
            total = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([total], pa.int64())], names=["path", "bytes"])

    return materialize(to_write.mapInArrow(lean(write), "path string, bytes long"), "warc-list")


class _Window:
    """Bytes of an open file from a moving start, read block by block."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data = source, start, b""
        source.seek(start)

    def grow(self) -> bool:
        more = self.source.read(_BLOCK)
        self.data += more
        return bool(more)

    def forward(self, place: int) -> None:
        self.data = self.data[place - self.start :]
        self.start = place


def _header(text: bytes) -> dict[str, str] | None:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    fields = dict(x.split(":", 1) for x in lines[1:] if ":" in x)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return fields if {"warc-type", "warc-record-id", "content-length"} <= set(fields) and fields["content-length"].isdigit() else None


def _member(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose member starts at the window's start: header, block, end; None if there is none."""
    inflate, text, fed, head = zlib.decompressobj(31), bytearray(), 0, None
    while not inflate.eof:
        if fed == len(window.data) and not window.grow():
            return None
        part = window.data[fed : fed + _BLOCK]
        fed += len(part)
        searched = max(0, len(text) - 3)
        try:
            text += inflate.decompress(part)
        except zlib.error:
            return None
        if head is None:
            if not b"WARC/1.".startswith(bytes(text[:7])):
                return None
            if (end := text.find(b"\r\n\r\n", searched)) >= 0:
                head = _header(bytes(text[:end]))
                if head is None:
                    return None
    if head is None:
        return None
    begin = end + 4
    stop = begin + int(head["content-length"])
    if len(text) < stop:
        return None
    return head, bytes(text[begin:stop]), window.start + fed - len(inflate.unused_data)


def read_range(source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every record whose member starts in [start, end)."""
    window = _Window(source, start)
    while window.start < end:
        place = window.data.find(_MAGIC)
        if place < 0:
            window.forward(max(window.start, window.start + len(window.data) - 2))
            if not window.grow():
                return
            continue
        window.forward(window.start + place)
        if window.start >= end:
            return
        record = _member(window)
        if record is None:
            window.forward(window.start + 1)
        else:
            yield record[:2]
            window.forward(record[2])


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of (path, bytes) archives: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (of the full payload), payload (null for revisits)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.filter("bytes > 0").select("path", starts.alias("start")).withColumn("end", F.col("start") + range_bytes)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["warc-type"] == "revisit"
        lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
        url = unquote(head["x-target"]) if "x-target" in head else head.get("warc-target-uri")
        refers = _page_id(head["warc-refers-to"]) if revisit else None
        return _page_id(head["warc-record-id"]), url, head["warc-type"], refers, lengths[0] if revisit else len(payload), digest, None if revisit else payload

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    held: list[tuple] = []
                    for head, block in read_range(source, start, end):
                        held.append(row(head, block))
                        if len(held) == 200:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return ranges.repartition(partitions(spark)).mapInArrow(lean(read), schema)
