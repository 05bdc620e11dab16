"""WARC archives: a writer with revisit records, and a reader that salvages damage.

Records are gzip members of their own, written through Spark's text sink, so any
file system Spark knows will do and a retried task leaves no half file. A row of the
sink holds consecutive members of a few MB, so the rows of a file bound its bytes. The
sink ends every row with a separator byte; each row is therefore written without its
last byte, which is made to be that separator: the high byte of the last member's
length, zero below 16 MiB, or of an empty member put behind a larger one.

The reader trusts nothing: a member must decompress and match its checksum, a
record must have a version line, a length that fits, and its digests. Records of a
damaged member count by their own digests. After a failed check it looks for the next place a member or a version line begins that
passes, and reports the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_path, stored

# Fixed values of the formats.
VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
LINE = b"\r\n"
RECORD_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2020-01-01T00:00:00Z"
LEVEL = 6
#: Members of a row end with the one that reaches this many bytes; a file has this many rows.
ROW_BYTES = 1 << 22
ROWS_PER_FILE = 16
_STEP = 1 << 16
_NAME = "urn:page:"


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass(frozen=True)
class Record:
    """A record that passed every check; ``start`` to ``end`` are bytes of the file."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and payload of an HTTP message block."""
        head, _, payload = self.block.partition(RECORD_END)
        return _fields(head.split(LINE)[1:]), payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _named(page_id: int | None) -> str:
    return f"<{_NAME}{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    value = (name or "").strip("<>").removeprefix(_NAME)
    return int(value) if value.lstrip("-").isdigit() else None


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: a response, or a revisit of the page ``refers_to`` with HTTP headers alone."""
    http = LINE.join(
        [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    )
    block = http + RECORD_END + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_named(page_id)}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return LINE.join([VERSION, *[h.encode() for h in head]]) + RECORD_END + block + RECORD_END


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _payload() -> list:
    """Columns of a page: page_id, url, html, and the payload's digest and size."""
    html = F.coalesce("html", F.lit(""))
    return [
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.unhex(F.sha1(html.cast("binary"))).alias("digest"),
        F.octet_length(html).alias("size"),
    ]


def repeated_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of every page whose payload a smaller page_id has too.

    Payloads below ``least_bytes`` refer to none. Only digests move, and only those
    of repeated payloads are joined, from files on both sides, so adaptive
    execution can split a common one.
    """
    rows = pages.select(*_payload()).where(F.col("size") >= least_bytes)
    digests = stored(rows.select("page_id", "digest").distinct(), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1 and refers_to is not null").select("digest", "refers_to"), "first")
    return digests.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, row_bytes: int = ROW_BYTES) -> None:
    """Write a record per page (page_id, url, html) to archives under ``path``.

    Null html is an empty payload. Of equal payloads of at least ``least_bytes``
    the smallest page_id is a response, the others are revisits of it; rows that
    repeat that page_id are responses too. A null page_id is written as none and is
    never referred to. A file stays below ROWS_PER_FILE times ``row_bytes`` and the
    largest packed record together: 64 MB and sixteen records at most.
    """
    again = stored(repeated_pages(pages, least_bytes), "again").withColumnsRenamed({"page_id": "__id", "digest": "__digest"})
    rows = pages.select(*_payload())
    same = rows["page_id"].eqNullSafe(again["__id"]) & (rows["digest"] == again["__digest"]) & (rows["size"] >= least_bytes)
    rows = rows.join(again, same, "left").select("page_id", "url", "html", "refers_to")

    def packed(held: list[bytes]) -> pa.RecordBatch:
        if held[-1][-1]:
            held.append(member(b""))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256).to_pydict()
                for page_id, url, html, refers_to in zip(part["page_id"], part["url"], part["html"], part["refers_to"]):
                    held.append(member(record_bytes(page_id, url, (html or "").encode(), refers_to)))
                    size += len(held[-1])
                    if size >= row_bytes:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    members = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def _unpack(content: memoryview, at: int) -> tuple[bytes, int, bool]:
    """Data of the gzip member at a position, where it ends, and whether it is whole.
    Of a damaged member, the data before the damage and where that shows."""
    unpacker, out, fed = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and fed < len(content):
            out.append(unpacker.decompress(content[fed : fed + _STEP]))
            fed += _STEP
    except zlib.error:
        # The failed call gave nothing back: again, and its bytes one by one.
        unpacker = zlib.decompressobj(31)
        for k in range(at, fed, _STEP):
            unpacker.decompress(content[k : k + _STEP])
        try:
            while True:
                out.append(unpacker.decompress(content[fed : fed + 1]))
                fed += 1
        except zlib.error:
            return b"".join(out), fed, False
    return b"".join(out), min(fed, len(content)) - len(unpacker.unused_data), unpacker.eof


def _records(data: bytes, whole: bool) -> Iterator[tuple[int, int, tuple[dict[str, str], bytes] | None]]:
    """(start, end, headers and block) of the records in a member's data, with None
    for what lies between. Of a damaged member only records with a digest count, and
    not one that ends where the data does."""
    at, lost = 0, None
    while at < len(data):
        record = _record(data, at)
        if record is not None and not whole:
            marks = {"warc-block-digest"} | ({"warc-payload-digest"} if record[0].get("warc-type") == "response" else set())
            if record[2] == len(data) or not marks & record[0].keys():
                record = None
        if record is None:
            lost = at if lost is None else lost
            at = data.find(VERSION[:7], at + 1)
            if at < 0:
                break
            continue
        if lost is not None:
            yield lost, at, None
            lost = None
        yield at, record[2], record[:2]
        at = record[2]
    if lost is not None:
        yield lost, len(data), None


def _record(data, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record at a position, or None if any check fails."""
    if bytes(data[at : at + 7]) != VERSION[:7]:
        return None
    stop = data.find(RECORD_END, at)
    if stop < 0:
        return None
    headers = _fields(bytes(data[at:stop]).split(LINE)[1:])
    length = headers.get("content-length", "")
    if not length.isdigit():
        return None
    start = stop + len(RECORD_END)
    end = start + int(length)
    if bytes(data[end : end + len(RECORD_END)]) != RECORD_END:
        return None
    block = bytes(data[start:end])
    wanted = headers.get("warc-block-digest")
    if wanted is not None and wanted != f"sha1:{digest(block)}":
        return None
    wanted = headers.get("warc-payload-digest")
    if headers.get("warc-type") == "response" and wanted is not None:
        if wanted != f"sha1:{digest(block.partition(RECORD_END)[2])}":
            return None
    return headers, block, end + len(RECORD_END)


def salvage(content: bytes) -> Iterator[Record | tuple[int, ...]]:
    """Records of an archive in order, and the byte gaps (start, end) between them
    that held no valid one. Plain and compressed records may be mixed.

    A gap inside a whole member is (start, end, inner start, inner end): the bytes of
    the member, and those of its data. A damaged member gives the records before the
    damage, then a gap from its start to the next valid record.
    """
    at, lost, view = 0, None, memoryview(content)
    saved, until = [], 0  # records of a damaged member, and where its data ended
    while at < len(content):
        found, end = [], at
        if content.startswith(GZIP, at):
            data, stop, whole = _unpack(view, at)
            parts = list(_records(data, whole))
            good = [Record(at, stop, *record) for _, _, record in parts if record is not None]
            if whole and (good or not data):
                end = stop
                found = [(at, stop, a, b) if record is None else Record(at, stop, *record) for a, b, record in parts]
            elif good and at >= until:
                if lost is not None:
                    yield lost, at
                    lost = None
                yield from good
                saved, until = [(r.headers, r.block) for r in good], stop
        elif content.startswith(VERSION[:7], at):
            record = _record(content, at)
            # Data stored uncompressed in a damaged member shows again as plain records.
            if record is not None and not (at < until and record[:2] in saved):
                end = record[2]
                found.append(Record(at, end, record[0], record[1]))
        if end > at:
            if lost is not None:
                yield lost, at
                lost = None
            yield from found
            at = end
            continue
        lost = at if lost is None else lost
        nexts = [p for p in (content.find(GZIP, at + 1), content.find(VERSION[:7], at + 1)) if p >= 0]
        at = min(nexts, default=len(content))
    if lost is not None:
        yield lost, len(content)


RECORDS_SCHEMA = (
    "path string, start bigint, end bigint, quarantined boolean, page_id bigint, url string, payload_bytes bigint, "
    "payload_digest string, record_type string, refers_to bigint"
)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record, and one per quarantined gap (with only path, start, end).

    Size and digest are those of the full payload: computed for a response, as
    declared for a revisit. ``payload`` adds the bytes, null for a revisit. One
    file is read by one task and must stay below two gigabytes; those of ``write_warc``
    do while no record packs to more than 120 MB.
    """
    schema = RECORDS_SCHEMA + (", payload binary" if payload else "")
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        for item in salvage(content):
            if isinstance(item, tuple):
                yield (name, *item[:2], True, *[None] * (len(names) - 4))
                continue
            headers, (http, body) = item.headers, item.http
            kind = headers.get("warc-type")
            full = kind == "response"
            size = len(body) if full else int(http.get("content-length", "0"))
            mark = digest(body) if full else headers.get("warc-payload-digest", "").removeprefix("sha1:")
            values = (name, item.start, item.end, False, _number(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, mark, kind, _number(headers.get("warc-refers-to")))
            yield values + ((body if full else None,) if payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                held: list[tuple] = []
                for row in rows(name.as_py(), content.as_py()):
                    held.append(row)
                    if len(held) == 1000:
                        yield _batch(held, names, kinds)
                        held = []
                if held:
                    yield _batch(held, names, kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return (
        read_warc(spark, path)
        .where("not quarantined")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
