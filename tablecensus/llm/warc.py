"""WARC archives written and read by Spark tasks: segments, revisits, chunked transfer.

An archive is a folder of gzip files, each a run of WARC 1.1 records. Records end
in two empty lines, so Spark's text writer with that line separator makes such
files on any storage, with its own commit of finished tasks. They are read as
whole files, whose size the writer bounds.
"""

import base64
import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecensus.llm.frames import stored, utf8

# Fixed values of the format.
VERSION = b"WARC/1.1"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)

RECORDS_SCHEMA = (
    "page_id string, record_type string, target_uri string, refers_to string, payload binary, "
    "payload_digest string, payload_length bigint, complete boolean"
)
# Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1_000


def chunked(payload: bytes, size: int) -> bytes:
    """The chunked transfer coding of ``payload``."""
    pieces = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in pieces) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; null if its framing is broken."""
    pieces, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(pieces)
        piece = body[end + 2 : end + 2 + size]
        if size < 0 or len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        pieces.append(piece)
        at = end + 4 + size


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two empty lines at its end."""
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in fields], b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def page_records(
    page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment_bytes: int, chunk_bytes: int
) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    name = f"urn:page:{page_id}"
    own = uuid.uuid4().hex[:12]  # tells records of repeated pages apart
    about = [
        ("WARC-Date", date),
        *([("WARC-Target-URI", _one_line(url))] if url is not None else []),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}#{own}>"), *about]
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield _record(fields, HTTP_HEADER)
        return
    block = HTTP_HEADER + chunked(payload, chunk_bytes)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, piece in enumerate(pieces, 1):
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}#{own}>"), *about]
        if number > 1:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<{name}#{own}.{number}>"),
                ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", f"<{name}#{own}>"),
            ]
        if len(pieces) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
            if number == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, piece)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of all pages.

    Of pages with equal payloads of at least ``least`` bytes, the one with the
    largest id keeps it and ``refers_to`` of the others names that one. Payloads are
    compared by SHA-1 and length. The groups of two pages and more are found on
    narrow rows and stored; pages meet them in a plain join, which Spark can
    split where a payload has very many copies.
    """
    rows = pages.select(F.col("page_id"), "url", utf8("html").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    size = F.octet_length("payload")
    groups = (
        rows.where((size >= least) & F.col("page_id").isNotNull())
        .groupBy("digest", size.alias("size"))
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", F.col("size").alias("group_size"), "first")
    )
    groups = stored(groups, "equal-payloads")
    joined = rows.join(groups, ["digest"], "left").where(
        F.col("group_size").isNull() | (F.col("group_size") == size)
    )
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame,
    path: str,
    date: str = "2024-01-01T00:00:00Z",
    least: int = REVISIT_BYTES,
    segment_bytes: int = 32 << 10,
    chunk_bytes: int = 8 << 10,
    records_per_file: int = 20_000,
) -> None:
    """Write a response or revisit record per row of ``page_id, url, html`` to ``path``.

    Payloads are the UTF-8 bytes of ``html`` (null: empty) in chunked transfer
    coding; blocks of more than ``segment_bytes`` go on in continuation records.
    A null ``page_id`` is written as such and is always a response; a null ``url`` leaves
    the target out. Repeated rows are written as often as they come. Other
    columns are not looked at; no pages give no records.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            held = 0
            for row in batch.to_pylist():
                page_id = "null" if row["page_id"] is None else str(row["page_id"])
                refers_to = None if row["refers_to"] is None else str(row["refers_to"])
                for record in page_records(
                    page_id, row["url"], row["payload"], row["digest"], refers_to, date, segment_bytes, chunk_bytes
                ):
                    made.append(record)
                    held += len(record)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])
                    made, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    written = with_revisits(pages, least).mapInArrow(records, "record binary")
    (
        written.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, one at a time; gzip or plain."""
    plain = io.BytesIO(content)
    source = gzip.GzipFile(fileobj=plain) if content[:2] == b"\x1f\x8b" else plain
    stream = io.BufferedReader(source, 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise EOFError("a record ends before its content length")
        yield headers, block


def _page_of(uri: str | None) -> str | None:
    """The page id in a record id of this module."""
    if uri is None:
        return None
    name = uri.strip("<>").removeprefix("urn:page:").split("#")[0]
    return None if name == "null" else name


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response; null if its framing is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _row(headers: dict[str, str], block: bytes | None) -> tuple:
    """A row of ``RECORDS_SCHEMA``; ``block`` is null where its segments do not add up."""
    kind = headers["warc-type"]
    payload = payload_of(block) if kind == "response" and block is not None else None
    length = headers.get("warc-payload-length")
    return (
        _page_of(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), _page_of(headers.get("warc-refers-to")),
        payload, _hex(headers.get("warc-payload-digest")), int(length) if length else None,
        kind != "response" or payload is not None,
    )


def _table(rows: list[tuple], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, types)], names=[name for name, _ in types]
    )


_RECORD_TYPES = [
    ("page_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("complete", pa.bool_()),
]
_SEGMENT_TYPES = [
    ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()),
]


def reassembled(segments: list[dict]) -> tuple:
    """One row from all segments of a record, in any order.

    The block counts only if the numbers run from 1 without gap and its length is
    the total that the last segment states.
    """
    segments = sorted(segments, key=lambda s: s["number"])
    headers = dict(segments[0]["headers"])
    block = b"".join(s["block"] for s in segments)
    whole = [s["number"] for s in segments] == list(range(1, len(segments) + 1))
    if headers.get("warc-type") != "response":
        headers = {"warc-type": "response", "warc-record-id": segments[0]["origin"]}
    return _row(headers, block if whole and segments[-1]["total"] == len(block) else None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All response and revisit records below ``path`` with their payloads, whole again.

    Records of one part are decoded where they are read. Segments, which may lie
    in any file, are grouped by the identifier of the record they began with,
    put in order of their numbers and checked against the stated total length;
    then the chunked coding is taken off. ``complete`` is false, and the payload null, where
    segments are missing or the framing is broken. A revisit has no payload, but the digest
    and length of the one it refers to. An empty folder has no records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_records(content.as_py()):
                    if headers["warc-type"] in ("response", "revisit") and "warc-segment-number" not in headers:
                        rows.append(_row(headers, block))
                        held += len(block)
                        if held > 8 << 20:
                            yield _table(rows, _RECORD_TYPES)
                            rows, held = [], 0
                yield _table(rows, _RECORD_TYPES)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_records(content.as_py()):
                    if number := headers.get("warc-segment-number"):
                        total = headers.get("warc-segment-total-length")
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        rows.append((origin, int(number), int(total) if total else None, list(headers.items()), block))
                        if len(rows) >= 256:
                            yield _table(rows, _SEGMENT_TYPES)
                            rows = []
                yield _table(rows, _SEGMENT_TYPES)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                groups = batch.column(0).slice(low, 64).to_pylist()
                yield _table([reassembled(segments) for segments in groups], _RECORD_TYPES)

    segment = "origin string, number bigint, total bigint, headers map<string, string>, block binary"
    one = F.struct("origin", "number", "total", "headers", "block")
    whole = (
        files.mapInArrow(parts, segment)
        .groupBy("origin")
        .agg(F.collect_list(one).alias("segments"))  # of one record
        .select("segments")
        .mapInArrow(joined, RECORDS_SCHEMA)
    )
    return files.mapInArrow(single, RECORDS_SCHEMA).unionByName(whole)
