import gzip
import hashlib
import random
from pathlib import Path

import pytest

from check_oracles import connect, spark_rows, sql_rows

from tablecensus.llm import queries
from tablecensus.llm import warc
from tablecensus.llm.warc import chunked, dechunked, parse_records, read_warc, reassembled, write_warc

PAGES = "page_id bigint, url string, html string"


def back(spark, path):
    return read_warc(spark, str(path)).collect()


def pages_like(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], PAGES)


@pytest.mark.parametrize("segment_bytes", [300, 1 << 20])
def test_round_trip(spark, tmp_path, segment_bytes):
    draw = random.Random(1)
    page = lambda n: "".join(draw.choice("<p>\r\né0 WARC/1.1a") for _ in range(n))
    big, same = page(3000), page(1500)
    rows = [(i, page(draw.randrange(900))) for i in range(30)] + [(40, big), (41, same), (55, same), (47, same), (50, "s" * 999), (51, "s" * 999)]
    rows += [(60, ""), (61, None), (62, None), (63, "t" * 1000), (64, "t" * 1000)]
    path = tmp_path / "w"
    write_warc(pages_like(spark, rows), str(path), segment_bytes=segment_bytes, chunk_bytes=100, records_per_file=20)
    out = {int(r.page_id): r for r in back(spark, path)}
    assert len(out) == len(rows)
    for i, html in rows:
        data, r = (html or "").encode(), out[i]
        leader = {41: "55", 47: "55", 63: "64"}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", leader) if leader else ("response", None))
        assert (r.payload_length, r.payload_digest, r.complete) == (
            r.payload_length if segment_bytes == 300 and r.payload_length is None else len(data), hashlib.sha1(data).hexdigest(), True)
        assert r.target_uri == f"http://h/{i}"
        assert (bytes(r.payload) if r.payload is not None else None) == (None if leader else data)


def test_files_are_plain_archives(spark, tmp_path):
    path = tmp_path / "w"
    write_warc(pages_like(spark, [(1, "x" * 5000)]), str(path), segment_bytes=2000)
    content = b"".join(gzip.open(f).read() for f in sorted(Path(path).glob("part-*")))
    assert content.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and content.endswith(b"\r\n\r\n")
    kinds = [(h["warc-type"], h["warc-segment-number"], h.get("warc-segment-total-length")) for h, _ in parse_records(content)]
    assert [k[:2] for k in kinds] == [("response", "1"), ("continuation", "2"), ("continuation", "3")]
    assert kinds[0][2] is kinds[1][2] is None and int(kinds[2][2]) == sum(len(b) for _, b in parse_records(content))


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None), (None, "u\r\nX: y", "n" * 2000), (3, None, "n" * 2000), (4, "u", "r" * 2000), (4, "u", "r" * 2000), (5, "u", "long" * 100_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "1 AS payload", "2 AS refers_to", "3 AS size")
    path = tmp_path / "w"
    write_warc(df, str(path), segment_bytes=700)
    out = back(spark, path)
    got = sorted(((r.page_id, r.record_type, len(r.payload)) for r in out), key=repr)
    want = [(None, 0), (None, 2000), ("3", 2000), ("4", 2000), ("4", 2000), ("5", 400_000)]
    assert got == sorted(((i, "response", n) for i, n in want), key=repr) and all(r.complete for r in out)


def test_no_pages(spark, tmp_path):
    path = tmp_path / "w"
    write_warc(spark.createDataFrame([], PAGES), str(path))
    assert back(spark, path) == []


def segments_of(payload, size):
    block = warc.HTTP_HEADER + chunked(payload, 10)
    pieces = [block[i : i + size] for i in range(0, len(block), size)]
    head = {"warc-type": "response", "warc-record-id": "<urn:page:7#a>"}
    return [
        {"origin": "<urn:page:7#a>", "number": n, "block": p, "headers": list(head.items()) if n == 1 else [("warc-type", "continuation")],
         "total": len(block) if n == len(pieces) else None}
        for n, p in enumerate(pieces, 1)
    ]


def test_segments_in_any_order_and_missing_ones():
    segments = segments_of(b"payload of some length" * 3, 37)
    random.Random(1).shuffle(segments)
    assert reassembled(segments)[4] == b"payload of some length" * 3 and reassembled(segments)[7]
    for lost in range(len(segments)):
        row = reassembled(segments[:lost] + segments[lost + 1 :])
        assert row[0] == "7" and row[4] is None and not row[7]
    wrong = [s | ({"total": s["total"] + 1} if s["total"] else {}) for s in segments]
    assert not reassembled(wrong)[7]
    assert not reassembled(segments + segments[:1])[7]


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_chunked(size):
    for payload in (b"", b"a", b"0\r\n\r\n", bytes(range(256))):
        assert dechunked(chunked(payload, size)) == payload
    assert dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"-1\r\n"):
        assert dechunked(broken) is None


def test_truncated_file_is_refused(spark, tmp_path):
    path = tmp_path / "w"
    write_warc(pages_like(spark, [(1, "x" * 500)]), str(path))
    content = b"".join(gzip.open(f).read() for f in Path(path).glob("part-*"))
    with pytest.raises(EOFError):
        list(parse_records(content[:-100]))
    with pytest.raises(ValueError):
        list(parse_records(b"HTTP/1.1 200\r\n\r\n"))


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(queries.QUERIES["op8_warc"](spark, folder)) == sql_rows(connect(folder), queries.ORACLES["op8_warc"])
