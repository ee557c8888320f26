import hashlib
import io

import pytest

from selenite.llm.common import fresh_path
from selenite.llm.warc import WarcError, read_archives, read_records, record_bytes, write_archives


def test_record_round_trip_and_faults():
    payload = "héllo\r\n\r\n".encode() * 40000
    archive = record_bytes(7, "http://a b/\n", payload) + record_bytes(8, None, payload, refers_to=7) + record_bytes(None, "", b"") + record_bytes(9, "u", b"\0" * (17 << 20))
    got = list(read_records(io.BytesIO(archive), payloads=True))
    assert [r.headers["warc-type"] for r in got] == ["response", "revisit", "response", "response"]
    assert got[0].payload == payload and got[0].payload_sha1 == got[1].payload_sha1 == hashlib.sha1(payload).hexdigest()
    assert got[1].payload_bytes == len(payload) and got[1].headers["warc-refers-to"] == "<urn:page:7>"
    assert got[0].headers["warc-target-uri"] == "http://a%20b/%0A" and archive[-1] == 0
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(archive[:200])))
    import gzip

    one = gzip.decompress(record_bytes(1, "u", b"abc"))
    with pytest.raises(WarcError, match="digest"):
        list(read_records(io.BytesIO(gzip.compress(one.replace(b"abc", b"abd")))))


def test_archives(spark):
    big = "x" * 1000
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"page {i}") for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "é" * 500), (103, "u", "é" * 500), (None, "u", big), (57, "again", big), (104, "u", "y" * 999), (105, "u", "y" * 999), (106, "u", "z" * 300000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    path = write_archives(pages, fresh_path(spark, "warc"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(spark, path).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None)
        copy = len(data) >= 1000 and page != top
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if copy else "response", top if copy else None))
    assert got == sorted(want, key=str)
    assert read_archives(spark, write_archives(pages.limit(0), fresh_path(spark, "warc"))).count() == 0


def test_archives_end_by_bytes(spark):
    """Long pages after short ones: no archive grows beyond its bytes by more than a record."""
    import random

    draw = random.Random(1)
    rows = [(i, "u", "short" if i < 500 else "".join(chr(draw.randrange(33, 126)) for _ in range(20_000))) for i in range(540)]
    path = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), fresh_path(spark, "warc"), archive_bytes=50_000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert len(sizes) > 5 and max(sizes) < 75_000
    assert sorted(r.page_id for r in read_archives(spark, path).collect()) == list(range(540))
