import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quiltframe.llm import warc

BIG = "é" * 700
PAGES = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, "small"), (4, "u", "small"), (5, "x\r\ny", None),
         (None, "n", BIG), (6, "v", ""), (7, "w", "z" * 999), (8, "w", "z" * 999), (9, "w", "z" * 1000),
         (10, "w", "z" * 1000), (10, "w", "z" * 1000)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "clash") for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").repartition(3)


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == data and p is not None), default=None)
        revisit = len(data) >= 1000 and top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                    top if revisit else None))
    return sorted(out, key=str)


def test_round_trip(pages):
    got = warc.archive(pages)
    assert sorted((tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got.collect()), key=str) == expected(PAGES)
    texts = {r.page_id: r.payload for r in got.where("record_type = 'response'").collect()}
    assert bytes(texts[2]).decode() == BIG and bytes(texts[6]) == b""


def test_members_are_plain_gzip(pages, tmp_path):
    warc.write_warc(warc.records(pages), str(tmp_path / "w"))
    data = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes())
                    for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    assert data.count(b"WARC/1.0\r\n") == len(PAGES)


def test_chance_magic_and_small_ranges(spark, tmp_path):
    # Stored members hold their payload as it is, so a payload with the magic has it inside.
    import zlib
    payloads = [b"A" * i + warc.MAGIC * (i % 3) + b"B" * (40 + i) + warc.MAGIC + bytes([i]) * 300 for i in range(40)]
    plain = b""
    for i, p in enumerate(payloads):
        head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:"
                f"{hashlib.sha1(p).hexdigest()}\r\nX-Payload-Length: {len(p)}\r\nContent-Length: {len(p)}\r\n\r\n")
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        plain += packer.compress(head.encode() + p + b"\r\n\r\n") + packer.flush()
    (tmp_path / "a.warc").write_bytes(plain)
    for limit in ("701b", "97b", "128m"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        cost = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            rows = warc.read_warc(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
        assert {r.page_id: bytes(r.payload) for r in rows} == dict(enumerate(payloads)) and len(rows) == 40


def test_large_record():
    member = warc.member(1, "u", os.urandom(17 << 20), 17 << 20, "x", None)
    assert member[-1] == 0 and gzip.decompress(member).startswith(b"WARC/1.0")


def test_empty(pages):
    assert warc.archive(pages.limit(0)).count() == 0
    assert warc.archive(pages.where(F.lit(False))).columns[0] == "page_id"
