import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from ridelens.llm.tables import new_folder
from ridelens.llm.warc import page_record, read_archives, read_records, write_archives

ROWS = [
    (1, "http://a.example/x y?q=ü", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b.example/", None),
    (4, "http://c.example/", ""),
    (None, "http://d.example/", "<p>one</p>"),
    (5, "not a url\r\nWARC-Type: fake", "\r\n\r\nWARC/1.1\r\n" * 3),
    (6, "http://e.example/", "é" * 300_000),
    (1, "http://a.example/again", "<p>one</p>"),
    (-7, "http://f.example/", "alone"),
]


@pytest.fixture
def pages(spark):
    schema = "page_id long, url string, html string"
    return spark.createDataFrame(ROWS, schema).withColumns({c: F.lit(0) for c in ("id", "payload", "refers_to")})


def test_round_trip(spark, pages):
    manifest = write_archives(pages, new_folder(spark, "warc"))
    rows = read_archives(manifest, id_type=pages.schema["page_id"].dataType, with_payload=True).collect()
    want = []
    first = {"<p>one</p>": 1, "": 3}
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        lead = first.get(html or "", page_id)
        revisit = page_id != lead
        want.append((page_id, len(data), digest, "revisit" if revisit else "response", lead if revisit else None, None if revisit else html or ""))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(m.records for m in manifest.collect()) == len(ROWS)


def test_small_payloads_are_never_revisits(spark, pages):
    manifest = write_archives(pages, new_folder(spark, "warc"), revisit_bytes=5, archive_bytes=100)
    rows = read_archives(manifest).collect()
    kinds = {r.page_id: r.record_type for r in rows}
    assert kinds["4"] == "response" and kinds["2"] == "revisit"
    assert manifest.count() == len(ROWS)  # one archive per record at this size


def test_each_record_is_a_gzip_member():
    one = page_record("1", "http://a/", b"abc", "X", None)
    two = page_record("2", None, b"abc", "X", "1")
    assert gzip.decompress(one + two).count(b"WARC/1.1") == 2
    fields = [f for f, _ in read_records(io.BytesIO(one + two))]
    assert fields[1]["warc-refers-to"] == "<urn:x-page:1>"


@pytest.mark.parametrize("damage", ["cut", "digest", "length"])
def test_damage_is_found(damage):
    whole = page_record("1", "http://a/", b"abc" * 1000, "X", None)
    if damage == "cut":
        bad = whole[:-20]
    else:
        text = gzip.decompress(whole)
        old, new = (b"abcabc", b"abcabd") if damage == "digest" else (b"Content-Length: 30", b"Content-Length: 20")
        bad = gzip.compress(text.replace(old, new, 1))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(bad)))


def test_empty(spark, pages):
    manifest = write_archives(pages.limit(0), new_folder(spark, "warc"))
    assert read_archives(manifest).collect() == []
