import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lakeqa.llm import queries, warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type int, path string")


def expected(rows, least=0):
    heads = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None and len((html or "").encode()) >= least:
            heads[html or ""] = min(page_id, heads.get(html or "", page_id))
    out = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        copies = sum((h or "") == (html or "") for _, _, h, *_ in rows)
        head = heads.get(html or "") if copies > 1 else page_id
        same = head is None or head == page_id
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "response" if same else "revisit", None if same else head))
    return sorted(out, key=repr)


ROWS = [
    (3, "http://a/", "same", 1, "x"),
    (1, "http://b/", "same", 1, "x"),
    (1, "http://b/", "same", 1, "x"),
    (None, None, "same", 1, "x"),
    (5, None, None, 1, "x"),
    (6, "http://c/\r\nX: y", "", 1, "x"),
    (7, "http://d/", "ä\r\n\r\n\x1f\x8b\x08 not a member " * 4000, 1, "x"),
    (8, "http://e/", "alone", 1, "x"),
]


def result(spark, rows, tmp_path, split, least=0):
    manifest = warc.archive_pages(pages_of(spark, rows), str(tmp_path / "out"), least, archive_bytes=900)
    found = warc.read_archives(spark, manifest, split_bytes=split)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    return found, sorted(
        (
            tuple(r)
            for r in found.select(
                number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")
            ).collect()
        ),
        key=repr,
    )


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_round_trip_by_any_split(spark, tmp_path, split):
    found, got = result(spark, ROWS, tmp_path, split)
    assert got == expected(ROWS)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in found.where("record_type = 'response'").collect()}
    assert payloads["urn:page:7"].decode() == ROWS[6][2]
    targets = {r["record_id"]: r["target_uri"] for r in found.collect()}
    assert targets["urn:page:5"] is None and targets["urn:page:6"] == "http://c/%0D%0AX: y"


def test_small_payloads_are_all_responses(spark, tmp_path):
    assert result(spark, ROWS, tmp_path, 500, least=5)[1] == sorted(
        [(i, n, d, "response", None) for i, n, d, _, _ in expected(ROWS)], key=repr
    )


def test_empty_table(spark, tmp_path):
    assert result(spark, [], tmp_path, 500)[1] == []


def test_magic_inside_other_data_is_no_record():
    record = warc._record("urn:page:1", None, "X", 3, None, b"abc")
    member = gzip.compress(record, mtime=0)
    trap = gzip.compress(b"not an archive", mtime=0)
    data = b"\x1f\x8b\x08" + trap + member + trap + member
    for split in (1, 7, 64, len(data)):
        found = [
            (at, block.partition(b"\r\n\r\n")[2])
            for start in range(0, len(data), split)
            for at, _, block in warc.records_of_range(io.BytesIO(data), start, min(start + split, len(data)))
        ]
        assert found == [(3 + len(trap), b"abc"), (3 + 2 * len(trap) + len(member), b"abc")]


def test_broken_archive_is_told(spark):
    member = gzip.compress(warc._record("urn:page:1", None, "X", 3, None, b"abc" * 100_000), mtime=0, compresslevel=0)
    with pytest.raises(ValueError):
        list(warc.records_of_range(io.BytesIO(member[:-100]), 0, len(member)))


def test_query_columns(spark):
    df = queries.QUERIES["op1_warc"](spark, "/root/testdata/sf0.001")
    assert df.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_headers_of_any_length(spark, tmp_path):
    import random

    draw = random.Random(1)
    urls = ["http://a/?" + "x" * 70_000, "data:," + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=900_000))]
    rows = [*ROWS, *[(20 + i, u, f"page {i}", 1, "x") for i, u in enumerate(urls)]]
    found, got = result(spark, rows, tmp_path, 5000)
    assert got == expected(rows)
    targets = {r["record_id"]: r["target_uri"] for r in found.collect()}
    assert [targets["urn:page:20"], targets["urn:page:21"]] == urls


def test_records_are_counted(spark, tmp_path):
    manifest = warc.archive_pages(pages_of(spark, ROWS), str(tmp_path / "out"), archive_bytes=900)
    for more in (1, -1):
        with pytest.raises(ValueError, match="records of"):
            warc.read_archives(spark, manifest.withColumn("records", F.col("records") + more), split_bytes=500)


def test_record_without_end_of_header_is_told():
    member = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n", mtime=0)
    with pytest.raises(ValueError):
        list(warc.records_of_range(io.BytesIO(member), 0, len(member)))
