"""WARC archives: written one gzip member a record, read back by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa.scale import cut_lineage, new_shared_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
CHUNK = 1 << 18
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, bytes bigint, records bigint"
RECORD = (
    "path string, record_at bigint, record_id string, target_uri string, record_type string, "
    "refers_to string, payload_bytes bigint, payload_digest string, payload binary"
)


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(record_id: str, url: str | None, digest: str, size: int, refers_to: str | None, body: bytes) -> bytes:
    block = HTTP_HEAD + (b"" if refers_to is not None else body)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{refers_to}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 4
) -> DataFrame:
    """Writes ``records`` under ``folder`` and returns the manifest: path, bytes and records of each archive.

    ``records`` has ``record_id``, ``url`` (may be null), ``body`` (binary), ``sha1`` (hex),
    ``size`` and ``refers_to`` (null: response, else revisit). A task writes archives named after
    its attempt; only those of attempts that ended well get into the manifest, so a lost executor
    leaves at most files that nobody reads. ``folder`` is any place pyarrow can write to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        done, out, count = [], None, 0

        def close() -> None:
            done[-1] |= {"bytes": out.tell(), "records": count}
            out.close()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record_id, url, body, sha1, size, refers_to = row
                if out is None:
                    path = f"{stem}-{len(done):04d}.warc.gz"
                    out, count = store.open_output_stream(path, compression=None), 0
                    done.append({"path": path})
                raw = _record(record_id, url, base32_sha1(sha1), size, refers_to, body)
                out.write(gzip.compress(raw, compresslevel=level, mtime=0))
                count += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    fields = ("record_id", "url", "body", "sha1", "size", "refers_to")
    return cut_lineage(records.select(*fields).mapInArrow(write, MANIFEST))


def _member(source, at: int) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at ``at``; None if none does.

    What decodes to the start of a WARC header is a record, however long its header is; one that is
    broken or cut off is an error.
    """
    unzip, plain, pos, head_end, looked = zlib.decompressobj(31), bytearray(), at, -1, 0
    begun = lambda: plain[: len(VERSION)] == VERSION
    while not unzip.eof:
        source.seek(pos)
        data = source.read(CHUNK)
        try:
            plain += unzip.decompress(data)
        except zlib.error:
            if not begun():
                return None
            raise ValueError(f"broken record at byte {at}") from None
        if not VERSION.startswith(bytes(plain[: len(VERSION)])):
            return None
        if head_end < 0:
            head_end = plain.find(b"\r\n\r\n", looked)
            looked = max(0, len(plain) - 3)
        if not data and not unzip.eof:
            if not begun():
                return None
            raise ValueError(f"cut-off record at byte {at}")
        pos += len(data)
    if not begun():
        return None
    if head_end < 0:
        raise ValueError(f"record without an end of its header at byte {at}")
    lines = bytes(plain[:head_end]).decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not headers.get("content-length", "").isdigit():
        raise ValueError(f"record without a length at byte {at}")
    block = bytes(plain[head_end + 4 : head_end + 4 + int(headers["content-length"])])
    return headers, block, pos - len(unzip.unused_data)


def records_of_range(source, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """Records whose member starts in [start, end): scan for the magic, keep what decodes to a header."""
    pos = start
    while pos < end:
        source.seek(pos)
        data = source.read(min(CHUNK, end - pos) + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        if hit < 0 or pos + hit >= end:
            pos += max(1, len(data) - len(MAGIC) + 1)
            continue
        found = _member(source, pos + hit)
        if found is None:
            pos += hit + 1
            continue
        headers, block, after = found
        yield pos + hit, headers, block
        pos = after


def read_archives(
    spark: SparkSession,
    manifest: DataFrame,
    split_bytes: int = SPLIT_BYTES,
    with_payload: bool = True,
) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, bytes, records), one row each, in splits of ``split_bytes``.

    A task owns the records that start inside its range, wherever they end, so any split size gives
    the same rows. Digest and length of a response come from its payload as read; a revisit has no
    payload and keeps those its header names. ``payload`` is null unless asked for. The rows are
    written once, and counted: an archive with more or fewer records than ``records`` says is an error.
    """
    places = manifest.select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"), "bytes"
    ).where("start < bytes")
    tasks = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(1))).first()[0]
    names = ("path", "record_at", "record_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest")
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string())
    schema = pa.schema([*zip(names, kinds, strict=True), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = arrow_fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    for at, headers, block in records_of_range(source, start, min(start + split_bytes, size)):
                        kind, refers = headers.get("warc-type"), headers.get("warc-refers-to")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if kind == "revisit":
                            length = int(headers.get("x-payload-length", "0"))
                            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        else:
                            length, digest = len(payload), base32_sha1(hashlib.sha1(payload).hexdigest())
                        given = payload if with_payload and kind != "revisit" else None
                        rows.append((path, at, headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), kind, refers and refers.strip("<>"), length, digest, given))
                        held += len(given or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = cut_lineage(places.repartition(max(1, int(tasks))).mapInArrow(read, RECORD))
    told = manifest.groupBy("path").agg(F.sum("records").alias("records"))
    counts = told.join(found.groupBy("path").agg(F.count("*").alias("read")), "path", "left")
    wrong = counts.where(F.col("records") != F.coalesce("read", F.lit(0))).orderBy("path").take(3)
    if wrong:
        raise ValueError("; ".join(f"{r['path']}: {r['read'] or 0} records of {r['records']}" for r in wrong))
    return found


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record for every page (page_id, url, html) and returns the manifest.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id
    is a response and the others revisit it; rows that repeat the smallest page_id are responses
    too, and pages without an id revisit it, or are all responses where no copy has an id. Null
    html is an empty payload, a null url leaves its header out. Other columns are not looked at. Payload classes are
    sums of (digest, smallest id); the page itself moves at most once, to meet its class, and only
    classes of two and more pages are there to meet, so Spark can split a class of any size.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("body")
    ).withColumns({"sha1": F.sha1("body"), "size": F.octet_length("body").cast("bigint")})
    classes = rows.where(F.col("size") >= least_bytes).groupBy("sha1")
    heads = classes.agg(F.min("page_id").alias("head"), F.count("*").alias("copies"))
    heads = cut_lineage(heads.where("copies > 1 AND head IS NOT NULL").select("sha1", "head"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    records = rows.join(heads, "sha1", "left").select(
        urn("page_id").alias("record_id"),
        "url",
        "body",
        "sha1",
        "size",
        F.when(
            F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), urn("head")
        ).alias("refers_to"),
    )
    return write_archives(records, folder or new_shared_path(spark, "warc"), archive_bytes)
