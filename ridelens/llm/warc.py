"""WARC archives: one gzip member per record, written and read in sequence.

Which record holds a payload and which ones revisit it is settled by Spark first. Each
task then writes archives of its own to the shared folder; a manifest, committed by
Spark, lists the files of the attempts that succeeded, so a lost executor leaves at
most files that nobody reads. The reader streams an archive member by member with
bounded memory: the longest record and one chunk.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.llm.tables import new_folder, table

CHUNK = 1 << 16
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 30
#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31
_URN = "urn:x-page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def open_shared(uri: str, mode: str) -> BinaryIO:
    """A file of the shared folder, on a mounted path or in a store that Arrow knows."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return open(parsed.path, mode)  # noqa: SIM115
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_stream(path)


def make_folder(uri: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    store.create_dir(path, recursive=True)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    head += f"Content-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    body = VERSION + b"\r\n" + head.encode() + block + b"\r\n\r\n"
    return press.compress(body) + press.flush()


def page_record(
    page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None
) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_URN}{quote(page_id)}>"),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<{_URN}{quote(refers_to)}>"),
        ]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, block)


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of each gzip member, inflated as the chunks come in."""
    inflate, parts, rest = None, [], b""
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            break
        if inflate is None:
            inflate, parts = zlib.decompressobj(_GZIP), []
        parts.append(inflate.decompress(data))
        if inflate.eof:
            rest = inflate.unused_data
            inflate = None
            yield b"".join(parts)
    if inflate is not None:
        raise ValueError("the archive ends within a record")


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record, framing and digest verified."""
    for member in _members(stream):
        head, gap, rest = member.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if not gap or version != VERSION:
            raise ValueError("a gzip member is not a WARC record")
        fields = {}
        for line in lines:
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("content-length does not frame the record")
        said = fields.get("warc-block-digest")
        if said and said != f"sha1:{base32_sha1(block)}":
            raise ValueError("block digest differs")
        yield fields, block


def _id_in(field: str) -> str:
    return unquote(field.strip("<>").removeprefix(_URN))


def read_pages(stream: BinaryIO) -> Iterator[tuple]:
    """(page id, url, payload or None, payload bytes, digest, type, referred id)."""
    for fields, block in read_records(stream):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(
            int(v) for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])
            if n.lower() == b"content-length"
        )
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError("payload and digest differ")
        referred = fields.get("warc-refers-to")
        yield (
            _id_in(fields["warc-record-id"]),
            fields.get("warc-target-uri"),
            payload if kind == "response" else None,
            size,
            digest,
            kind,
            None if referred is None else _id_in(referred),
        )


def with_revisits(
    pages: DataFrame, *, id_col: str, payload_col: str, revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """``pages`` with _refers_to: the smallest id that has the same payload, where it is
    another row's. Payloads are equal if their SHA-256 is; only digests are grouped."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    keyed = pages.withColumn("_payload_key", F.sha2(payload, 256)).withColumn(
        "_payload_bytes", F.octet_length(payload)
    )
    first = (
        keyed.filter(F.col("_payload_bytes") >= revisit_bytes)
        .groupBy("_payload_key")
        .agg(F.min(id_col).alias("_first"), F.count("*").alias("_rows"))
        .filter("_rows > 1")
        .select("_payload_key", "_first")
    )
    referred = F.when(~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first"))
    return (
        keyed.join(first, "_payload_key", "left")
        .withColumn("_refers_to", referred)
        .drop("_payload_key", "_payload_bytes", "_first")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest (archive, records, bytes).

    A null payload is written as an empty one, a null url leaves its field out, a null
    id is written as an empty id. Of equal payloads of at least ``revisit_bytes`` the
    row with the smallest id is the response; rows that repeat its id are responses
    too, and without any id all are. Other columns are not written.
    """
    slim = pages.select(
        pages[id_col].alias("id"),
        pages[url_col].cast("string").alias("url"),
        pages[payload_col].cast("string").alias("payload"),
    )
    rows = with_revisits(slim, id_col="id", payload_col="payload", revisit_bytes=revisit_bytes)
    rows = rows.select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        F.col("_refers_to").cast("string").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, records, size = None, "", 0, 0

        def manifest() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                names=["archive", "records", "bytes"],
            )

        for batch in batches:
            for page_id, url, payload, refers_to in zip(
                *(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True
            ):
                if out is None:
                    uri, records, size = f"{folder}/{uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(uri, "wb")
                data = (payload.as_py() or "").encode()
                member = page_record(
                    page_id.as_py() or "", url.as_py(), data, base32_sha1(data), refers_to.as_py()
                )
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield manifest()
        if out is not None:
            out.close()
            yield manifest()

    make_folder(folder)
    listed = rows.mapInArrow(write, "archive string, records long, bytes long")
    listed.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(listed.schema).parquet(f"{folder}/manifest")


def read_archives(
    manifest: DataFrame, *, id_type: T.DataType | None = None, with_payload: bool = False
) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all records.

    Framing and digests are verified; a damaged archive fails the job. ``with_payload``
    adds the payload of responses as text. An empty id reads as null.
    """
    schema = T.StructType(
        [
            T.StructField("page_id", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
            T.StructField("record_type", T.StringType()),
            T.StructField("refers_to", T.StringType()),
        ]
    )
    if with_payload:
        schema.add("payload", T.StringType())
    kinds = [pa.int64() if f.name == "payload_bytes" else pa.string() for f in schema]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with open_shared(archive, "rb") as stream:
                    for name, url, payload, size, digest, kind, referred in read_pages(stream):
                        row = (name or None, url, size, digest, kind, referred)
                        if with_payload:
                            row += (None if payload is None else payload.decode(),)
                            held += len(payload or b"")
                        rows.append(row)
                        if len(rows) >= 5000 or held >= 16_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.select("archive").repartition(max(1, manifest.count()))
    out = files.mapInArrow(read, schema)
    if id_type is not None:
        out = out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    return out


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(pages, new_folder(spark, "warc"))
    return read_archives(manifest, id_type=pages.schema["page_id"].dataType).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS f FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (1 + ((('0x' || substr(h, (5 * (k // 4) + 1)::INT, 5))::INT >> (5 * (3 - k % 4))::INT) & 31))::INT, 1)),
    '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM f
"""
