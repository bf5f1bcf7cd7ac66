"""WARC archives: one gzip member per record, written in tasks and read back as a stream."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Query, shared_folder, slices, stored, table

#: Payloads from here on are stored once; smaller ones are always written out.
REVISIT_BYTES = 1000
CHUNK = 1 << 16
#: A new archive is begun after so many bytes.
ARCHIVE_BYTES = 256 << 20
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(digest)


def record(kind: str, url: str, page_id: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record as one gzip member. A revisit has no block; its digest and length are the payload's."""
    block = payload if kind == "response" else b""
    headers = [
        VERSION,
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <" + uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{kind}").urn.encode() + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + " ".join(url.split()).encode(),
        b"WARC-Payload-Digest: " + _base32(hashlib.sha1(payload).digest()),
        b"WARC-Block-Digest: " + _base32(hashlib.sha1(block).digest()),
        b"X-Page-ID: %d" % page_id,
        b"X-Payload-Length: %d" % len(payload),
    ]
    if refers_to is not None:
        headers += [b"WARC-Profile: " + PROFILE, b"X-Refers-To-Page: %d" % refers_to]
    headers += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(headers) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(source: io.RawIOBase, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, in order.

    The stream is inflated piece by piece, one gzip member after the other; a block is cut by its
    Content-Length and its digest is verified. Memory holds one record and one piece. A member that
    ends early, a wrong length, header or digest is a ValueError.
    """
    left, inflater, plain = b"", None, bytearray()
    while True:
        piece = left or source.read(chunk)
        left = b""
        if not piece:
            if inflater is not None:
                raise ValueError("the archive ends inside a record")
            return
        if inflater is None:
            inflater, plain = zlib.decompressobj(31), bytearray()
        plain += inflater.decompress(bytes(piece))
        if inflater.eof:
            left, inflater = inflater.unused_data, None
            if plain:
                yield _parsed(bytes(plain))


def _parsed(plain: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = plain.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("a record without a WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:60]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("content length and record do not agree")
    if headers["warc-block-digest"].encode() != _base32(hashlib.sha1(block).digest()):
        raise ValueError("the block digest does not fit")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != headers["warc-block-digest"]:
        raise ValueError("the payload digest does not fit")
    return headers, block


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the response's page_id for revisits, else NULL.

    Of equal payloads of ``least`` bytes or more that with the largest page_id is the response. The
    largest page_id per digest is a grouped aggregate; pages meet it by digest without their html,
    and then their html by page_id. A row without page_id cannot be named and gets page -1.
    """
    pages = pages.select(
        F.coalesce("page_id", F.lit(-1)).cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    keys = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n"))
    large = keys.where(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    revisits = (
        large.select("page_id", "digest")
        .distinct()
        .join(first.where("n > 1").drop("n"), "digest")
        .where("page_id <> first")
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to"))
    )
    own = F.sha1(F.encode("html", "UTF-8"))
    return pages.join(revisits, (pages.page_id == revisits.p) & (own == revisits.d), "left").drop("p", "d")


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``planned`` (page_id, url, html, refers_to) as archives below ``folder`` and list them.

    Every task writes files of names of its own, so a task that runs again leaves the first one's
    files unlisted and does no harm. The list (path, records) is stored, so nothing is written twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, out, n = "", None, 0
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n = store.open_output_stream(path, compression=None), 0
                kind = "response" if refers_to is None else "revisit"
                out.write(record(kind, url, page_id, refers_to, html.encode()))
                n += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    listed = planned.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records long")
    return stored(listed, "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (lower-case hex), block. An archive is read from its start to its end by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, held, n = [], 0, 0
                with store.open_input_stream(path, compression=None) as source:
                    for headers, block in read_records(source):
                        refers_to = headers.get("x-refers-to-page")
                        rows.append(
                            {
                                "page_id": int(headers["x-page-id"]),
                                "url": headers["warc-target-uri"],
                                "record_type": headers["warc-type"],
                                "refers_to": None if refers_to is None else int(refers_to),
                                "payload_bytes": int(headers["x-payload-length"]),
                                "payload_digest": base64.b32decode(headers["warc-payload-digest"][5:]).hex(),
                                "block": block,
                            }
                        )
                        held += len(block)
                        n += 1
                        if held >= 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                if n != records:
                    raise ValueError(f"{path} holds {n} records, {records} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    # One archive each: a task that is lost repeats one archive.
    dealt = archives.repartition(archives.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(
        read,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, block binary",
    )


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("block", pa.binary()),
    ]
)


def archived(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (a new shared one) and read all records back.

    NULL html and url are empty; repeated rows are records of their own; of rows that share the
    largest page_id and payload each is a response; columns other than page_id, url and html are not
    written. No pages give no archive and no rows.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(plan_records(pages, least), folder), folder)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {
    "op5_warc_round_trip": Query(
        op5,
        f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
 q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
 CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to FROM q""",
    )
}
