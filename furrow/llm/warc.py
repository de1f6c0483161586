"""WARC archives of pages with a two-level capture index.

Records are gzip members in files of the shared folder. The index is sorted by reversed-host URL keys and cut in
compressed blocks; a sparse directory keeps each block's first and last key and its place. A look-up searches the
directory by halves, reads the ranges of the blocks that may hold the key and then the records' ranges.
"""

from __future__ import annotations

import base64
import bisect
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder
from .spark import settle, shared_dir

LINES, FILE_BYTES = 1000, 1 << 27
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:\d+)?([^#]*)")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The host's labels reversed, then ")" and the path and query, lower-cased; "-" without a URL."""
    if not url:
        return "-"
    m = _URL.match(url)
    if not m or not m[1]:
        return _quoted(url.lower())
    host = m[1].lower().removeprefix("www.")
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    labels = host if host.startswith("[") else ",".join(reversed(host.strip(".").split(".")))
    return _quoted(f"{labels}{port}){(m[3] or '/').lower()}")


def _quoted(text: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, whose block has the response's header alone."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        fields.append(f"WARC-Target-URI: {_quoted(url)}")
    if revisit:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return None if name in ("", "null") else int(name)


def parse(raw: bytes) -> dict:
    """A record's fields and payload. A response's digest and size are taken from its payload, which must agree
    with its header; a revisit's from its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        found = base64.b32encode(_sha1(payload)).decode()
        if (len(payload), found) != (size, digest):
            raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to")), "payload": payload}


def _sha1(data: bytes) -> bytes:
    import hashlib

    return hashlib.sha1(data).digest()


@dataclass
class Archive:
    """Where archives and index are, and the directory ``(first_key, last_key, file, offset, length, lines)``, one row a block.

    Blocks are cut from one sorted order, so in order of ``(first_key, last_key)`` neither key ever falls."""

    folder: Folder
    directory: DataFrame


def write(pages: DataFrame, *, least_revisit: int = 0, lines: int = LINES) -> Archive:
    """Writes a record for each row and the index over them into the shared folder.

    Of rows with equal payloads of at least ``least_revisit`` bytes, those with the largest page_id are responses
    and the others revisit it; smaller ones are all responses. A null html is an empty payload; rows with a null
    page_id revisit a row that has one, or are responses. Repeated rows get a record each, an empty table gives an
    archive without records. Columns are read by name, so others don't matter.
    """
    spark = pages.sparkSession
    folder = Folder(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    newest = rows.groupBy("sha", "size").agg(F.max("page_id").alias("newest"))
    # digests meet without their payloads; these move once, by page, so a frequent payload is no hot key for them
    refers = F.when((F.col("size") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    named = rows.select("page_id", "sha", "size").distinct().join(newest, ["sha", "size"]).select(F.col("page_id").alias("page"), F.col("sha").alias("its_sha"), refers.alias("refers_to"))
    told = rows.join(named, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("sha") == F.col("its_sha")))
    told = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "sha", "size", "refers_to")
    archives = folder.child("archives")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        at = 0
        for batch in batches:
            out = []
            for i, url, payload, sha, size, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None or at >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    (name, stream), at = archives.create(".warc.gz"), 0
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = member.compress(record(i, url, payload or b"", size, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to)) + member.flush()
                stream.write(raw)
                out.append((url_key(url), i, name, at, len(raw)))
                at += len(raw)
            yield _batch(out, _ENTRY)
        if stream is not None:
            stream.close()

    entries = settle(told.mapInArrow(store, "key string, page_id long, file string, offset long, length long"))
    total = entries.count()
    parts = max(1, min(-(-total // (4 * lines)), 100_000))
    blocks = folder.child("index")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        at = 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal at
            raw = zlib.compress("\n".join("{} {} {} {} {}".format(*e) for e in held).encode())
            stream.write(raw)
            row = (held[0][0], held[-1][0], name, at, len(raw), len(held))
            at += len(raw)
            held.clear()
            return _batch([row], _BLOCK)

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    name, stream = blocks.create(".cdx.z")
                held.append(entry)
                if len(held) == lines:
                    yield flush()
        if held:
            yield flush()
        if stream is not None:
            stream.close()

    ordered = entries.repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    directory = settle(ordered.mapInArrow(index, "first_key string, last_key string, file string, offset long, length long, lines long"))
    return Archive(folder, directory)


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_BLOCK = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _lines(folder: Folder, file: str, offset: int, length: int) -> list[list[str]]:
    return [x.split(" ") for x in zlib.decompress(folder.child("index").read(file, offset, length)).decode().split("\n")]


def read(archive: Archive, payloads: bool = True) -> DataFrame:
    """Every record, found by the index: a task takes blocks of the index and reads the ranges they name."""
    folder = archive.folder
    n = archive.directory.count()
    dealt = archive.directory.select("file", "offset", "length").repartition(max(1, min(n, 100_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                by_file = defaultdict(list)
                for _, _, file, offset, length in _lines(folder, *block):
                    by_file[file].append((int(offset), int(length)))
                out = []
                for file, places in by_file.items():
                    with folder.child("archives").file(file) as f:
                        for offset, length in sorted(places):
                            found = parse(zlib.decompress(f.read_at(length, offset), 31))
                            if not payloads or found["record_type"] == "revisit":
                                found["payload"] = None
                            out.append(tuple(found[k] for k in _READ.names))
                            if len(out) >= 256:
                                yield _batch(out, _READ)
                                out = []
                if out:
                    yield _batch(out, _READ)

    return dealt.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def look_up(spark: SparkSession, archive: Archive, url: str | None) -> list[dict]:
    """All records of a URL, or of the rows without one, by the directory, one or more blocks and the records' ranges.

    Only the directory's rows whose range holds the key come to the driver."""
    key = url_key(url)
    blocks = archive.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("first_key", "last_key", "file", "offset", "length").collect()
    directory = sorted(map(tuple, blocks))
    at = bisect.bisect_left(directory, key, key=lambda block: block[1])
    out = []
    for first, _, file, offset, length in directory[at:]:
        if first > key:
            break
        lines = _lines(archive.folder, file, offset, length)
        out += [parse(zlib.decompress(archive.folder.child("archives").read(f, int(o), int(n)), 31)) for k, _, f, o, n in lines if k == key]
    return out
