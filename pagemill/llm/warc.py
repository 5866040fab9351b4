"""WARC archives in Zstandard form: a dictionary in the leading skippable frame, one frame per record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import slices, stored
from pagemill.operators import sampling
from pagemill.session import shared_dir

#: Magic of the skippable frame that holds a dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
#: Magic of a Zstandard frame (fixed value); a dictionary may itself be stored as one.
FRAME_MAGIC = 0xFD2FB528
#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 100
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on at most so many pages, of each the first so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 64 << 10
READ_BYTES = 1 << 18
ID_PREFIX = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, payload binary, archive string, place bigint"
)


class ArchiveError(ValueError):
    """An archive that breaks the format; the message names the fault."""


def train(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; too few or too uniform samples give raw content, none an empty one."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to page ``first``."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{first}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_records(rows: Iterator[tuple], dictionary: bytes, open_archive, limit: int = ARCHIVE_BYTES):
    """Write records to as many archives as ``limit`` asks for; yields ``(path, bytes, records)`` of each closed one."""
    shared = zstandard.ZstdCompressionDict(dictionary)
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
    path, out, size, n = None, None, 0, 0
    for row in rows:
        if out is None:
            path, out = open_archive()
            size, n = 8 + len(dictionary), 0
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        frame = squeeze.compress(record(*row))
        out.write(frame)
        size += len(frame)
        n += 1
        if size >= limit:
            out.close()
            yield path, size, n
            out = None
    if out is not None:
        out.close()
        yield path, size, n


def read_dictionary(source: BinaryIO) -> bytes:
    """The dictionary of the leading skippable frame, unpacked if it is itself compressed."""
    head = source.read(8)
    if len(head) < 8:
        raise ArchiveError("archive without a leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ArchiveError("the leading frame holds no dictionary")
    data = source.read(size)
    if len(data) < size:
        raise ArchiveError("dictionary cut short")
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def read_frames(source: BinaryIO) -> Iterator[bytes]:
    """Decode the frames of an archive one after the other; only one record is in memory at a time."""
    shared = zstandard.ZstdCompressionDict(read_dictionary(source))
    unpack = zstandard.ZstdDecompressor(dict_data=shared)
    data = source.read(READ_BYTES)
    while data:
        frame = unpack.decompressobj()
        parts = []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"broken frame: {e}") from e
            if frame.eof:
                data = frame.unused_data or source.read(READ_BYTES)
                break
            data = source.read(READ_BYTES)
            if not data:
                raise ArchiveError("frame cut short")
        yield b"".join(parts)


def fields(lines: list[bytes], what: str) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"broken {what} header line")
        found[name.decode().lower()] = value.strip().decode()
    return found


def page_number(uri: str) -> int | None:
    inner = uri.removeprefix("<").removesuffix(">")
    if not inner.startswith(ID_PREFIX):
        raise ArchiveError(f"record identifier {uri!r} names no page")
    number = inner[len(ID_PREFIX) :]
    return int(number) if number else None


def parse(data: bytes) -> dict:
    """Check one record and take it apart: version, named fields, block length and digests, HTTP length."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("no WARC version line")
    named = fields(lines[1:], "WARC")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in named:
            raise ArchiveError(f"record without {need}")
    kind, length = named["warc-type"], int(named["content-length"])
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"record type {kind!r} is not expected")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    block = rest[:length]
    if named.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ArchiveError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    status, *more = http.split(b"\r\n")
    if not found or not status.startswith(b"HTTP/"):
        raise ArchiveError("block is no HTTP response")
    size = int(fields(more, "HTTP").get("content-length", -1))
    digest = named.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = kind == "revisit"
    if revisit and (payload or "warc-refers-to" not in named):
        raise ArchiveError("revisit with a payload or without a record that it refers to")
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError("payload differs from its length or digest")
    return {
        "page_id": page_number(named["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_number(named["warc-refers-to"]) if revisit else None,
        "url": named.get("warc-target-uri"),
        "payload": None if revisit else payload,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``digest_`` and ``first_`` (the page that a revisit refers to, else null) to ``page_id, url, payload_``.

    Groups of equal payloads are summed up per task before the shuffle, and only (identifier, digest) rows meet
    them; where one payload has a third of all rows, the sort-merge join can be split by Spark as nothing needs
    the rows of a payload together.
    """
    digest = F.sha2("payload_", 256)
    small = pages.select("page_id", digest.alias("digest_"), F.octet_length("payload_").alias("n_")).filter(F.col("n_") >= min_bytes)
    groups = small.groupBy("digest_").agg(F.min("page_id").alias("first_"), F.count(F.lit(1)).alias("copies_")).filter("copies_ > 1")
    later = small.join(groups, "digest_").filter("page_id > first_").select("page_id", "digest_", "first_").dropDuplicates()
    return pages.withColumn("digest_", digest).join(later, ["page_id", "digest_"], "left")


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", limit: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write one record per row to archives in ``folder``; returns the list of archives, ``path, bytes, records``.

    Every attempt of a task writes files of its own and only the list, written with Spark's commit, says which count,
    so a lost executor or a repeated task leaves no record twice. ``folder`` must be one that all executors reach.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), payload.alias("payload_"))
    few = rows.select("page_id", F.substring("payload_", 1, SAMPLE_BYTES).alias("s"))
    sample = sampling.sample_n(few, SAMPLE_PAGES, F.col("page_id")).collect()
    dictionary = spark.sparkContext.broadcast(train(sorted(bytes(r.s) for r in sample)))

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def open_archive():
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            return name, store.open_output_stream(name)

        def records():
            for b in slices(batches, "payload_"):
                yield from zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload_", "digest_", "first_")))

        for path, size, n in write_records(records(), dictionary.value, open_archive, limit):
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    marked = mark_revisits(rows).select("page_id", "url", "payload_", "digest_", "first_")
    return stored(marked.mapInArrow(write, "path string, bytes bigint, records bigint"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True, path_col: str = "path") -> DataFrame:
    """The records of the listed archives, one task per few archives, one frame in memory at a time.

    ``folder`` names the store; an archive or record that breaks the format fails the job with an ``ArchiveError``.
    """
    n = max(1, archives.count())
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(path_col).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path) as source:
                    for place, data in enumerate(read_frames(source)):
                        row = parse(data) | {"archive": path, "place": place}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 300
                        if size > 1 << 20:
                            yield as_batch(rows)
                            rows, size = [], 0
                yield as_batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)

    return archives.select(path_col).repartition(min(n, 10_000)).mapInArrow(read, RECORD_SCHEMA)


def archive_pages(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per page.

    Null payloads count as empty, null urls are left out, a null identifier is written as an empty one. Payloads under
    100 bytes are never revisits. Rows repeated with one identifier are all written; those with the smallest
    identifier of their payload are all responses. An empty table gives no archive and no rows; columns other than
    identifier, url and payload are ignored.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    archives = write_archives(pages, folder, **columns)
    return read_archives(archives, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
