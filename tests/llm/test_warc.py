"""WARC archives: exact round trips and broken files."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard

from pagemill.llm.warc import (
    DICTIONARY_MAGIC,
    ArchiveError,
    archive_pages,
    parse,
    read_archives,
    read_dictionary,
    read_frames,
    record,
    train,
    write_archives,
    write_records,
)


def brute(rows):
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and first[html or ""] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>copy</p>" * 20) for i in range(40)]
    rows += [(100, None, None), (101, "http://h/é", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "é" * 200_000)]
    rows += [(105, "u", "x" * 100), (106, "u", "x" * 100), (107, "u", "x" * 99), (108, "u", "x" * 99), (109, "u", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest_ string")
    assert sorted(map(tuple, archive_pages(spark, pages).collect()), key=lambda r: r[0]) == brute(rows)
    folder = f"file://{tmp_path}/archives"
    archives = write_archives(pages, folder, limit=2_000)
    assert archives.count() > 2
    got = {r.page_id: r for r in read_archives(archives, folder).collect()}
    assert bytes(got[104].payload) == ("é" * 200_000).encode() and got[1].payload is None
    assert got[101].url == "http://h/é" and got[100].url is None
    assert archive_pages(spark, pages.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "u", "y" * 120), (1, "u", "y" * 120), (2, "u", "y" * 120), (2, "u", "y" * 120), (None, "u", "y" * 120)]
    got = archive_pages(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [
        ("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("None", "response", None)
    ]


def archive(records, dictionary=b"some words of a dictionary " * 20):
    out = io.BytesIO()
    out.close = lambda: None
    list(write_records(iter(records), dictionary, lambda: ("a", out)))
    return out.getvalue()


def test_format_and_faults():
    body = b"<html>" + b"words of a page " * 50
    digest = hashlib.sha256(body).hexdigest()
    data = archive([(1, "u", body, digest, None), (2, "u", body, digest, 1)])
    assert struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC
    one, two = map(parse, read_frames(io.BytesIO(data)))
    assert one["payload"] == body and two["refers_to"] == 1 and two["payload_bytes"] == len(body)
    packed = zstandard.compress(b"inner dictionary")
    assert read_dictionary(io.BytesIO(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)) == b"inner dictionary"
    for broken in (b"", data[:20], b"\0" * 50, data[:-5], data[:-40] + b"\1" * 40):
        with pytest.raises(ArchiveError):
            list(read_frames(io.BytesIO(broken)))
    good = record(1, "u", body, digest, None)
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9"),
        good.replace(b"words", b"WORDS"),
        good[:-1],
        good.replace(b"WARC-Date", b"WARC-Dote"),
        good.replace(b"response\r\n", b"request\r\n", 1),
        good.replace(digest.encode(), b"0" * 64),
    ):
        with pytest.raises(ArchiveError):
            parse(bad)
    assert train([]) == b"" and len(train([b"x" * 100])) <= 100
