"""Files: documents, progress, results, images."""

from __future__ import annotations

import itertools
import json
import re
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.functions import source
from pagemill.operators import pages, seams
from pagemill.sources import readers, sinks
from pagemill.sources.document_files import read_document_files, write_document_pages
from pagemill.streaming import streams


def png(width: int, height: int) -> bytes:
    """Grey image whose pixel values count upwards."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes((y * width + x) % 251 for x in range(width)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.PNG").write_bytes(png(20, 10))
    (tmp_path / "in" / "deep" / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "notes.txt").write_text("no document")
    return tmp_path


def test_scan(spark, folder):
    found = readers.scan_documents(spark, [str(folder / "in"), str(folder / "in" / "deep")])
    assert sorted((r.path.rsplit("/", 1)[1], r.kind) for r in found.collect()) == [("a.PNG", "image/png"), ("b.pdf", "application/pdf")]
    (folder / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.scan_documents(spark, str(folder / "empty"))


def test_stream_of_documents(spark, folder):
    stream = streams.stream_documents(spark, str(folder / "in"), 1).select("path", "kind")
    assert streams.run_available(stream).count() == 2


def test_progress_files(spark, tmp_path):
    (tmp_path / "w1.json").write_text(json.dumps({"completed": 3, "total": 5, "failed": 1, "status": "done", "timestamp": 1.5}))
    (tmp_path / "w2.json").write_text("{broken")
    rows = {r.worker: r.completed for r in readers.read_progress(spark, str(tmp_path)).collect()}
    assert rows == {"w1": 3, "w2": None}


def test_document_files(spark, tmp_path):
    rows = [("sub", "a:b", 0, 0, "[[]]", None, "text"), ("", "c", 0, 0, "[]", "[1]", "  "), ("", "c", 4, 1, "[2]", None, "more")]
    df = spark.createDataFrame(rows, "rel_dir string, stem string, part_page int, part_seq int, json_text string, raw_json string, markdown string")
    for _ in range(2):  # writing again leaves the same files
        sinks.write_documents(df, str(tmp_path))
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert names == [
        "c/c.000004.000001.json", "c/c.000004.000001.md", "c/c.json", "c/c_model.json", "sub/a_b/a_b.json", "sub/a_b/a_b.md"
    ]


PAGES = "unit_id bigint, rel_dir string, stem string, page_idx int, fragment int, page_json string, raw_json string, page_text string"


def test_one_file_per_document(spark, tmp_path):
    region = lambda k: json.dumps({"index": k, "content": f"é {k}"})
    rows = [(1, "long", "a", p, 0, f"[{region(p)}]", None, f"page {p}") for p in range(3000)]
    crowded = [(1, "long", "a", 1500, f, "[" + ",".join(region(k) for k in range(f * 1000, f * 1000 + 1000)) + "]", None, f"piece {f}") for f in range(1, 5)]
    rows += crowded
    rows += [(2, None, "b", 0, 0, "[]", None, ""), (2, None, "b", 3, 0, "[]", None, " \n"), (3, "", "c", 0, 0, "[]", None, None)]
    rows += [(3, "", "c", 1, 0, None, '[{"x": 1}]', "text"), (3, "", "c", 1, 1, "[]", '[{"x": 2}]', "more"), (3, "", "c", 7, 0, "[]", None, "end")]
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # writing again leaves the same files
        write_document_pages(df, out)
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix in (".json", ".md"))
    assert names == ["b/b.json", "c/c.json", "c/c.md", "c/c_model.json", "long/a/a.json", "long/a/a.md"]
    pages = json.loads((tmp_path / "out/long/a/a.json").read_text())
    assert len(pages) == 3000 and [r["index"] for r in pages[1500]] == [1500, *range(1000, 5000)] and pages[7][0]["content"] == "é 7"
    text = (tmp_path / "out/long/a/a.md").read_text()
    assert text.startswith("page 0\n\npage 1\n\n") and "page 1500\n\npiece 1\n\npiece 2" in text and text.endswith("page 2999")
    assert json.loads((tmp_path / "out/b/b.json").read_text()) == [[], []]
    assert json.loads((tmp_path / "out/c/c_model.json").read_text()) == [[], [{"x": 1}, {"x": 2}], []]
    assert (tmp_path / "out/c/c.md").read_text() == "\n\ntext\n\nmore\n\nend"
    assert (tmp_path / "out/_SUCCESS").exists() and not list((tmp_path / "out/_temporary").iterdir())
    failing = df.withColumn("page_text", F.when(F.col("page_idx") == 2000, F.raise_error(F.lit("stop"))).otherwise(F.col("page_text")))
    with pytest.raises(Exception, match="stop"):
        write_document_pages(failing, f"{tmp_path}/failed")
    assert not (tmp_path / "failed/_SUCCESS").exists() and not (tmp_path / "failed/long").exists()


def test_files_are_read_by_the_lists_of_their_writers(spark, tmp_path):
    out = f"file://{tmp_path}/my out"
    rows = [(k, f"part {k % 3}", f"doc {k}", p, 0, f"[{k}]", None, " " if k % 5 else f"é {p}") for k in range(40) for p in range(2)]
    df = spark.createDataFrame([*rows, (90, None, "x", 0, 0, "[]", None, None)], PAGES)
    for _ in range(2):
        write_document_pages(df.repartition(3), out)
    files = read_document_files(spark, out)
    assert "BinaryFile" not in (plan := files._jdf.queryExecution().toString()) and "Relation [value" not in plan
    assert files.count() == 41 and len(files.inputFiles()) <= 2 * 4  # two lists of a writing task at most, not 49 files
    got = {r.unit_id: (r.rel_dir, r.stem, r.json, r.md) for r in files.collect()}
    assert got[10] == ("part 1", "doc 10", "[[10],[10]]", "é 0\n\né 1") and got[90] == (None, "x", "[[]]", None)
    assert all(got[k][3] is None for k in range(40) if k % 5)
    (tmp_path / "my out/part 1/doc 10/doc 10.json").unlink()
    with pytest.raises(Exception, match="doc 10.json"):
        read_document_files(spark, out).collect()


def test_documents_are_written_in_slices(spark, tmp_path):
    from pagemill.sources import document_files

    rows = [(k, f"part {(k or 0) % 3}", f"doc {k}", p, 0, f"[{p}]", None, f"text {p}") for k in [None, *range(60)] for p in range(2)]
    df = spark.createDataFrame(rows, PAGES)
    before = spark.conf.get(document_files.CLEANUP)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: disk.getAllFiles().mkString(" ").count(".data")
    held = shuffled()
    for n, out in ((1, f"{tmp_path}/one"), (4, f"{tmp_path}/four")):
        write_document_pages(df, out, n)
        until = time.time() + 20
        while shuffled() > held and time.time() < until:
            time.sleep(0.2)
        assert shuffled() <= held  # no shuffle file stays
    assert all(read_document_files(spark, f"{tmp_path}/{d}").count() == 61 for d in ("one", "four"))
    kinds = ("*.json", "*.md", "_SUCCESS")
    one, four = ({str(p.relative_to(d)): p.read_text() for k in kinds for p in d.rglob(k)} for d in (tmp_path / "one", tmp_path / "four"))
    assert one == four and len(one) == 123
    assert spark.conf.get(document_files.CLEANUP) == before
    failing = df.withColumn("page_text", F.when(F.col("unit_id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("page_text")))
    with pytest.raises(Exception, match="stop"):
        write_document_pages(failing, f"{tmp_path}/failed", 4)
    assert not (tmp_path / "failed/_SUCCESS").exists() and spark.conf.get(document_files.CLEANUP) == before


def test_image_numbers_shuffle_no_content(spark):
    from pagemill.plans.documents import document_pages

    rows = [(1, p, k, "image" if k % 2 else "text", f"word {p} {k}", k, 2, 3, 4) for p in range(2) for k in range(4)]
    regions = spark.createDataFrame(rows, "unit_id bigint, page_idx int, idx int, native_label string, content string, bx1 int, by1 int, bx2 int, by2 int")
    got = document_pages(regions, regions.select("unit_id", "page_idx").distinct(), regions.where("native_label = 'image'"))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    nodes = [(m.end(), line) for line in plan if (m := re.match(r"[ :]*[+:]- ", line))]
    at = next(k for k, (_, line) in enumerate(nodes) if "ArrowEvalPython" in line)
    below = [line for depth, line in itertools.takewhile(lambda n: n[0] > nodes[at][0], nodes[at + 1 :])]
    # the repairs shuffle behind this step; a shuffle in front of it would write all content once more
    assert below and not any("Exchange" in line for line in below), below
    texts = [r.page_text for r in got.orderBy("page_idx").collect()]
    assert texts[1] == "word 1 0\n\n![Image 1-2](imgs/cropped_page1_idx2.jpg)\n\nword 1 2\n\n![Image 1-3](imgs/cropped_page1_idx3.jpg)", texts


def test_pages_of_any_size(spark):
    from pagemill.plans.documents import document_pages

    rows = [(1, p, k, "text", f"word {p} {k}", 1, 2, 3, 4) for p, n in ((0, 2), (2, 5000)) for k in range(n)]
    regions = spark.createDataFrame(rows, "unit_id bigint, page_idx int, idx int, native_label string, content string, bx1 int, by1 int, bx2 int, by2 int")
    pages = spark.createDataFrame([(1, p) for p in range(3)], "unit_id bigint, page_idx int")
    got = document_pages(regions, pages).orderBy("page_idx", "fragment").collect()
    assert [(r.page_idx, r.fragment) for r in got] == [(0, 0), (1, 0), (2, 0), (2, 1)]
    assert [r["index"] for part in got[2:] for r in json.loads(part.page_json)] == list(range(5000))
    assert got[1].page_json == "[]" and got[1].page_text == "" and got[0].page_text == "word 0 0\n\nword 0 1"


def test_crops(spark, folder):
    image = spark.read.format("image").load(str(folder / "in" / "a.PNG"))
    images = image.select(F.lit(1).cast("bigint").alias("unit_id"), F.lit(0).alias("page_idx"), "image")
    rows = [(1, 0, 0, 100, 200, 500, 800, None), (1, 0, 1, 0, 0, 1000, 1000, [[0, 0], [1000, 0], [0, 1000]]), (1, 0, 2, 900, 0, 100, 1000, None)]
    regions = spark.createDataFrame(rows, "unit_id bigint, page_idx int, idx int, bx1 int, by1 int, bx2 int, by2 int, polygon array<array<int>>")
    cut = {r.idx: r for r in seams.crop_regions(images, regions, use_polygon=True).collect()}
    channels = cut[0].nChannels
    assert (cut[0].height, cut[0].width) == (6, 8)
    assert cut[0].data[0] == (2 * 20 + 2) % 251
    assert cut[1].data[0] == 0 and cut[1].data[-channels] == 255  # white beyond the diagonal
    assert cut[2].content == "" and cut[2].data is None


def test_base64_kinds(spark):
    values = ["QUJD" * 40, "QUJD" * 31, "QUJD" * 40 + "Q", "QUJD" * 40 + "QU", "a/" + "b" * 200 + ".png", "QU JD\n" * 40]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = [r.kind for r in df.select("k", source.classify_source(F.col("v")).alias("kind")).orderBy("k").collect()]
    assert got == ["base64", "path", "path", "base64", "path", "base64"]


def test_limits(spark):
    df = spark.createDataFrame([(1, p) for p in range(5)], "unit_id bigint, page_idx int")
    assert [pages.limit_pages(df, n).count() for n in (2, 9, 0, -1, None, "x", "3")] == [2, 5, 5, 5, 5, 5, 3]
    with pytest.raises(KeyError):
        pages.run_mode("unheard of", df)
