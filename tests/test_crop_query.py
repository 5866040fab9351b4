"""The crop query over the whole text of every document."""

from __future__ import annotations

import hashlib
import time

import numpy as np

from pagemill.operators import seams
from pagemill.plans import catalog
from pagemill.plans.fixtures import Inputs

SF = "/root/testdata/sf0.001"


def test_crops_are_cut_from_whole_texts(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    regions = Inputs(spark, SF).regions().select("unit_id", "page_idx", "idx", "bx1", "by1", "bx2", "by2").collect()
    expected = {}
    for r in regions:
        raw = texts[r.unit_id]
        height = max(1, -(-len(raw) // 32))
        pixels = np.frombuffer(raw.ljust(height * 32, bytes(1)), np.uint8).reshape(height, 32, 1)
        try:
            cut = seams.crop_array(pixels, [r.bx1, r.by1, r.bx2, r.by2], [(r.bx1, r.by1), (r.bx2, r.by1), (r.bx2, r.by2)])
            expected[r.unit_id, r.page_idx, r.idx] = (*cut.shape[:2], hashlib.md5(cut.tobytes()).hexdigest())
        except Exception:
            expected[r.unit_id, r.page_idx, r.idx] = (None, None, None)
    got = catalog.QUERIES["crop_regions"](spark, SF).collect()
    assert {(r.unit_id, r.page_idx, r.idx): (r.height, r.width, r.digest) for r in got} == expected
    assert len(got) == len(regions)


def test_crops_of_many_pages_leave_a_task_together(spark):
    def crops(n):
        pages = spark.range(n).selectExpr("id as unit_id", "0 as page_idx", "named_struct('height', 2, 'width', 4, 'nChannels', 1, 'data', encode('abcdefgh', 'utf-8')) as image")
        regions = spark.range(n + 1).selectExpr("id as unit_id", "0 as page_idx", "7 as idx", "0 as bx1", "0 as by1", "if(id % 2 = 0, 500, null) as bx2", "1000 as by2")
        return seams.crop_regions(pages, regions).selectExpr("unit_id", "idx", "height", "width", "nChannels", "string(data) as data", "content").collect()

    crops(10)
    start = time.time()
    got = {r.unit_id: tuple(r)[1:] for r in crops(10_000)}
    seconds = time.time() - start
    lost = (7, None, None, None, None, "")
    assert len(got) == 10_001 and all(got[k] == ((7, 2, 2, 1, "abef", None) if k % 2 == 0 else lost) for k in range(10_000))
    assert got[10_000] == lost  # a page without image
    assert seconds < 6, seconds  # a frame of its own for each page took more
