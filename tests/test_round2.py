"""Results of one shape for every size, and rules that hold on both paths."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.operators import assemble, geometry, seams, sft, tasks
from pagemill.sources import readers

BOXES = "unit_id int, page_idx int, det_id int, cls_id int, score double, x1 double, y1 double, x2 double, y2 double, order_seq int"


@pytest.mark.parametrize("per_part", [2, 1024])
def test_merged_units_are_one_list(spark, per_part):
    rows = [(r, u, json.dumps({"u": u}), f"t{u}") for r, n in ((1, 5), (2, 1), (3, 2), (4, 4)) for u in range(n)]
    rows += [(5, u, json.dumps({"u": u}), f"t{u}") for u in (7, 9)]
    results = spark.createDataFrame(rows, "request_id int, unit_idx int, json string, markdown string")
    parts = assemble.merge_units(results, per_part).orderBy("request_id", "part_unit").collect()
    for request, units in ((1, range(5)), (2, [0]), (3, range(2)), (4, range(4)), (5, (7, 9))):
        own = [p for p in parts if p.request_id == request]
        whole = json.loads("".join(p.json_result for p in own))
        assert whole == ([{"u": u} for u in units] if len(units) > 1 else {"u": 0})
        assert "".join(p.markdown_result for p in own) == assemble.PAGE_BREAK.join(f"t{u}" for u in units)


@pytest.mark.parametrize("limit", [20, 2048])
def test_suppression_thresholds_hold_on_both_paths(spark, limit):
    rows = [(1, 0, k, k % 2, 1.0 - k / 100, 0.0, 0.0, 100.0, 100.0, k) for k in range(50)]
    boxes = spark.createDataFrame(rows, BOXES)
    assert geometry.nms(boxes, iou_same=1.5, iou_other=1.5, limit=limit).count() == 50
    assert geometry.nms(boxes, iou_same=0.5, iou_other=1.5, limit=limit).count() == 2
    assert geometry.nms(boxes, iou_same=0.5, iou_other=0.5, limit=limit).count() == 1
    with pytest.raises(ValueError, match="above 0"):
        geometry.nms(boxes, iou_same=0.0, limit=limit)


def test_regions_without_image_keep_empty_content(spark):
    image = [(1, 0, (4, 4, 1, bytearray(range(16))))]
    images = spark.createDataFrame(image, "unit_id int, page_idx int, image struct<height int, width int, nChannels int, data binary>")
    regions = spark.createDataFrame([(1, 0, 0, 0, 0, 500, 500), (2, 0, 0, 0, 0, 500, 500)], "unit_id int, page_idx int, idx int, bx1 int, by1 int, bx2 int, by2 int")
    got = {r.unit_id: r for r in seams.crop_regions(images, regions).collect()}
    assert bytes(got[1].data) == bytes([0, 1, 4, 5]) and got[2].content == "" and got[2].height is None


def test_empty_pages_of_a_response_stay(spark):
    def body(pages):
        return json.dumps({"layout_details": pages, "data_info": {"pages": [{"width": 100, "height": 100}] * 2}})

    region = {"index": 0, "label": "text", "content": "x", "bbox_2d": [0, 0, 50, 50]}
    rows = [(1, body([[], [region]])), (2, body([[]])), (3, "no json")]
    got = readers.read_service_response(spark.createDataFrame(rows, "unit_id int, response string")).collect()
    assert sorted((r.unit_id, str(r.page_idx), str(r.pos), str(r.content)) for r in got) == [
        (1, "0", "None", "None"), (1, "1", "0", "x"), (2, "0", "None", "None"), (3, "None", "None", "None")
    ]


def test_overlapping_folders_are_scanned_once(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/x.pdf", "a/b/y.png", "a/b/z.txt"):
        (tmp_path / name).write_bytes(b"%PDF-1.4")
    roots = [str(tmp_path / "a"), str(tmp_path / "a" / "b"), str(tmp_path / "a") + "/", str(tmp_path / "a" / "x.pdf")]
    found = [r.path.rsplit("/", 1)[1] for r in readers.scan_documents(spark, roots).select("path").collect()]
    assert sorted(found) == ["x.pdf", "y.png"]


def test_samples(spark, tmp_path):
    good = {"messages": [{"role": "user", "content": "<image>Text Recognition:"}, {"role": "assistant", "content": "x"}], "images": ["a/b.png"]}
    bad = [
        good | {"images": []},
        good | {"images": ["/a.png"]},
        good | {"images": ["s3://a.png"]},
        {"messages": [{"role": "system", "content": "x"}]},
        {"images": []},
        {"messages": [{"role": "user"}]},
    ]
    (tmp_path / "s.json").write_text(json.dumps([good, *bad]))
    got = [r.problem for r in sft.validate_sft(readers.read_conversations_sft(spark, str(tmp_path / "s.json"))).collect()]
    number, path = "image tags and images differ in number", "image path is not relative"
    assert got == [None, number, path, path, "unknown role", "no messages", None]


def test_total_is_not_a_missing_status(spark):
    rows = spark.createDataFrame([("a",), (None,), ("a",)], "status string")
    got = {(r.status, r.is_total): r.n for r in tasks.status_counts(rows).collect()}
    assert got == {("a", False): 2, (None, False): 1, (None, True): 3}


def test_boxes_without_extent_do_not_end_a_job(spark):
    from pagemill.functions import boxes

    one = spark.createDataFrame([(5.0, 0)], "v double, extent int")
    assert one.select(boxes.to_thousandths(F.col("v"), F.col("extent"))).first()[0] is None


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local-cluster[3,2,3000]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
