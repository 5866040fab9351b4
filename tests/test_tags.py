"""Image references of Markdown, against replacing them one after the other."""

from __future__ import annotations

import random
import re

from pagemill.operators import tags

REGION = "unit_id bigint, page_idx int, pos int, label string, bbox_2d array<int>"


def plain(markdown, regions, loaded):
    """Each region in turn replaces the first reference to its box."""
    paths, n = {}, 0
    for unit, page, pos, label, box in sorted(regions, key=lambda r: (r[1], r[2])):
        if label == "image" and box and (unit, page) in loaded:
            paths[page, pos] = f"imgs/cropped_page{page}_idx{n}.jpg"
            markdown = markdown.replace(f"![](page={page},bbox={box})", f"![Image {page}-{n}]({paths[page, pos]})", 1)
            n += 1
    return markdown, paths


def test_equal_references_in_any_order(spark):
    rng = random.Random(5)
    docs, regions = [], []
    loaded = {(u, p) for u in range(30) for p in range(4) if (u + p) % 4}
    for u in range(30):
        own = [(u, rng.randrange(5), pos, rng.choice(["image", "image", "text"]), rng.choice([[1, 2, 3, 4], [0, 0, 9, -9], None])) for pos in range(8)]
        boxes = [(p, box) for _, p, _, _, box in own if box]
        refs = [f"![](page={p},bbox={box})" for p, box in rng.choices(boxes, k=rng.randint(0, 12))] if boxes else []
        refs += ["![](page=99999999999999999999,bbox=[1, 2, 3, 4])", "![](page=0,bbox=[1,2,3,4])"]
        rng.shuffle(refs)
        docs.append((u, rng.choice(["", "a\n", "$1 \\"]) + " x ".join(refs)))
        regions += own
    docs += [(100, ""), (101, None), (102, "no reference")]
    out, with_path = tags.resolve_tags(
        spark.createDataFrame(docs, "unit_id bigint, markdown string"),
        spark.createDataFrame(regions, REGION),
        spark.createDataFrame(sorted(loaded), "unit_id bigint, page_idx int"),
    )
    got = {r.unit_id: r.markdown for r in out.collect()}
    paths = {(r.unit_id, r.page_idx, r.pos): r.image_path for r in with_path.collect()}
    assert len(paths) == len(regions) and [got[k] for k in (100, 101, 102)] == ["", None, "no reference"]
    for u, markdown in docs[:30]:
        expected, own = plain(markdown, [r for r in regions if r[0] == u], loaded)
        assert got[u] == expected
        assert {(p, k): v for (w, p, k), v in paths.items() if w == u and v} == own


def test_references_of_many_pages(spark):
    pages = [(1, p, 100 + p, 200) for p in range(3000)] + [(2, 0, 0, 10)]
    text = " and ".join(f"![](page={p},bbox=[{p}, 10,5,20])" for p in range(0, 3200, 100))
    docs = [(1, text), (2, "![](page=0,bbox=[1,2,3,4])"), (3, "![](page=0,bbox=[1,2,3,4]) ![](page=0,bbox=[1,2])"), (4, None)]
    out = tags.rewrite_references(
        spark.createDataFrame(docs, "unit_id bigint, markdown string"),
        spark.createDataFrame(pages, "unit_id bigint, page_idx int, width int, height int"),
    )
    got = {r.unit_id: r.markdown for r in out.collect()}
    size = {(u, p): (w, h) for u, p, w, h in pages}

    def scaled(m):
        p = int(m[1])
        if (1, p) not in size:
            return m[0]
        w, h = size[1, p]
        box = [int(v) for v in m[2].split(",")]
        return f"![](page={p},bbox={[round(v * 1000 / (w if k % 2 == 0 else h)) for k, v in enumerate(box)]})"

    assert got[1] == re.sub(r"!\[\]\(page=(\d+),bbox=\[([\d,\s]+)\]\)", scaled, text)
    assert [got[k] for k in (2, 3, 4)] == [d for _, d in docs[1:]]
