"""Repairs on label sequences, against plain loops, and with chunked order."""

from __future__ import annotations

import random
import re

import pytest

from pagemill.operators import assemble, repair
from pagemill.operators.ordering import ChunkedOrder, WindowOrder, global_rank, number_in_document
from pagemill.plans.documents import documents

SCHEMA = (
    "unit_id bigint, page_idx int, idx int, native_label string, label string, content string, bx1 int, by1 int, bx2 int, by2 int"
)
ORDERS = [WindowOrder(["unit_id", "page_idx"], "idx"), ChunkedOrder(["unit_id", "page_idx"], "idx", chunk=3)]
FORMULA, NUMBER, TEXT = ("display_formula", "formula"), ("formula_number", "text"), ("text", "text")


def regions(spark, pages):
    rows = [
        (1, p, k, native, label, content, left, 0, left + 10, 10)
        for p, page in enumerate(pages)
        for k, (native, label, content, left) in enumerate(page)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def contents(df):
    pages: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.page_idx, r.idx)):
        assert r.idx == len(pages.setdefault(r.page_idx, []))
        pages[r.page_idx].append(r.content)
    return pages


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize(
    ("kinds", "wanted"),
    [
        ("FN", ["f0#1"]), ("NF", ["f1#0"]), ("NFN", ["f1#0"]), ("FNF", ["f0#1", "f2"]), ("NNF", ["f2#1"]),
        ("FFN", ["f0", "f1#2"]), ("FTN", ["f0", "t1"]), ("N", []), ("TFNNFT", ["t0", "f1#2", "f4#3", "t5"]),
        ("FNFNN", ["f0#1", "f2#3"]), ("NFNFNF", ["f1#0", "f3#2", "f5#4"]),
    ],
)
def test_formula_numbers(spark, order, kinds, wanted):
    make = {"F": lambda k: (*FORMULA, f"$$\nf{k}\n$$", 0), "N": lambda k: (*NUMBER, f"({k})", 0), "T": lambda k: (*TEXT, f"t{k}", 0)}
    got = contents(repair.merge_formula_numbers(regions(spark, [[make[c](k) for k, c in enumerate(kinds)]]), order))
    shown = [f"$$\n{w.split('#')[0]} \\tag{{{w.split('#')[1]}}}\n$$" if "#" in w else (f"$$\n{w}\n$$" if w[0] == "f" else w) for w in wanted]
    assert got.get(0, []) == shown


def test_number_joins_formula_without_closing_line(spark):
    rows = regions(spark, [[(*FORMULA, "x", 0), (*NUMBER, "(1)", 0)]])
    assert contents(repair.merge_formula_numbers(rows)) == {0: ["x"]}


def walk_hyphens(page):
    """The rule as one walk over the page."""
    gone, out = set(), []
    for i, block in enumerate(page):
        if i in gone:
            continue
        text = block[2]
        if block[1] == "text" and text.rstrip().endswith("-"):
            for j in range(i + 1, len(page)):
                after = page[j][2].lstrip()
                if page[j][1] == "text" and after and after[0].islower():
                    head, tail = text.rstrip()[:-1].split(), after.split()
                    word = (head[-1] + tail[0]).lower() if head and tail else ""
                    if re.fullmatch(r"[a-z][a-z'\-]{2,30}", word) and "--" not in word and "''" not in word:
                        text = text.rstrip()[:-1] + after
                        gone.add(j)
                    break
        out.append(text)
    return out


@pytest.mark.parametrize("order", ORDERS)
def test_hyphens_against_a_walk(spark, order):
    rng = random.Random(5)
    words = ["inter-", "national", "Upper", "ab-", "cd-", "x9-", "- ", "lower end-", "  next", "É-", "émoi", "don-"]
    pages = [
        [(*rng.choice([TEXT, TEXT, TEXT, ("table", "table")]), rng.choice(words), 0) for _ in range(rng.randint(1, 14))]
        for _ in range(60)
    ]
    got = contents(repair.merge_hyphenated(regions(spark, pages), order))
    assert got == {p: walk_hyphens(page) for p, page in enumerate(pages)}


def test_hyphens_with_lexicon(spark):
    rows = regions(spark, [[(*TEXT, "inter-", 0), (*TEXT, "national", 0)], [(*TEXT, "foo-", 0), (*TEXT, "bar", 0)]])
    lexicon = spark.createDataFrame([("international", 4.0), ("foobar", 1.0)], "word string, zipf double")
    assert contents(repair.merge_hyphenated(rows, lexicon=lexicon)) == {0: ["international"], 1: ["foo-", "bar"]}


@pytest.mark.parametrize("order", ORDERS)
def test_bullets(spark, order):
    pages = [
        [(*TEXT, "- a", 0), (*TEXT, "b", 10), (*TEXT, "- c", 5)],
        [(*TEXT, "- a", 0), (*TEXT, "b", 11), (*TEXT, "- c", 5)],
        [(*TEXT, "- a", 0), ("doc_title", "text", "b", 0), (*TEXT, "- c", 0)],
        [(*TEXT, "- a", 0), (*TEXT, "b", 0)],
    ]
    got = contents(repair.infill_bullets(regions(spark, pages), order))
    assert [page[1] for page in got.values()] == ["- b", "b", "b", "b"]


def test_formatter_keeps_images_and_drops_blanks(spark):
    rows = regions(spark, [[("chart", "", None, 0), ("text", "", "  ", 0), ("text", "", "a\nb", 0), ("header", "", None, 0)]])
    got = repair.format_regions(rows.drop("label")).orderBy("idx").collect()
    assert [(r.label, r.content) for r in got] == [("image", None), ("text", "a\n\nb")]


def whole(parts):
    text: dict[int, str] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.unit_id, r.part_page, r.part_seq)):
        text[r.unit_id] = text.get(r.unit_id, "") + r.markdown
    return text


def test_parts_add_up_to_the_document(spark, monkeypatch):
    from pagemill import config

    rng = random.Random(3)
    rows, pages, crops = [], [], []
    for unit in range(3):
        for page in range(7):
            pages.append((unit, page, 100, 100))
            for k in range(rng.choice([0, 1, 3, 12])):
                native = rng.choice(["text", "text", "image", "table", "display_formula", "formula_number"])
                rows.append((unit, page, k, native, None if native == "image" else rng.choice(["a-", "bcd", "- x", ""]), k, 0, 9, 9))
                if native == "image" and rng.random() < 0.7:
                    crops.append((unit, page, k, 0, 9, 9))
    schema = "unit_id bigint, page_idx int, idx int, native_label string, content string, bx1 int, by1 int, bx2 int, by2 int"
    regions_df = spark.createDataFrame(rows, schema)
    pages_df = spark.createDataFrame(pages, "unit_id bigint, page_idx int, width int, height int")
    crops_df = spark.createDataFrame(crops, "unit_id bigint, page_idx int, bx1 int, by1 int, bx2 int, by2 int")
    plain = whole(documents(regions_df, pages_df, crops_df))
    assert whole(documents(regions_df, pages_df, crops_df, pages_per_part=2)) == plain
    monkeypatch.setattr(config, "REGIONS_PER_FRAGMENT", 4)
    assert whole(documents(regions_df, pages_df, crops_df, limit=6, pages_per_part=3)) == plain


def test_empty_pages_keep_their_separator(spark):
    rows = regions(spark, [[(*TEXT, "a", 0)], [], [(*TEXT, "b", 0)]])
    pages = spark.createDataFrame([(1, p, 10, 10) for p in range(3)] + [(2, 0, 10, 10)], "unit_id bigint, page_idx int, width int, height int")
    assert whole(documents(rows.drop("label"), pages)) == {1: "a\n\n\n\nb", 2: ""}


def test_equal_boxes_share_a_crop(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "image", None, 1, 1, 5, 5), (1, 0, 1, "image", None, 1, 1, 5, 5), (1, 1, 0, "chart", None, 2, 2, 5, 5)],
        "unit_id bigint, page_idx int, idx int, native_label string, content string, bx1 int, by1 int, bx2 int, by2 int",
    )
    crops = spark.createDataFrame([(1, 0, 1, 1, 5, 5), (1, 0, 1, 1, 5, 5), (1, 1, 2, 2, 5, 5)], "unit_id bigint, page_idx int, bx1 int, by1 int, bx2 int, by2 int")
    got = assemble.matched_crops(rows, crops).orderBy("page_idx", "idx").collect()
    assert [r.image_no for r in got] == [0, 1, 2]


def test_numbers_without_a_window_over_everything(spark):
    rows = spark.createDataFrame([(u, p, k) for u in (1, 2) for p in range(9) for k in range(3)], "unit_id bigint, page_idx int, idx int")
    got = number_in_document(rows, "n", start=1).orderBy("unit_id", "page_idx", "idx").collect()
    assert [r.n for r in got] == list(range(1, 28)) * 2
    names = spark.createDataFrame([(f"{k:03d}",) for k in range(200)], "path string").repartition(7)
    ranked = global_rank(names, ["path"], "at").collect()
    assert sorted((r["at"], r["path"]) for r in ranked) == [(k, f"{k:03d}") for k in range(200)]


def test_only_words_of_lines_are_shuffled(spark):
    from pagemill.plans.catalog.document_queries import _parted_words

    lines = spark.createDataFrame([(1, 0, " an over-  "), (1, 1, "\tLap of"), (1, 2, ""), (1, 3, "x"), (2, 4, "y")], "doc_id bigint, pos int, line string")
    words = _parted_words(lines)
    assert sorted(r.word for r in words.collect()) == ["of", "over-lap", "x"]
    above, _, below = words._jdf.queryExecution().optimizedPlan().toString().partition("Join Inner")
    assert "regexp_extract" not in above and below.count("Project") >= 2


def test_common_lines_are_found_without_a_count_per_line(spark):
    from pagemill.operators.content import cut_repeated_lines

    same, most = "\n".join(["a"] * 12), "\n".join(["b", *["z", " z", "z "] * 4, "a"])
    rows = [(1, same), (2, most), (3, "\n".join(["a", "b"] * 10)), (4, "\n \n"), (5, None), (6, "\n".join(["q"] * 9))]
    cut = cut_repeated_lines(spark.createDataFrame(rows, "id int, c string"), "c")
    assert {r.id: r.c for r in cut.collect()} == dict(rows) | {1: "a", 2: "b\nz"}
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "aggregate(" not in plan


def test_common_line_is_looked_for_once_in_a_text(spark):
    from pagemill.operators.content import cut_repeated_lines

    df = spark.createDataFrame([(1, "\n".join(["line"] * 4000 + ["end"])), (2, "\n".join(map(str, range(4000))))], "id int, c string")
    plan = cut_repeated_lines(df, "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(sort_array" in plan and ".line = sort_array" not in plan, plan
    assert {r.id: len(r.c) for r in cut_repeated_lines(df, "c").collect()} == {1: 4, 2: 18889}
