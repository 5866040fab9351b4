"""Content sort and Hilbert shards."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

from pagemill.llm import catalog, sharding
from pagemill.llm.exact_dedup import content_sort
from pagemill.llm.sharding import hilbert_index, hilbert_shards, write_shards

SF = "/root/testdata/sf0.001"


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    return {
        (i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in rows
    }


def test_content_sort_cases(spark, documents):
    rows = [(i, "same", "en", "a") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, "Same", "en", "b"), (103, "x" * 200_000, "en", "b")]
    rows += [(104, "x" * 200_000, "en", "b"), (105, "é", "fr", "b"), (106, "é", "fr", "b")]
    got = content_sort(documents(rows, "piece_"))
    assert {tuple(r) for r in got.collect()} == brute_groups(rows)
    assert content_sort(documents([])).count() == 0


def test_content_sort_repeated_rows(documents):
    got = content_sort(documents([(1, "a", "en", "s"), (1, "a", "en", "s"), (None, "a", "en", "s")])).collect()
    assert [r.kept for r in got].count(True) == 1
    assert {r.keep_id for r in got} == {1}
    assert {r.group_size for r in got} == {3}


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    index = hilbert_index(cells, 3)
    assert sorted(index) == list(range(side**3))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, got, n_shards):
    sizes = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == sizes
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(n_shards)) and len(got) == len(rows)
    full = [counts.get(s, 0) for s in range(n_shards)]
    assert max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    along = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)
    assert {r.law for r in got} <= {"rows"} and {r.grown_shard for r in got} <= {None}


def test_shards(spark, documents, tmp_path):
    rows = [(i, "word " * (i % 17), ("en", "fr", None)[i % 3], f"src{i % 5}") for i in range(203)]
    rows += [(300, None, None, None), (301, "", "en", None), (302, "y" * 100_000, "de", "src1")]
    df = documents(rows, "shard")
    got = hilbert_shards(df, 40)
    check_shards(rows, got.collect(), 40)
    write_shards(df.drop("shard"), hilbert_shards(df, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert hilbert_shards(documents([])).count() == 0
    check_shards(rows[:3], hilbert_shards(documents(rows[:3]), 40).collect(), 40)


def test_shard_query_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_shards(docs, catalog.QUERIES["op7_hilbert_shards"](spark, SF).collect(), 40)


def test_cuts_of_values_with_a_common_start(spark):
    """Whole values are compared, so that sources with one start lie in different cells."""
    names = [f"https://example.org/crawl/{k:03d}" for k in range(60)]
    counts = [1 + (k * 7) % 11 + (400 if k == 20 else 0) for k in range(60)]
    values = [n for n, c in zip(names, counts) for _ in range(c)]
    rows = spark.createDataFrame([(v.encode(),) for v in values] + [(None,)] * 5, "v binary").repartition(3)
    for cells in (2, 8, 32):
        expected, upto = [], 0
        for n, c in zip(names, counts):
            if (upto + c) * cells // len(values) > upto * cells // len(values):
                expected.append(n.encode())
            upto += c
        assert sharding.value_cuts(rows, "v", cells) == expected[: cells - 1]
    assert sharding.value_cuts(rows.limit(0), "v", 8) == []


def test_files_can_be_pruned_by_long_sources(documents):
    rows = [(i, f"text {i}", "en", f"https://example.org/crawl/{i % 16:03d}") for i in range(1600)]
    got = sharding.hilbert_shards(documents(rows), n_shards=32).collect()
    held = {}
    for r in got:
        held.setdefault(r.shard, set()).add(r.doc_id % 16)
    assert len(got) == 1600 and max(map(len, held.values())) <= 4
