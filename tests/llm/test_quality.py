"""Co-training by held-out accuracy."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import catalog, quality
from pagemill.llm.quality import classify, co_train, fit, keep_good, score

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    scored = classify(docs, labels.filter(half))
    assert scored.count() == docs.count()
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    right = [(r.quality >= 0.5) == bool(truth[r.doc_id][0]) for r in scored.join(labels.filter(~half).select("doc_id"), "doc_id").collect()]
    clean = [r.kept for r in scored.collect() if truth.get(r.doc_id) == (1, 0)]
    assert np.mean(right) > 0.92 and np.mean(clean) > 0.98  # 0.998 and 0.999 with the 4,000 labels of a larger table


def test_toxic_documents_are_rejected(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = classify(docs, labels.filter(half)).join(labels.filter(~half).select("doc_id", F.col("quality").alias("good"), F.col("toxic").alias("bad")), "doc_id").collect()
    assert np.mean([not r.kept for r in rows if r.bad]) > 0.93  # 0.947 with half of the labels
    assert np.mean([r.kept for r in rows if r.good and not r.bad]) > 0.99


def plain_logistic(x, y, ridge, steps=4000):
    """Ridge regression by damped gradient steps on standardised columns, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    curve = 0.25 * np.linalg.eigvalsh(x.T @ x).max() + ridge
    last, speed = w.copy(), 1.0
    for _ in range(steps):  # Nesterov's method
        ahead = w + (speed - 1) / (speed + 2) * (w - last)
        last, speed = w, speed + 1
        p = 1 / (1 + np.exp(-(x @ ahead)))
        w = ahead - (x.T @ (p - y) + penalty * ahead) / curve
    return w


def test_scores_against_a_plain_fit(spark, monkeypatch):
    """Without pseudo-labels the scores are those of two plain regressions, Platt's lines and their sum."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in score(docs, fit(docs, labels, rounds=0)).collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    truth = {r.doc_id: float(r.quality > 0) for r in labels.collect()}
    raw = [quality.text_features([r.text for r in rows]), quality.meta_features([r.lang for r in rows], [r.source for r in rows], [r.n_chars for r in rows])]
    known = [k for k, r in enumerate(rows) if r.doc_id in truth]
    y = np.array([truth[rows[k].doc_id] for k in known])
    order = np.random.default_rng(1).permutation(len(y))
    back, front = order[: max(5, int(0.3 * len(y)))], order[max(5, int(0.3 * len(y))) :]
    logits = []
    for x in raw:
        own = x.astype(np.float32).astype(float)[known]
        mean, scale = own[front].mean(axis=0), own[front].std(axis=0)
        scale[scale < 1e-9] = 1.0
        w = plain_logistic((own[front] - mean) / scale, y[front], 1.0)
        margin = np.clip((x - mean) / scale, -20, 20) @ w[:-1] + w[-1]
        good, bad = y[back].sum(), (1 - y[back]).sum()
        target = np.where(y[back] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        slope, shift = plain_logistic(margin[known][back][:, None], target, 1e-3, 20_000)
        logits.append(slope * margin + shift if slope > 0 else np.full(len(margin), np.log((good + 1) / (bad + 1))))
    both = logits[0] + logits[1] - np.log(y.mean() / (1 - y.mean()))
    for k, r in enumerate(rows):
        for name, z in (("p_text", logits[0][k]), ("p_meta", logits[1][k]), ("quality", both[k])):
            assert abs(got[r.doc_id][name] - 1 / (1 + np.exp(-z))) < 0.01


def test_pseudo_labels_teach_the_other_view():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 3000).astype(float)
    a = rng.normal(size=(3000, 4)) + 2.5 * y[:, None]
    b = rng.normal(size=(3000, 30)) + 0.6 * y[:, None]
    few, pool, test = slice(0, 40), slice(40, 2000), slice(2000, 3000)
    accuracy = {}
    for rounds in (0, 4):
        m = co_train(a[few], b[few], y[few], a[pool], b[pool], rounds)
        accuracy[rounds] = np.mean((m.scores(a[test], b[test])[1] > 0.5) == y[test])
    assert accuracy[4] > accuracy[0]
    combined = m.scores(a[test], b[test])
    assert np.mean((combined[2] > 0.5) == y[test]) >= np.mean((combined[1] > 0.5) == y[test])


def test_cases(spark, documents):
    rows = [(i, "Good prose of some words. " * 5, "en", "s") for i in range(20)] + [(50 + i, "%%% ### $$$ !!! " * 5, "en", "s") for i in range(20)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, "a" * 300_000, "en", "s"), (1, rows[1][1], "en", "s")]
    df = documents(rows, "text_x")
    labels = spark.createDataFrame([(i, int(i < 50), 0) for i, *_ in rows if i < 100] + [(7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in classify(df, labels).collect()}
    assert all(got[i].kept == (i < 50) for i in got if i < 100)
    kept = keep_good(df, fit(df, labels))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(20))
    assert all(r.kept for r in classify(df, labels.limit(0)).collect())
    assert all(r.kept for r in classify(df, labels.filter("quality = 1")).collect())
    assert classify(documents([]), labels).count() == 0
    bare = df.select("doc_id", "text")
    assert classify(bare, labels).count() == len(rows)


def test_query_covers_the_table(spark):
    got = catalog.QUERIES["op9_co_training"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.filter("quality between 0 and 1").count() == 200


def test_long_texts_are_counted_in_parts(monkeypatch):
    tracemalloc.start()
    try:
        quality.text_features(["x" * 4_000_000])
        assert tracemalloc.get_traced_memory()[1] < 6 * 4_000_000  # arrays of the whole text took 43 times its bytes
    finally:
        tracemalloc.stop()
    rng = np.random.default_rng(3)
    texts = ["", "a", "é" * 40, "".join(rng.choice(list("ab É!|#\n"), 500)), "", "x y\n" * 9]
    whole = quality.text_features(texts)
    for part in (1, 7, 64):
        monkeypatch.setattr(quality, "PART", part)
        assert np.array_equal(quality.text_features(texts), whole)
