"""Quality classifier by co-training a text view and a metadata view; a second target, toxicity, is trained alike."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import eq, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import plain_names, slices, stored
from pagemill.operators import sampling

#: Bound of the labelled documents that the classifiers are fitted on, drawn by a hash of the identifier.
LABELLED = 6000
#: Rounds of co-training; pseudo-labelled documents, about, that a view hands to the other in a round, drawn by a hash from
#: all documents of the corpus that it is sure of; how sure it must be.
ROUNDS, HANDED, SURE = 3, 600, 0.95
#: Share of the labelled documents that is kept back to calibrate the views, and to see of which classes a view is sure
#: rightly; of so many documents kept back it must be.
HELD_OUT, TRIED = 0.3, 3
#: Documents less likely to be good than this, or more likely to be toxic, are rejected.
THRESHOLD, TOXIC = 0.5, 0.3
#: Word stems whose number is a feature: those that part the labelled toxic documents best from the others; letters of a
#: stem, and labelled documents that must have it.
TELLING, STEM, STEM_DOCS = 48, 5, 5
BIGRAM_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS, SIZE_BUCKETS = 64, 24, 8, 12
#: Bytes that are counted at a time: the arrays of a part are tens of times as large as its bytes.
PART = 1 << 15
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".,;:'\"-()?", "!", "|", "#$%&*+<=>@\\^_`~{}[]/")
KIND = np.full(256, len(GROUPS), np.int64)  # other bytes: letters beyond ASCII, control characters
for _k, _chars in enumerate(GROUPS):
    KIND[[ord(c) for c in _chars]] = _k


#: Marks and digits become spaces before words are looked for.
SPACES = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})


def word_features(texts: list[str], words: tuple[str, ...]) -> np.ndarray:
    """A row per text: the logarithm of how many of its words begin with each of ``words``, stems of ``STEM`` letters."""
    out = np.zeros((len(texts), len(words)))
    place = {w: k for k, w in enumerate(words)}
    for k, t in enumerate(texts if words else ()):
        stems = Counter([w[:STEM] for w in t.lower().translate(SPACES).split()])
        for w in stems.keys() & place.keys():
            out[k, place[w]] = stems[w]
    return np.log1p(out)


def text_features(texts: list[str]) -> np.ndarray:
    """A row per text: shares of kinds of bytes, shape of words and lines, repetition, hashed pairs of bytes."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat, stop = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
    kinds = len(GROUPS) + 1
    shares, pairs = np.zeros((n, kinds), np.int64), np.zeros((n, BIGRAM_BUCKETS), np.int64)
    for start in range(0, len(flat), PART):
        part = flat[start : start + PART + 1].astype(np.int64)  # the byte behind the part ends its last pair
        doc = np.searchsorted(stop, np.arange(start, start + len(part)), side="right")
        first, last = doc[0], doc[-1] + 1
        doc -= first
        own = slice(0, PART)
        shares[first:last] += np.bincount((doc * kinds + KIND[part])[own], minlength=(last - first) * kinds).reshape(-1, kinds)
        bucket = (part[:-1] * 31 + part[1:] * 17) % BIGRAM_BUCKETS
        inside = doc[1:] == doc[:-1]
        pairs[first:last] += np.bincount((doc[:-1] * BIGRAM_BUCKETS + bucket)[inside], minlength=(last - first) * BIGRAM_BUCKETS).reshape(-1, BIGRAM_BUCKETS)
    shares = shares / np.maximum(size, 1)[:, None]
    pairs = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])
    shape = np.zeros((n, 5))
    for k, t in enumerate(texts):
        words = t.split()
        if words:
            w = len(words)
            shape[k] = len(set(words)) / w, sum(map(eq, words, words[1:])) / w, size[k] / w / 10, (t.count("\n") + 1) / w, 1 / w
    return np.hstack([shares, shape, pairs])


def hashed(value: str | None, buckets: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (buckets - 1)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """A row per document: hashed language and source, length as a bucket of powers of two."""
    out = np.zeros((len(lang), LANG_BUCKETS + SOURCE_BUCKETS + SIZE_BUCKETS + 1))
    for k, (la, so, n) in enumerate(zip(lang, source, n_chars)):
        out[k, hashed(la, LANG_BUCKETS)] = 1
        out[k, LANG_BUCKETS + hashed(so, SOURCE_BUCKETS)] = 1
        bits = max(0, min(SIZE_BUCKETS - 1, int(n or 0).bit_length() - 4))
        out[k, LANG_BUCKETS + SOURCE_BUCKETS + bits] = 1
        out[k, -1] = np.log1p(max(0, n or 0)) / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights (the last one is the constant) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class View:
    """One classifier: standardisation, weights, and the line that calibrates its scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale < 1e-9, 1.0, scale)
        return View(mean, scale, fit_logistic((x - mean) / scale, y, ridge))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's line on documents kept back, with targets drawn in from 0 and 1."""
        good, bad = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        self.slope, self.shift = fit_logistic(self.margin(x)[:, None], target, 1e-3)
        if self.slope <= 0:  # a view that has learned nothing says no more than the prior
            self.slope, self.shift = 0.0, float(np.log((good + 1) / (bad + 1)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -35, 35)


@dataclass
class Model:
    """Two calibrated views, or only ``prior`` when the labels lack one of the classes."""

    prior: float
    views: tuple[View, View] | None

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the target by text, by metadata, and by both taken as independent given the class."""
        if self.views is None:
            flat = np.full(len(x_text), sigmoid(np.array(self.prior)))
            return flat, flat, flat
        a, b = self.views[0].log_odds(x_text), self.views[1].log_odds(x_meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


class Student:
    """A target that two views learn together; ``otherwise`` is what holds where the labels lack one of the classes."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, otherwise: float = 1.0, seed: int = 1):
        self.good = float(y.mean()) if len(y) else otherwise
        self.teachable = len(y) >= 10 and 0 < self.good < 1
        if not self.teachable:
            return
        order = np.random.default_rng(seed).permutation(len(y))
        n_back = max(5, int(HELD_OUT * len(y)))
        back, front = order[:n_back], order[n_back:]
        if len(set(y[front])) < 2 or len(set(y[back])) < 2:
            back = front = order
        self.own = [(text[front], y[front]), (meta[front], y[front])]
        self.back = [(text[back], y[back]), (meta[back], y[back])]
        self.taken: set = set()

    def views(self) -> list[View]:
        return [View.fit(*o) for o in self.own]

    def teachers(self) -> list[tuple[View, list[int]]]:
        """The views, each with the classes it may hand over: those it is sure of rightly on the documents kept back."""
        out = []
        for view, (x, y) in zip(self.views(), self.back):
            label = sure_of(view, x)
            right = [(label == c).sum() >= TRIED and (y[label == c] == c).mean() >= SURE for c in (0, 1)]
            out.append((view, [c for c in (0, 1) if right[c]]))
        return out

    def learn(self, ids: list, text: np.ndarray, meta: np.ndarray, view: np.ndarray, label: np.ndarray) -> None:
        """Take documents that ``view`` is sure of into the training set of the other view, each document once."""
        new = np.array([k for k, i in enumerate(ids) if not (i in self.taken or self.taken.add(i))], np.int64)
        for mine, pool in ((0, meta), (1, text)):
            k = new[view[new] == mine]
            x, y = self.own[1 - mine]
            self.own[1 - mine] = np.vstack([x, pool[k]]), np.concatenate([y, label[k]])

    def model(self) -> Model:
        if not self.teachable:
            return Model(35.0 if self.good > 0 else -35.0, None)
        views = self.views()
        for view, held in zip(views, self.back):
            view.calibrate(*held)
        return Model(float(np.log(self.good / (1 - self.good))), (views[0], views[1]))


def sure_of(view: View, x: np.ndarray, classes: tuple | list = (0, 1)) -> np.ndarray:
    """1 or 0 where the view is sure of that class, one of ``classes``, else -1."""
    p = sigmoid(view.margin(x))
    label = np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))
    return np.where(np.isin(label, classes), label, -1)


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, seed: int = 1
) -> Model:
    """Train both views on arrays; in each round each hands the documents of the pool that it is sure of to the other."""
    student = Student(text, meta, y, seed=seed)
    for _ in range(rounds if student.teachable else 0):
        for mine, ((view, classes), pool) in enumerate(zip(student.teachers(), (pool_text, pool_meta))):
            label = sure_of(view, pool, classes)
            k = np.flatnonzero(label >= 0)
            student.learn(k.tolist(), pool_text[k], pool_meta[k], np.full(len(k), mine), label[k].astype(float))
    return student.model()


@dataclass
class Judge:
    """The fitted targets, and the beginnings of words that are counted."""

    quality: Model
    toxic: Model
    words: tuple[str, ...]

    def scores(self, b: pa.RecordBatch, text_col: str = "text_") -> list[np.ndarray]:
        """Quality by text, by metadata and by both, and toxicity by both."""
        return self.of_features(*both_features(b, self.words, text_col))

    def of_features(self, x: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1] - len(self.words)
        return [*self.quality.scores(x[:, :n], m), self.toxic.scores(x, m)[2]]


def inputs(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The columns that both views read; metadata that a table lacks counts as null."""
    meta = {"lang": "string", "source": "string", "n_chars": "bigint"}
    return [
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text_"),
        *((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(f"{c}_") for c, k in meta.items()),
    ]


def both_features(b: pa.RecordBatch, words: tuple[str, ...] = (), text_col: str = "text_") -> tuple[np.ndarray, np.ndarray]:
    """Features of the text (null: empty), those of words last, and of the metadata."""
    meta = (b.column(c).to_pylist() for c in ("lang_", "source_", "n_chars_"))
    texts = [t or "" for t in b.column(text_col).to_pylist()]
    return np.hstack([text_features(texts), word_features(texts, words)]), meta_features(*meta)


def labelled_sample(labels: DataFrame, id_col: str) -> DataFrame:
    """At most ``LABELLED`` documents with ``quality_`` and ``toxic_``, 0, 1 or null; a label of 1 wins over one of 0."""
    targets = [
        F.max((F.col(c) > 0).cast("double")).alias(f"{c}_") if c in labels.columns else F.lit(None).cast("double").alias(f"{c}_")
        for c in ("quality", "toxic")
    ]
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(*targets)
    return sampling.sample_n(known.filter("quality_ is not null or toxic_ is not null"), LABELLED, F.col("doc_id"))


def telling_words(texts: DataFrame) -> tuple[str, ...]:
    """The first letters of words of labelled texts (``text_, toxic_``) that raise the odds of toxicity most surely."""
    judged = texts.filter("toxic_ is not null")
    words = judged.select("toxic_", F.explode(F.array_distinct(F.transform(F.split(F.lower("text_"), r"[^\p{L}]+"), lambda w: F.substring(w, 1, STEM)))).alias("word")).filter("word <> ''")
    total = judged.agg(F.count("*").alias("n"), F.sum("toxic_").alias("bad")).first()
    bad, fine = float(total.bad or 0), float(total.n - (total.bad or 0))
    counts = words.groupBy("word").agg(F.sum("toxic_").alias("a"), F.sum(1 - F.col("toxic_")).alias("b")).filter(F.col("a") + F.col("b") >= STEM_DOCS)
    odds = F.log((F.col("a") + 0.5) / (bad - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (fine - F.col("b") + 0.5))
    sure = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    return tuple(r.word for r in counts.orderBy(F.desc(sure), "word").limit(TELLING).collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Judge:
    """The targets as :func:`fitted` fits them."""
    return fitted(docs, labels, id_col, text_col, rounds)[0]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Judge, DataFrame]:
    """Targets and the stored features, fitted on at most ``LABELLED`` labelled documents; pseudo-labels come from scores of all documents.

    The features of all documents are computed once and stored. In each round every document is scored by every view, and
    of those that a view is sure of about ``HANDED`` of each class, fewer of the rarer one, go to the other view. Only
    labelled and handed documents reach the driver.
    """
    spark = docs.sparkSession
    sample = stored(labelled_sample(labels, id_col))
    rows = docs.select(*inputs(docs, id_col, text_col)).join(F.broadcast(sample), "doc_id", "left")  # at most LABELLED rows
    words = telling_words(rows.filter("quality_ is not null or toxic_ is not null"))

    def features(batches):
        for b in slices(batches, "text_"):
            x, m = (a.astype(np.float32) for a in both_features(b, words))
            packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, m)]
            names = ["doc_id", "quality_", "toxic_"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *packed], names=[*names, "x", "m"])

    seen = stored(rows.mapInArrow(features, "doc_id bigint, quality_ double, toxic_ double, x binary, m binary"))
    chosen = seen.filter("quality_ is not null or toxic_ is not null").groupBy("doc_id").agg(F.min(F.struct("quality_", "toxic_", "x", "m")).alias("r"))
    known = sorted(chosen.select("doc_id", "r.*").collect(), key=lambda r: r.doc_id)  # repeated rows count once
    students = {}
    for target, otherwise in (("quality", 1.0), ("toxic", 0.0)):
        own = [r for r in known if r[f"{target}_"] is not None]
        x, m = (unpacked([r[c] for r in own]) for c in ("x", "m"))
        x = x if target == "toxic" else x[:, : x.shape[1] - len(words)]
        students[target] = Student(x, m, np.array([r[f"{target}_"] for r in own]), otherwise)
    for turn in range(rounds):
        teach(spark, seen, {t: s for t, s in students.items() if s.teachable}, len(words), turn)
    return Judge(students["quality"].model(), students["toxic"].model(), words), seen


def unpacked(blobs: list[bytes]) -> np.ndarray:
    if not blobs:
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(float)


def teach(spark, seen: DataFrame, students: dict[str, Student], n_words: int, turn: int) -> None:
    """One round: every view of every target scores all documents without a label and hands some it is sure of on."""
    if not students:
        return
    names = sorted(students)
    shared = spark.sparkContext.broadcast({t: students[t].teachers() for t in names})

    def sure(batches):
        for b in batches:
            x, m = (unpacked(b.column(c).to_pylist()) for c in ("x", "m"))
            for number, target in enumerate(names):
                free = b.column(f"{target}_").is_null().to_numpy(zero_copy_only=False)
                views = shared.value[target]
                for mine, own in enumerate((x if target == "toxic" else x[:, : x.shape[1] - n_words], m)):
                    label = sure_of(views[mine][0], own, views[mine][1])
                    k = pa.array(np.flatnonzero(free & (label >= 0)))
                    kind = number * 4 + mine * 2 + label[k.to_numpy()]
                    arrays = [pa.array(kind, pa.int32()), *(b.column(c).take(k) for c in ("doc_id", "draw_", "x", "m"))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["kind_", "doc_id", "draw_", "x", "m"])

    draw = F.pmod(F.xxhash64("doc_id", F.lit(100 + turn)), F.lit(1 << 30)) / float(1 << 30)
    scored = seen.withColumn("draw_", draw).mapInArrow(sure, "kind_ int, doc_id bigint, draw_ double, x binary, m binary")
    counts = {r[0]: r[1] for r in scored.groupBy("kind_").count().collect()}

    def chance(kind: int) -> float:
        good = students[names[kind // 4]].good
        return 2 * HANDED * (good if kind % 2 else 1 - good) / counts[kind]

    wanted = [(F.col("kind_") == kind) & (F.col("draw_") < chance(kind)) for kind in counts]
    if not wanted:
        return
    rows = sorted(scored.filter(reduce(or_, wanted)).collect(), key=lambda r: (r.kind_, r.draw_, r.doc_id or 0, r.x, r.m))
    for number, target in enumerate(names):
        own = [r for r in rows if r.kind_ // 4 == number]
        if own:
            x, m, kind = unpacked([r.x for r in own]), unpacked([r.m for r in own]), np.array([r.kind_ for r in own])
            x = x if target == "toxic" else x[:, : x.shape[1] - n_words]
            students[target].learn([r.doc_id for r in own], x, m, kind // 2 % 2, (kind % 2).astype(float))
    shared.unpersist()


def verdict(scores: list[np.ndarray], threshold: float, toxic: float) -> np.ndarray:
    return (scores[2] >= threshold) & (scores[3] <= toxic)


SCORED = "doc_id bigint, p_text double, p_meta double, quality double, toxic double, kept boolean"


def scored_batch(b: pa.RecordBatch, found: list[np.ndarray], threshold: float, toxic: float) -> pa.RecordBatch:
    arrays = [pa.array(v) for v in (*found, verdict(found, threshold, toxic))]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", "p_text", "p_meta", "quality", "toxic", "kept"])


def score(docs: DataFrame, judge: Judge, threshold: float = THRESHOLD, toxic: float = TOXIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents where they lie: ``doc_id, p_text, p_meta, quality, toxic, kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        for b in slices(batches, "text_"):
            yield scored_batch(b, shared.value.scores(b), threshold, toxic)

    return docs.select(*inputs(docs, id_col, text_col)).mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, judge: Judge, threshold: float = THRESHOLD, toxic: float = TOXIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document is not rejected.

    Null texts are judged as empty ones, null identifiers do not matter here. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    own, (text_,) = plain_names(docs, text_col)
    names = own.columns

    def run(batches):
        for b in slices(batches, text_):
            kept = b.filter(pa.array(verdict(shared.value.scores(b, text_), threshold, toxic)))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names=names)

    # the text goes to the Python step once, as the own column that it is
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names)), *inputs(docs, id_col, text_col)[2:])
    return rows.mapInArrow(run, own.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, toxic: float = TOXIC, **options) -> DataFrame:
    """Fit on ``labels`` and score all of ``docs`` by the features that the fit has stored.

    Null texts count as empty, null or missing metadata as a value of their own; other columns are ignored. Without at
    least ten labels of both classes nothing can be learned of a target: all documents get the score of the one class
    there is (good and not toxic when there is none). Labels that contradict each other for one document count as good,
    and as toxic. Repeated rows get equal scores, an empty table gives no rows.
    """
    judge, seen = fitted(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, m = (unpacked(b.column(c).to_pylist()) for c in ("x", "m"))
                yield scored_batch(b, shared.value.of_features(x, m), threshold, toxic)

    return seen.select("doc_id", "x", "m").mapInArrow(run, SCORED)
