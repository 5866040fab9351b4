"""Language of a text by unigram models of word pieces, summed over all segmentations.

The pieces are the byte strings of a fixed public vocabulary, every single byte among them, so each word has at least one
segmentation. A language gives every piece a probability; the probability of a word is the sum, over all ways to cut it
into pieces, of the product of their probabilities, found by a forward pass over its bytes. A text is as likely as all its
words together. Words are runs of letters and their marks: digits, signs and junk say nothing about a language. The probabilities are fitted by expectation and maximisation on counted words, never on texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bpe import kept, read_vocabulary
from pagemill.llm.common import slices, stored

#: Documents of a language that its model is fitted on, chosen by a hash (about so many; all where there are fewer).
FIT_DOCS = 20_000
#: Rounds of expectation and maximisation; share of the pooled distribution in that of a language, and its weight besides in pieces.
ROUNDS, POOLED, SMOOTHING = 2, 0.1, 300.0
#: Longer words are cut into stretches of so many bytes for the fit, not for the scores.
FIT_BYTES = 24
#: Words that a worker remembers with their scores; words that a task counts before it passes them on.
MEMO_WORDS, COUNTED_WORDS = 300_000, 400_000
#: Forward passes run over so many numbers at a time, and are scaled every so many bytes.
WORK, RESCALE = 1 << 20, 12
#: Words in one lattice of the fit.
FIT_WORDS = 8192
WHITE = re.compile(rb"\s")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: The answer where a text is null, has no letter, or no language could be learned.
UNDECIDED = "und"


class Pieces:
    """The vocabulary as a trie whose edges lie in one sorted array."""

    def __init__(self, source: bytes):
        listed = dict.fromkeys(base64.b64decode(line.split()[0]) for line in source.splitlines() if line.strip())
        singles = [bytes([b]) for b in range(256)]
        # white space occurs in words as one space in front only
        self.pieces = [p for p in dict.fromkeys([*singles, *listed]) if len(p) == 1 or not WHITE.search(p.removeprefix(b" "))]
        node, accepts, edges = {b"": 0}, [-1], []
        for k, piece in enumerate(self.pieces):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in node:
                    node[piece[:n]] = len(accepts)
                    edges.append((node[piece[: n - 1]] << 8 | piece[n - 1], len(accepts)))
                    accepts.append(-1)
            accepts[node[piece]] = k
        by_key = np.array(sorted(edges), np.int64)
        self.keys, self.child, self.accepts = by_key[:, 0].copy(), by_key[:, 1].copy(), np.array(accepts, np.int64)
        self.longest = max(map(len, self.pieces))

    def matches(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and number of every piece that occurs in ``flat``, by start."""
        start, node = np.arange(len(flat)), np.zeros(len(flat), np.int64)
        found = []
        for n in range(1, self.longest + 1):
            inside = start + n <= len(flat)
            start, node = start[inside], node[inside]
            key = node << 8 | flat[start + n - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            start, node = start[there], self.child[at[there]]
            piece = self.accepts[node]
            ends = piece >= 0
            found.append((start[ends], np.full(int(ends.sum()), n, np.int64), piece[ends]))
            if not len(start):
                break
        start, size, piece = (np.concatenate(v) for v in zip(*found))
        order = np.argsort(start, kind="stable")
        return start[order], size[order], piece[order]


class Lattice:
    """All pieces of some words, ordered by the place in the word where they start; the longest words come first."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        flat = np.frombuffer(b"".join(words[k] + b"\n" for k in self.order), np.uint8).astype(np.int64)
        begin = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        start, self.size, self.piece = pieces.matches(flat)
        word = np.searchsorted(begin, start, side="right") - 1
        real = start - begin[word] < self.sizes[word]  # not the mark after a word
        word, start, self.size, self.piece = word[real], start[real], self.size[real], self.piece[real]
        place = start - begin[word]
        by = np.lexsort((word, place))
        self.word, self.place, self.size, self.piece = word[by], place[by], self.size[by], self.piece[by]
        self.cut = np.searchsorted(self.place, np.arange((int(self.sizes[0]) if len(words) else 0) + 1))

    def steps(self):
        for t in range(len(self.cut) - 1):
            yield t, slice(int(self.cut[t]), int(self.cut[t + 1]))

    def log_likelihoods(self, p: np.ndarray, longest: int) -> np.ndarray:
        """Logarithm of the sum over all segmentations, a row per word and a column per language (``p``: piece, language)."""
        rows, langs, ring = len(self.sizes), p.shape[1], longest + 1
        sums, scale = np.zeros((ring, rows, langs)), np.zeros((rows, langs))
        sums[0] = 1.0
        out = np.zeros((rows, langs))
        for t, e in self.steps():
            here = sums[t % ring]
            sums[(t + self.size[e]) % ring, self.word[e]] += here[self.word[e]] * p[self.piece[e]]
            here[:] = 0.0
            done = slice(*np.searchsorted(-self.sizes, [-(t + 1), -t]))
            out[done] = np.log(np.maximum(sums[(t + 1) % ring, done], 1e-300)) + scale[done]
            live = int(done.start)
            if t % RESCALE == RESCALE - 1 and live:
                most = sums[:, :live].max(axis=0)
                most[most <= 0] = 1.0
                sums[:, :live] /= most
                scale[:live] += np.log(most)
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def expected(self, p: np.ndarray, lang: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each language uses each piece, every segmentation weighted by its share; word ``k`` is of ``lang[k]``."""
        lang, times = lang[self.order], times[self.order]
        width = int(self.sizes[0]) + 1
        ahead, behind = np.zeros((width, len(self.sizes))), np.zeros((width, len(self.sizes)))
        ahead[0], behind[self.sizes, np.arange(len(self.sizes))] = 1.0, 1.0
        weight = p[self.piece, lang[self.word]]
        for t, e in self.steps():
            ahead[t + self.size[e], self.word[e]] += ahead[t, self.word[e]] * weight[e]
        for t, e in reversed(list(self.steps())):
            np.add.at(behind[t], self.word[e], weight[e] * behind[t + self.size[e], self.word[e]])
        share = ahead[self.place, self.word] * weight * behind[self.place + self.size, self.word] / np.maximum(behind[0, self.word], 1e-300)
        use = np.bincount(self.piece * p.shape[1] + lang[self.word], share * times[self.word], p.size)
        return use.reshape(p.shape)


@dataclass
class Model:
    """Languages in order of name, their share of the documents, and the probabilities (piece, language)."""

    langs: list[str]
    prior: np.ndarray
    p: np.ndarray


def word_scores(pieces: Pieces, model: Model, words: list[bytes]) -> np.ndarray:
    """Log-likelihood of each word, a leading space included, in each language."""
    out = np.zeros((len(words), len(model.langs)))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at_once = max(16, WORK // ((pieces.longest + 1) * len(model.langs)))
    for k in range(0, len(order), at_once):
        own = order[k : k + at_once]
        out[own] = Lattice(pieces, [words[j] for j in own]).log_likelihoods(model.p, pieces.longest)
    return out


def words_of(text: str) -> list[str]:
    """The runs of letters of a text."""
    return LETTERS.findall(text)


def spaced(words: list[str]) -> list[bytes]:
    """Words with the space before them that the vocabulary's pieces have."""
    return [b" " + w.encode() for w in words]


class Scorer:
    """Scores texts; remembers words in generations so that memory stays bounded."""

    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.model = pieces, model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Log of prior times likelihood of every text in every language."""
        words = [words_of(t) for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        new = list(set().union(*words).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, word_scores(self.pieces, self.model, spaced(new))])
        out = np.tile(np.log(self.model.prior), (len(texts), 1))
        for k, doc in enumerate(words):
            if doc:
                out[k] += self.scores[list(map(self.known.__getitem__, doc))].sum(axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        asked = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        names, sure = [UNDECIDED] * len(texts), [0.0] * len(texts)
        if asked and self.model.langs:
            z = self.log_odds([texts[k] for k in asked])
            z = np.exp(z - z.max(axis=1, keepdims=True))
            for k, best, share in zip(asked, z.argmax(axis=1).tolist(), (z.max(axis=1) / z.sum(axis=1)).tolist()):
                names[k], sure[k] = self.model.langs[best], share
        return names, sure


def remainder(id_col: str) -> Column:
    """Checksum of the identifier, written as text, modulo 4; no identifier counts as no characters."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def counted_words(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Uses of every word in every language: ``lang_, word_, n_``, summed up in the tasks before they are shuffled."""

    def count(batches):
        total: Counter = Counter()

        def rows():
            keys = list(total)
            batch = pa.RecordBatch.from_pydict(
                {
                    "lang_": pa.array([la for la, _ in keys], pa.string()),
                    "word_": pa.array([w for _, w in keys], pa.binary()),
                    "n_": pa.array([total[k] for k in keys], pa.int64()),
                }
            )
            total.clear()
            return batch

        for b in slices(batches, "text_"):
            for lang, text in zip(b.column("lang_").to_pylist(), b.column("text_").to_pylist()):
                for w in spaced(words_of(text)):
                    for k in range(0, len(w), FIT_BYTES):
                        total[lang, w[k : k + FIT_BYTES]] += 1
            if len(total) > COUNTED_WORDS:
                yield rows()
        yield rows()

    picked = docs.select(F.col(lang_col).alias("lang_"), F.col(text_col).alias("text_"))
    counted = picked.mapInArrow(count, "lang_ string, word_ binary, n_ bigint")
    return counted.groupBy("lang_", "word_").agg(F.sum("n_").alias("n_"))


def maximise(use: np.ndarray) -> np.ndarray:
    """Probabilities from uses; a language is smoothed by all languages together, those by one use of every piece."""
    pooled = use.sum(axis=1) + 1.0
    pooled /= pooled.sum()
    own = (use + SMOOTHING * pooled[:, None]) / (use.sum(axis=0) + SMOOTHING)
    return (1 - POOLED) * own + POOLED * pooled[:, None]


def fit(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_docs: int = FIT_DOCS,
    rounds: int = ROUNDS,
) -> Model:
    """Fit a model for every value of ``lang_col`` from about ``fit_docs`` documents of each.

    The driver sees a row per language and, in each round, a number per language and piece; the size of both depends on
    the number of languages and on the vocabulary, not on the documents.
    """
    spark = docs.sparkSession
    source, key = read_vocabulary(spark, path)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col) != 2))
    share = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(share)
    n_pieces = len(kept(f"pieces{key}", lambda: Pieces(source.value)).pieces)
    if not langs:
        return Model([], np.zeros(0), np.zeros((n_pieces, 0)))
    shares = [(la, min(1.0, fit_docs / share[la])) for la in langs]
    chance = spark.createDataFrame(shares, "lang_ string, chance_ double")
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    # a row per language, far smaller than the model that every task holds; a shuffle of texts by language is spared
    chosen = known.join(F.broadcast(chance), known[lang_col] == chance["lang_"]).filter(draw < F.col("chance_")).drop("lang_", "chance_")
    words = stored(counted_words(chosen.select(lang_col, text_col), lang_col, text_col))
    number = {la: k for k, la in enumerate(langs)}
    p = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches):
            pieces = kept(f"pieces{key}", lambda: Pieces(source.value))
            use = np.zeros(shared.value.shape)
            for b in batches:
                for part in (b.slice(k, FIT_WORDS) for k in range(0, b.num_rows, FIT_WORDS)):
                    word, lang, times = (part.column(c).to_pylist() for c in ("word_", "lang_", "n_"))
                    lang = np.array([number[la] for la in lang], np.int64)
                    use += Lattice(pieces, word).expected(shared.value, lang, np.array(times, float))
            piece, lang = np.nonzero(use)
            yield pa.RecordBatch.from_pydict({"piece_": piece, "lang_": lang, "use_": use[piece, lang]})

        found = words.mapInArrow(expect, "piece_ bigint, lang_ bigint, use_ double")
        table = found.groupBy("piece_", "lang_").agg(F.sum("use_").alias("use_")).toArrow()
        use = np.zeros(p.shape)
        use[table.column("piece_").to_numpy(), table.column("lang_").to_numpy()] = table.column("use_").to_numpy()
        p = maximise(use)
        shared.unpersist()
    counts = np.array([share[la] for la in langs], float)
    return Model(langs, counts / counts.sum(), p)


def identify(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None
) -> DataFrame:
    """Predict the language of every document: ``doc_id, held_out, lang_pred, score``.

    The model is fitted on documents with a language whose checksum modulo 4 is not 2, unless one is given; a prediction
    reads nothing but the whole text. ``score`` is the share of the predicted language in the sum over all of them.
    Null texts, and texts without a letter, give ``und`` with score 0, and so does every text where no language could be
    learned. Ties go to the language first in order. Languages may be any strings, the empty one included. Rows without
    identifier count as not held out. Repeated rows get equal predictions, an empty table gives no rows, other columns
    are ignored.
    """
    source, key = read_vocabulary(docs.sparkSession, path)
    model = model or fit(docs, path, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = hashlib.sha256(repr((key, model.langs)).encode() + model.prior.tobytes() + model.p.tobytes()).hexdigest()

    def run(batches):
        # words that a worker has met in an earlier task are known already
        scorer = kept(f"scorer{own}", lambda: Scorer(kept(f"pieces{key}", lambda: Pieces(source.value)), shared.value))
        for b in slices(batches, "text_"):
            names, sure = scorer.predict(b.column("text_").to_pylist())
            arrays = [b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (remainder(id_col) == 2).alias("held_out"), F.col(text_col).alias("text_"))
    return picked.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
