"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words."""

from __future__ import annotations

import hashlib
import json
import mmap
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cache, cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex as LibraryRegex
from tokenizers import Tokenizer, pre_tokenizers

from pagemill.llm.common import slices, stored

#: Words in the lexicon: a fixed bound, whatever the corpus.
LEXICON_WORDS = 200_000
#: Steps of the histogram of uses for each doubling of them.
LEVELS = 32
#: Chunks between white space that a worker remembers; then only those met again since then stay. Bounds its memory.
MEMO_CHUNKS = 400_000
NO_PAIR = 1 << 62
#: Bytes from which a word is merged by a heap.
LONG_WORD = 200
MARKS = frozenset(".,;:!?)")
#: White space of Python that is no white space of Unicode.
SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


class NewerCharacters:
    """Characters that this Python's Unicode tables do not know; the tokenizers library may."""

    def __init__(self):
        self.unknown = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])

    def search(self, text: str) -> bool:
        """Whether ``text`` has one; they are never printable, so most words need no look at the table."""
        if text.isprintable():
            return False
        return bool(self.unknown[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


@cache
def newer_characters() -> NewerCharacters:
    return NewerCharacters()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and text rules of a word-end BPE tokenizer file."""

    def __init__(self, source: bytes):
        data = json.loads(source)
        self.source = source
        model = data["model"]
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: Rank and result of each pair of ids, the rank in front so that the smallest number is the next merge.
        self.pairs = {(self.ids[a], self.ids[b]): k << 32 | self.ids[a + b] for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [self.ids[c] for c in symbols]
        self.last = [self.ids[c + self.end] for c in symbols]
        splits = [p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        split = splits[0]
        self.library_split = pre_tokenizers.Split(LibraryRegex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.any_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def chunks(self, text: str) -> list[str]:
        """Normalised runs between white space of a text without special tokens."""
        if not text.isascii():
            if newer_characters().search(text):
                return [c for c in WHITE.split(self.library.normalizer.normalize_str(text)) if c]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered by itself
        text = text.lower()
        if SEPARATORS.search(text):
            return [c for c in WHITE.split(text) if c]
        return text.split()

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; letters, with or without one mark at their end, need no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        if not chunk.isascii() and newer_characters().search(chunk):
            return [w for w, _ in self.library_split.pre_tokenize_str(chunk)]
        return self.words.findall(chunk)

    @cached_property
    def library(self) -> Tokenizer:
        """The library's tokenizer: it normalises texts with characters that are newer than the tables here."""
        return Tokenizer.from_str(self.source.decode())

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact BPE of one word: the pair of lowest rank, the leftmost on ties, is merged until none is left."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        rank = self.pairs.get
        waiting = list(map(rank, zip(ids, ids[1:]), repeat(NO_PAIR)))
        while waiting:
            best = min(waiting)
            if best == NO_PAIR:
                break
            i = waiting.index(best)
            ids[i] = merged = best & 0xFFFFFFFF
            del ids[i + 1], waiting[i]
            if i:
                waiting[i - 1] = rank((ids[i - 1], merged), NO_PAIR)
            if i < len(waiting):
                waiting[i] = rank((merged, ids[i + 1]), NO_PAIR)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges by a heap over linked symbols, so that time stays near the length of the word."""
        rank, n = self.pairs.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p, i) for i, p in enumerate(map(rank, zip(ids, ids[1:]))) if p is not None]
        heapify(heap)
        while heap:
            p, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank((ids[i], ids[j])) != p:
                continue  # one of the two has been merged since
            ids[i], ids[j] = p & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank((ids[x], ids[y]))) is not None:
                    heappush(heap, (q, x))
        return tuple(i for i in ids if i >= 0)


class Lexicon:
    """A minimal acyclic transducer from words to ids, read from one memory-mapped buffer.

    Words that end alike share their states. An arc carries how many words sort before those it leads to,
    so the outputs along a path add up to the number of the word, and its ids are a run of one array.
    """

    def __init__(self, data):
        head = np.frombuffer(data, np.int64, 4)
        n_arcs, n_states, n_words, n_ids = map(int, head)
        at = head.nbytes

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += -(-a.nbytes // 8) * 8
            return a

        self.key, self.target, self.before = take(np.uint32, n_arcs), take(np.int32, n_arcs), take(np.int32, n_arcs)
        self.final = take(np.uint8, n_states)
        self.start, self.ids = take(np.int32, n_words + 1), take(np.int32, n_ids)

    @staticmethod
    def compile(words: dict[str, tuple[int, ...]]) -> bytes:
        """The buffer for ``words``. Sorted words are added one by one; a finished branch is replaced by an equal one."""
        entries = sorted((w.encode(), ids) for w, ids in words.items())
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, state), ...))

        def close(node: list) -> int:
            form = (node[0], tuple(node[1]))
            if form not in register:
                register[form] = len(states)
                states.append(form)
            return register[form]

        path: list[list] = [[0, []]]  # open nodes along the last word: [final, arcs]
        last = b""
        for word, _ in entries:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            path.extend([0, []] for _ in word[same:])
            path[-1][0] = 1
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        root = close(path[0])
        count: list[int] = []
        arcs = []
        for s, (final, out) in enumerate(states):  # a state is closed after those it leads to
            n = final
            for byte, to in out:
                arcs.append((s << 8 | byte, to, n))
                n += count[to]
            count.append(n)
        shift = {root: 0, 0: root}  # the root becomes state 0
        arcs = sorted((shift.get(k >> 8, k >> 8) << 8 | k & 255, shift.get(to, to), n) for k, to, n in arcs)
        final = np.array([s[0] for s in states], np.uint8)
        final[[0, root]] = final[[root, 0]]
        ids = [i for _, ids in entries for i in ids]
        start = np.cumsum([0, *(len(ids) for _, ids in entries)])
        out = [np.array([len(arcs), len(states), len(entries), len(ids)], np.int64).tobytes()]
        a = np.array(arcs, np.int64).reshape(-1, 3)
        for x in (a[:, 0].astype(np.uint32), a[:, 1].astype(np.int32), a[:, 2].astype(np.int32), final, start.astype(np.int32), np.array(ids, np.int32)):
            out.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
        return b"".join(out)

    def find(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """Ids of each word, or None; all words take their k-th step together."""
        if not words or not len(self.key):
            return [None] * len(words)
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        state, number = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        alive = np.arange(len(raw))
        for k in range(int(size.max())):
            go = alive[size[alive] > k]
            if not len(go):
                break
            key = (state[go] << 8 | flat[start[go] + k]).astype(np.uint32)
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[arc] == key
            state[go] = np.where(hit, self.target[arc], -1)
            number[go] += self.before[arc]
            alive = alive[state[alive] >= 0]
        found = np.zeros(len(raw), bool)
        found[alive] = self.final[state[alive]] == 1
        lo, hi = self.start[np.where(found, number, 0)], self.start[np.where(found, number, 0) + 1]
        return [tuple(self.ids[a:b].tolist()) if ok else None for ok, a, b in zip(found.tolist(), lo.tolist(), hi.tolist())]


def mapped(data: bytes):
    """``data`` as a read-only memory map of a file without a name, which goes with the process."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Encoder:
    """Turns texts into token ids; remembers chunks and words that it has met, up to a bound.

    ``render`` gives what is kept for a word or a special token, from its ids, and ``combine`` what is kept for a
    chunk, from that of its words.
    """

    def __init__(
        self,
        vocabulary: Vocabulary,
        lexicon: Lexicon | None,
        render: Callable[[tuple[int, ...]], object],
        combine: Callable[[list], object],
        merge: Callable[[str], tuple[int, ...]] | None = None,
    ):
        self.vocabulary, self.lexicon, self.render, self.combine = vocabulary, lexicon, render, combine
        self.merge = merge or vocabulary.merge
        self.memo: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.words: dict[str, object] = {}
        self.special = {t: render((i,)) for t, i in vocabulary.special.items()}

    def pieces(self, text: str) -> list[str]:
        """The chunks of a text; special tokens stand for themselves, marked by a leading space."""
        v = self.vocabulary
        if "<|" not in text or v.any_special is None:
            return v.chunks(text)
        out: list[str] = []
        for part in v.any_special.split(text):
            out.extend([" " + part] if part in v.special else v.chunks(part))
        return out

    def learn(self, chunks: Iterable[str]) -> None:
        new = set(chunks).difference(self.memo)
        again = new.intersection(self.older)
        self.memo.update((c, self.older[c]) for c in again)
        new -= again
        if not new:
            return
        if len(self.words) > MEMO_CHUNKS:
            self.words = {}
        known, split = self.words, self.vocabulary.split
        words = {c: split(c) for c in new if c[0] != " "}
        unknown = list(set(chain.from_iterable(words.values())).difference(known))
        for w, ids in zip(unknown, self.lexicon.find(unknown) if self.lexicon else repeat(None)):
            known[w] = self.render(self.merge(w) if ids is None else ids)
        for c in new:
            if c[0] == " ":
                self.memo[c] = self.special[c[1:]]
            else:
                own = words[c]
                self.memo[c] = known[own[0]] if len(own) == 1 else self.combine([known[w] for w in own])

    def encode(self, texts: list[str]) -> list[list]:
        """What is kept for the chunks of each text, in order."""
        cut = [self.pieces(t) for t in texts]
        if len(self.memo) > MEMO_CHUNKS:
            self.older, self.memo = self.memo, {}
        self.learn(chain.from_iterable(cut))
        get = self.memo.__getitem__
        return [list(map(get, c)) for c in cut]


_KEPT: dict = {}


def kept(key: str, make: Callable[[], object]):
    """An object that a Python worker makes once and uses for all its tasks."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def frequent_words(df: DataFrame, text_col: str, vocabulary, key: str, n: int = LEXICON_WORDS) -> DataFrame:
    """At most ``n`` words, those used most often over all texts: ``word, n_uses``.

    A task sums up its part before anything is shuffled; words that it has met once only are not reported, since no
    word is frequent for them. Where the list ends is read off a histogram of the uses, so no task sees the candidates of
    all others; words used about equally often are taken or left together. The choice steers speed, never results.
    """

    def count(batches):
        v = kept(f"v{key}", lambda: Vocabulary(vocabulary.value))
        chunks: Counter = Counter()

        def words():
            total: Counter = Counter()
            for c, k in chunks.items():
                for w in v.split(c):
                    total[w] += k
            chunks.clear()
            often = [(w, k) for w, k in total.items() if k > 1]
            return pa.RecordBatch.from_pydict(
                {"word": pa.array([w for w, _ in often], pa.string()), "n_uses": pa.array([k for _, k in often], pa.int64())}
            )

        for b in slices(batches, "text_"):
            for t in b.column("text_").to_pylist():
                chunks.update(v.chunks(t))
            if len(chunks) > MEMO_CHUNKS:
                yield words()
        yield words()

    counted = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text_")).mapInArrow(count, "word string, n_uses bigint")
    words = counted.groupBy("word").agg(F.sum("n_uses").alias("n_uses"))
    words = stored(words.withColumn("level_", F.floor(F.log2("n_uses") * LEVELS)))
    total, lowest = 0, None
    for level, size in sorted((tuple(r) for r in words.groupBy("level_").count().collect()), reverse=True):
        total += size
        if total > n:
            break
        lowest = level
    few = words.filter(F.col("level_") >= lowest) if lowest is not None else words.limit(0)
    return few.select("word", "n_uses")


def read_vocabulary(spark: SparkSession, path: str):
    """The bytes of the tokenizer file, a few MB whatever the corpus, for all executors; and a key for them."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()[:16]


def build_lexicon(df: DataFrame, text_col: str, path: str, n: int = LEXICON_WORDS) -> bytes:
    """Compile the frequent words of ``df`` with their ids; the driver sees at most ``n`` words."""
    vocabulary, key = read_vocabulary(df.sparkSession, path)

    def merged(batches):
        v = kept(f"v{key}", lambda: Vocabulary(vocabulary.value))
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words, pa.string()), "ids": pa.array([v.merge(w) for w in words], pa.list_(pa.int32()))}
            )

    rows = frequent_words(df, text_col, vocabulary, key, n).select("word").mapInArrow(merged, "word string, ids array<int>").collect()
    return Lexicon.compile({r.word: tuple(r.ids) for r in rows})


def encode_documents(
    df: DataFrame,
    path: str,
    emit: Callable[[pa.RecordBatch, list[list]], pa.RecordBatch],
    render: Callable[[Vocabulary], Callable[[tuple[int, ...]], object]],
    combine: Callable[[list], object],
    schema: str,
    lexicon: bytes | None = None,
    text_col: str = "text",
    merger: Callable[[bytes], Callable[[str], tuple[int, ...]]] | None = None,
) -> DataFrame:
    """Encode whole texts (null: empty) where they lie. ``emit`` makes rows of a slice and its encoded texts.

    ``merger`` makes, from the tokenizer file, what encodes a word that the lexicon lacks; by default the merges here.
    """
    spark = df.sparkSession
    vocabulary, key = read_vocabulary(spark, path)
    shared = spark.sparkContext.broadcast(lexicon) if lexicon else None
    key += hashlib.sha256(lexicon or b"").hexdigest()[:16] + getattr(render, "__name__", "")

    def run(batches):
        def make():
            v = Vocabulary(vocabulary.value)
            lexicon = Lexicon(mapped(shared.value)) if shared else None
            return Encoder(v, lexicon, render(v), combine, merger(vocabulary.value) if merger else None)

        encoder = kept(f"e{key}", make)
        for b in slices(batches, text_col):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            yield emit(b, encoder.encode(texts))

    return df.mapInArrow(run, schema)


def ids_and_tokens(v: Vocabulary):
    """Decimal ids joined by a space, and the decoded text of the same ids (tokens joined by a space)."""
    return lambda ids: (" ".join(map(str, ids)), " ".join([v.tokens[i] for i in ids]))


def joined(parts: list) -> tuple[str, str]:
    return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Special tokens written in a text are taken as such, as the tokenizer file says. Null texts count as empty and
    have no tokens; repeated rows give repeated results; an empty table gives no rows and builds an empty lexicon;
    other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    lexicon = build_lexicon(docs, "text_", path, n_words)

    def emit(b, encoded):
        n, ids_hash, text_hash = [], [], []
        for doc in encoded:
            ids = " ".join([d[0] for d in doc])
            n.append(ids.count(" ") + 1 if ids else 0)
            ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
            text_hash.append(hashlib.sha256(" ".join([d[1] for d in doc]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encode_documents(docs, path, emit, ids_and_tokens, joined, schema, lexicon, "text_")


def bpe_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_words: int = LEXICON_WORDS) -> DataFrame:
    """The token ids themselves: ``doc_id, ids array<int>``; null texts give an empty array."""
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    lexicon = build_lexicon(docs, "text_", path, n_words)

    def emit(b, encoded):
        ids = [[i for chunk in doc for i in chunk] for doc in encoded]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encode_documents(docs, path, emit, plain_ids, sum_ids, "doc_id bigint, ids array<int>", lexicon, "text_")


def plain_ids(v: Vocabulary):
    return lambda ids: ids


def sum_ids(parts: list) -> tuple[int, ...]:
    return tuple(chain.from_iterable(parts))


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode token ids: ``doc_id, text``; tokens are joined by a space, ids outside the vocabulary give nothing, null ids an empty text."""
    vocabulary, key = read_vocabulary(df.sparkSession, path)

    def run(batches):
        v = kept(f"v{key}", lambda: Vocabulary(vocabulary.value))
        for b in batches:
            texts = [" ".join(v.tokens[i] for i in ids or () if i in v.tokens) for ids in b.column("ids_").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    picked = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids_"))
    return picked.mapInArrow(run, "doc_id bigint, text string")
