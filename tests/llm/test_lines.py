"""Line templates against a plain version of the same rule."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex

from pagemill.llm import catalog
from pagemill.llm.line_templates import (
    COMMON,
    DEPTH,
    FIELD,
    FIXED,
    MIN_DOCS,
    MIN_WORDS,
    OWN,
    RARER,
    SHORT_DOCS,
    SPREAD,
    TOGETHER,
    cut_lines,
    keyed,
    line_report,
    recurring_lines,
)

SF = "/root/testdata/sf0.001"


def masked(line):
    return [FIELD if re.search("[0-9]", w) else w for w in line.split(" ")]


def brute(rows):
    """Kept text and number of dropped lines of each document."""
    occurrences, all_words = [], {}
    for i, t in {(i, t or "") for i, t in rows}:
        lines = [masked(x) for x in t.split("\n")]
        whole = [" ".join(x) for x in lines]
        all_words[t] = sum(map(len, lines))
        for k, w in enumerate(lines):
            if regex.search(r"\p{L}", whole[k]):
                around = (whole[k - 1] if k else (t,), whole[k + 1] if k + 1 < len(lines) else (t,))
                occurrences.append((i, t, k, tuple(w), around, (len(w), tuple(w[:DEPTH]))))
    texts = defaultdict(set)
    for _, t, _, _, _, leaf in occurrences:
        texts[leaf].add(t)
    occurrences = [o for o in occurrences if len(texts[o[5]]) >= MIN_DOCS]
    forms = defaultdict(set)
    for _, t, _, w, _, leaf in occurrences:
        forms[leaf, w].add(t)
    support = defaultdict(int)
    for (leaf, w), t in forms.items():
        for p, x in enumerate(w):
            support[leaf, p, x] += len(t)
    template, rarest = {}, {}
    for leaf, w in forms:
        n = len(w)
        often = [support[leaf, p, x] if support[leaf, p, x] >= MIN_DOCS else 1 for p, x in enumerate(w)]
        most = sorted((c for c, x in zip(often, w) if x != FIELD), reverse=True)
        needed = n if n < MIN_WORDS else max(math.ceil(FIXED * n), DEPTH + 1)
        if len(most) >= needed:
            stays = [x != FIELD and c >= COMMON * most[needed - 1] for c, x in zip(often, w)]
            made = tuple(x if k else FIELD for x, k in zip(w, stays))
            template[leaf, w] = made
            rarest[made] = min(c for c, k in zip(often, stays) if k)
    docs, spots = defaultdict(set), (defaultdict(set), defaultdict(set))
    for _, t, _, w, around, leaf in occurrences:
        if (leaf, w) in template:
            docs[template[leaf, w]].add(t)
            for side in (0, 1):
                spots[side][template[leaf, w]].add(around[side])

    def enough(m):
        return SHORT_DOCS if len(m) < MIN_WORDS else MIN_DOCS

    common = {m for m in docs if len(docs[m]) >= max(enough(m), TOGETHER * rarest[m])}
    apart = {m for m in common if min(len(spots[0][m]), len(spots[1][m])) >= SPREAD * len(docs[m])}

    def frequency(leaf, w):
        m = template.get((leaf, w))
        return max(len(forms[leaf, w]), len(docs[m]) if m in common else 0)

    of_text = defaultdict(dict)
    for _, t, k, w, _, leaf in occurrences:
        of_text[t][k] = (len(w), frequency(leaf, w))
    free = defaultdict(set)
    for _, t, k, w, _, leaf in occurrences:
        m = template.get((leaf, w))
        if m in common:
            frequent = sum(n for n, f in of_text[t].values() if f > 1 and RARER * f > frequency(leaf, w))
            if m in apart or all_words[t] - frequent >= OWN * all_words[t]:
                free[m].add((t, k))
    gone = defaultdict(set)
    for i, t, k, w, _, leaf in occurrences:
        m = template.get((leaf, w))
        if (t, k) in free.get(m, ()) and len({t for t, _ in free[m]}) >= enough(m):
            gone[i, t].add(k)
    out = {}
    for i, t in rows:
        t = t or ""
        rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
        out[i] = (i, len(t.split("\n")), len(gone[i, t]), hashlib.sha256(rest.encode()).hexdigest())
    return out, gone


def sample():
    rng = random.Random(4)
    prose = lambda n: " ".join(f"p{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(n))
    rows = []
    for i in range(40):
        lines = [prose(rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        lines.insert(rng.randint(0, len(lines)), f"Posted by {rng.choice(['Ann', 'Bob', 'Cy', 'Di'])} on page {i} of the site")
        if i % 3 == 0:
            lines.insert(0, "Share this page\fwith your friends of it")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + k, rows[5][1]) for k in range(10)] + [(200, None), (201, ""), (202, "\n\n"), (204, "   \n    "), (205, "   \nx"), (206, "y\n   "), (203, "x" * 100_000)]
    rows += [(300 + k, f"one line of {k} alone that is copied\tin full") for k in range(2)]
    copied = "\n".join(prose(9) for _ in range(5))
    rows += [(400 + k, copied + f"\nnumber {'abcdefgh'[k]}") for k in range(8)]
    return rows


def test_against_brute_force(documents):
    rows = sample()
    df = documents([(i, t, "en", "s") for i, t in rows], "line_")
    expected, gone = brute(rows)
    assert {r.doc_id: tuple(r) for r in line_report(df).collect()} == expected
    texts = dict(rows)
    assert expected[0][2] >= 2 and expected[400][2] == 0  # boilerplate goes, the lines of copied documents stay
    cut = cut_lines(df)
    assert cut.columns == df.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    assert len(got) == len(rows) and got[200] is None and got[400] == texts[400]
    assert "Share this" not in "".join(t or "" for t in got.values())
    assert any(FIELD in r.template_ and r.template_.startswith("Posted by") for r in recurring_lines(keyed(df, "doc_id", "text")).collect())


def test_empty_and_repeated_rows(documents):
    assert line_report(documents([])).count() == 0
    rows = [(None, "a b c d\nq", "en", "s"), (1, "a b c d\nr", "en", "s"), (2, "a b c d\ns", "en", "s"), (2, "a b c d\ns", "en", "s")]
    assert sorted(r.text for r in cut_lines(documents(rows)).collect()) == ["q", "r", "s", "s"]


def test_query_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.QUERIES["op4_line_templates"](spark, SF).collect()
    assert {r.doc_id: tuple(r) for r in got} == brute(docs)[0]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(n))


def texts_with(rng, n, *lines, share=60):
    """``n`` different texts; ``share`` of them hold the lines, as a block at some place."""
    out = []
    for i in range(n):
        own = [prose(rng, rng.randint(5, 12)) for _ in range(rng.randint(3, 6))]
        if i < share:
            at = rng.randint(0, len(own))
            own[at:at] = [x(rng) if callable(x) else x for x in lines]
        out.append((i, "\n".join(own), "en", "s"))
    return out


def dropped(df):
    return sum(r.n_dropped for r in line_report(df).collect())


def test_blocks_of_several_lines_go(documents):
    rng = random.Random(1)
    block = ["Read the terms of this site", "All rights are reserved by us"]
    assert dropped(documents(texts_with(rng, 200, *block))) == 120
    assert dropped(documents(texts_with(rng, 200, *block, "Follow us on these networks now", "Contact the editor by letter"))) == 240


def test_short_lines_go_with_more_support(documents):
    rng = random.Random(2)
    assert dropped(documents(texts_with(rng, 200, "Read more"))) == 60
    assert dropped(documents(texts_with(rng, 200, "Read more", share=SHORT_DOCS - 1))) == 0
    assert dropped(documents(texts_with(rng, 200, "---"))) == 0  # no letter


@pytest.mark.parametrize("n", [100, 30_000])
def test_fields_do_not_depend_on_the_size(documents, n):
    rng = random.Random(3)
    names, cities = [prose(rng, 1).title() for _ in range(40)], [prose(rng, 1).title() for _ in range(25)]
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    line = lambda r: f"Posted by {r.choice(names)} on {r.choice(days)} from {r.choice(cities)} today"
    gone = dropped(documents(texts_with(rng, n, line, share=n)))
    assert gone >= 0.98 * n


def test_copies_with_scattered_edits_stay(documents):
    rng = random.Random(4)
    words = [prose(rng, 1) for _ in range(300)]
    rows = []
    for i in range(80):  # one word of fifty differs from copy to copy
        copy = [prose(rng, 1) if rng.random() < 0.02 else w for w in words]
        rows.append((i, "\n".join(" ".join(copy[k : k + 10]) for k in range(0, 300, 10)), "en", "s"))
    assert dropped(documents(rows)) == 0
    # a line of theirs that unrelated texts have too goes there
    known = rows[0][1].split("\n")[4]
    others = [(1000 + i, t, la, s) for i, t, la, s in texts_with(rng, 60, known)]
    got = {r.doc_id: r.n_dropped for r in line_report(documents(rows + others)).collect()}
    assert all(got[i] == 0 for i in range(80)) and sum(got[1000 + i] for i in range(60)) >= 58


def test_common_words_make_no_template(documents):
    rng = random.Random(5)
    few = ["the", "of", "and", "in", "to"]
    rows = [(i, "\n".join("And the " + " ".join(rng.choice(few) if rng.random() < 0.7 else prose(rng, 1) for _ in range(6)) for _ in range(4)), "en", "s") for i in range(400)]
    assert dropped(documents(rows)) < 0.01 * 1600
