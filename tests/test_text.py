"""Text rules on hand-written strings and against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import strings, text
from pagemill.operators import content


def apply(spark, function, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", function(F.col("v")).alias("out")).orderBy("k").collect()]


def cleaned(spark, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.v for r in content.clean_content(rows, "v").orderBy("k").collect()]


def test_strip_follows_unicode(spark):
    values = ["\u3000 a \n", "\x1f\x85b\u2028", "  ", "c", ""]
    assert apply(spark, strings.strip, values) == [v.strip() for v in values]
    assert apply(spark, strings.lstrip, values) == [v.lstrip() for v in values]
    assert apply(spark, strings.rstrip, values) == [v.rstrip() for v in values]


def test_clean_content(spark):
    values = ["\\t\\t a.....b", "x____\\_\\_\\_\\_y\\t", "····", None, "  $ x $ ", "a\\tb"]
    assert cleaned(spark, values) == ["a...b", "x___\\_\\_\\_y", "···", "", "$x$", "a\\tb"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("$ x $", "$x$"),
        ("a$x$b", "a $x$ b"),
        ("中$x$文", "中 $x$ 文"),
        ("$ $ y $z$", "$ $ y $z$"),
        ("$$ x $$", "$$ x $$"),
        # a dollar behind a backslash still opens a span, as only a dollar before it would not
        ("cost \\$5 and $ a\\$b $", "cost \\$5 and$ a\\$b$"),
        ("$a\\$b$c", "$a\\$b$ c"),
        ("no dollars", "no dollars"),
        ("$a$x$b$", "$a$ x $b$"),
        ("$5 alone", "$5 alone"),
    ],
)
def test_inline_formula(spark, given, wanted):
    assert apply(spark, text.normalise_inline_formula, [given]) == [wanted]


def test_inline_formula_in_long_text(spark):
    long = "$" + "a b" * 20000 + " $ c"
    assert apply(spark, text.normalise_inline_formula, [long]) == ["$" + "a b" * 20000 + "$ c"]


def test_enumerators(spark):
    values = ["(1)x", "（a）x", "1.x", "a)x", "1）x", "3.14 is", "U.S.", "(1)x\ny", "2.1", "ab.c", "1.  x\u2028y"]
    wanted = ["(1) x", "(a) x", "1. x", "a) x", "1) x", "3. 14 is", "U. S.", "(1)x\ny", "2. 1", "ab.c", "1. x\u2028y"]
    assert apply(spark, text.normalise_enumerator, values) == wanted


def test_titles_bullets_fences(spark):
    title = lambda c: text.format_title(c, F.lit("paragraph_title"))
    assert apply(spark, title, ["- # A", "* B", "### C", "-D"]) == ["## A", "## B", "## C", "## -D"]
    assert apply(spark, text.normalise_bullet, ["· a", "•b", "* c", "*d"]) == ["- a", "- b", "- c", "*d"]
    assert apply(spark, text.close_code_fence, ["```a", "```a```", "a"]) == ["```a\n```", "```a```", "a"]
    assert apply(spark, text.double_newlines, ["a\nb", "a\n\nb", "\n"]) == ["a\n\nb", "a\n\nb", "\n\n"]
    assert apply(spark, text.format_formula, ["$$x$$", "\\[y\\]", "z\\)"]) == ["$$\nx\n$$", "$$\ny\n$$", "$$\nz\n$$"]
    assert apply(spark, text.clean_formula_number, [" (1) ", "（2.1）", "3", "(", "()"]) == ["1", "2.1", "3", "(", ""]


def test_plausible_words(spark):
    values = ["Hello", "it's", "a--b", "ab", "x" * 32, "x" * 31, "9lives", "  "]
    assert apply(spark, text.is_plausible_word, values) == [True, True, False, False, False, True, False, False]


def brute_repeat(s: str, unit: int, count: int) -> int | None:
    """End of the first unit: try every start, then every length."""
    for start in range(len(s)):
        for length in range(unit, len(s) // count + 1):
            piece = s[start : start + length]
            if len(piece) == length and s[start : start + length * count] == piece * count:
                return start + length
    return None


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


@pytest.mark.parametrize("seed", range(30))
def test_repeats_against_brute_force(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(1, 4)):
        unit = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        parts.append("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))))
        parts.append(unit * rng.randint(1, 9))
    s = "".join(parts)
    assert text.repeat_end(codes(s), 3, 4) == brute_repeat(s, 3, 4)


@pytest.mark.parametrize(("unit", "times"), [(9, 10), (10, 9), (10, 10), (12, 11), (9, 20), (13, 10)])
def test_repeat_limits(unit, times):
    rng = random.Random(unit)
    piece = "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(unit))
    s = "head " + piece * times + " tail"
    assert text.repeat_end(codes(s), 10, 10) == brute_repeat(s, 10, 10)


def test_only_long_content_is_cut(spark):
    piece = "0123456789a"
    short, long = piece * 180, piece * 190
    assert len(short) < 2048 <= len(long)
    assert cleaned(spark, [short, long, "é" + long]) == [short, piece, "é" + piece]


def test_repeated_lines(spark):
    rows = ["x\n" * 9, "x\n" * 10, "a\n" + "x\n" * 8 + "b\nc", "a\nb\n" + "x\n\n" * 8, "x\na\n" * 2 + "x\n" * 8]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string")
    got = [r.v for r in content.cut_repeated_lines(df, "v").orderBy("k").collect()]
    assert got == [rows[0], "x", rows[2], rows[3], "x\na\nx\na\nx"]


def test_math_spans(spark):
    html = ["<p>$$x$$ $y$ \\$5</p>", "<code>$a$</code>$ $$b$", "$$$$x$$", "a $5", "$a<b>c$</b>", "$$a$b$$"]
    got = apply(spark, text.split_math_spans, html)
    assert [[(s.expr, s.display) for s in row] for row in got] == [
        [("x", True), ("y", False)],
        [("b", False)],
        [("$x", True)],
        [],
        [],
        [("a$b", True)],
    ]


def test_image_references(spark):
    sizes = F.array(F.struct(F.lit(2040).alias("width"), F.lit(2640).alias("height")))
    rewrite = lambda c: text.rewrite_image_refs(c, sizes)
    values = [
        "a ![](page=0,bbox=[431, 1762, 1061, 2189]) b",
        "![](page=1,bbox=[1,2,3,4])",
        "![](page=0,bbox=[1,2,3])",
        "",
        None,
    ]
    wanted = ["a ![](page=0,bbox=[211, 667, 520, 829]) b", *values[1:]]
    assert apply(spark, rewrite, values) == wanted
