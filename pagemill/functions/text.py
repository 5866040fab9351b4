"""Cleaning and formatting of recognised text, as column expressions.

Everything but the search for repeated substrings stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagemill import config
from pagemill.functions.boxes import lookup
from pagemill.functions.strings import (
    SPACE,
    bind,
    drop_first,
    drop_last,
    ends_with_any,
    first_matching,
    is_blank,
    lstrip,
    rstrip,
    starts_with_any,
    strip,
)


# --- repeated content --------------------------------------------------------


def repeat_end(codes: np.ndarray, min_unit: int, min_count: int) -> int | None:
    """End of the first unit of the leftmost repetition, or None.

    A repetition is a unit of at least ``min_unit`` characters that occurs
    ``min_count`` times in a row. For a unit length L it shows as (min_count - 1) * L
    equal pairs s[i] == s[i + L], so it covers min_count - 2 consecutive multiples of L.
    Looking only at multiples of L first makes all lengths together cost n log n.
    """
    best: tuple[int, int] | None = None
    for unit in likely_units(codes, min_unit, min_count):
        start = _first_run(codes[unit:] == codes[:-unit], (min_count - 1) * unit)
        if start is not None and (best is None or start < best[0]):
            best = (start, unit)
    return None if best is None else best[0] + best[1]


def likely_units(codes: np.ndarray, min_unit: int, min_count: int) -> list[int]:
    """Unit lengths whose multiples hold equal characters often enough in a row.

    Lengths are tested together in ranges that double, so a range makes one matrix.
    """
    n, found, low = len(codes), [], min_unit
    longest = n // min_count
    while low <= longest:
        units = np.arange(low, min(2 * low, longest + 1))
        places = units[:, None] * np.arange((n - 1) // low + 1)[None, :]
        valid = places < n
        samples = codes[np.minimum(places, n - 1)]
        runs = (samples[:, 1:] == samples[:, :-1]) & valid[:, 1:]
        length = 1
        while length < min_count - 2 and runs.any():
            step = min(length, min_count - 2 - length)
            runs = runs[:, :-step] & runs[:, step:]
            length += step
        found += units[runs.any(axis=1)].tolist()
        low *= 2
    return found


def _first_run(equal: np.ndarray, length: int) -> int | None:
    """First index of ``length`` consecutive true values."""
    if len(equal) < length:
        return None
    breaks = np.flatnonzero(~equal)
    edges = np.concatenate(([-1], breaks, [len(equal)]))
    long_enough = np.flatnonzero(np.diff(edges) > length)
    return int(edges[long_enough[0]] + 1) if len(long_enough) else None


@F.pandas_udf(StringType())
def _cut_repeats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def cut(text: str | None) -> str | None:
        if not text:
            return None
        end = repeat_end(
            np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), config.REPEAT_MIN_UNIT, config.REPEAT_MIN_COUNT
        )
        return None if end is None else text[:end]

    for batch in batches:
        yield batch.map(cut, na_action="ignore").astype(object)


def cut_repeats(content: Column, min_length: int = 0) -> Column:
    """Text up to the first unit of a repetition; null when nothing repeats.

    Rows shorter than ``min_length`` are sent to Python as nulls, which costs next to
    nothing; a conditional around the call would not keep them away.
    """
    stripped = strip(content)
    worth_it = (F.length(content) >= min_length) & (
        F.length(stripped) > config.REPEAT_MIN_UNIT * config.REPEAT_MIN_COUNT
    )
    return _cut_repeats(F.when(worth_it, stripped))


# --- content -----------------------------------------------------------------

_OPEN, _CLOSE = "\ue000", "\ue001"


def normalise_inline_formula(content: Column) -> Column:
    """``$ x $`` becomes ``$x$``, set off by a space from letters and digits next to it.

    Spans are first marked with two private-use characters, so that a blank span can
    take its closing dollar with it and be put back as it was. The span body has one
    way to match, so its loops are possessive and long texts cost no stack.
    """
    body = r"[^$\\]*+(?:\\[^\n][^$\\]*+)*+"
    marked = F.regexp_replace(content, rf"(?<!\$)\$(?=[^$])({body})\$(?!\$)", f"{_OPEN}$1{_CLOSE}")
    marked = F.regexp_replace(marked, rf"(?U){_OPEN}({SPACE}+){_CLOSE}", r"\$$1\$")
    marked = F.regexp_replace(marked, rf"(?U){_OPEN}{SPACE}+", _OPEN)
    marked = F.regexp_replace(marked, rf"(?U){SPACE}+{_CLOSE}", _CLOSE)
    marked = F.regexp_replace(marked, rf"([\p{{L}}\p{{N}}]){_OPEN}", f"$1 {_OPEN}")
    marked = F.regexp_replace(marked, rf"{_CLOSE}([\p{{L}}\p{{N}}])", f"{_CLOSE} $1")
    return F.when(F.contains(content, F.lit("$")), F.translate(marked, _OPEN + _CLOSE, "$$")).otherwise(content)


def collapse_punctuation(content: Column) -> Column:
    """Trim, drop literal tab escapes at both ends, shorten long runs of marks to three.

    The patterns run only over texts that hold what they look for, which a plain search
    finds out much faster.
    """

    def without_tabs(text: Column) -> Column:
        text = lstrip(F.regexp_replace(text, r"^(?:\\t)+", ""))
        return F.when(text.contains("\\t"), F.regexp_replace(text, r"(?d)(?:\\t)+$", "")).otherwise(text)

    def shortened(text: Column) -> Column:
        marks = text.contains("...") | text.contains("···") | text.contains("___")
        return F.when(marks, F.regexp_replace(text, r"([.·_])\1{2,}", "$1$1$1")).otherwise(text)

    def escaped(text: Column) -> Column:
        return F.when(text.contains("\\_\\_\\_"), F.regexp_replace(text, r"(?:\\_){3,}", r"\\_\\_\\_")).otherwise(text)

    return bind(rstrip(bind(content, without_tabs)), lambda text: bind(shortened(text), escaped))


def clean_formula_number(number: Column) -> Column:
    """Trim and drop one pair of round brackets."""

    def unwrapped(text: Column) -> Column:
        wrapped = (text.startswith("(") & text.endswith(")")) | (text.startswith("（") & text.endswith("）"))
        return F.when(wrapped, drop_last(drop_first(text, 1), 1)).otherwise(text)

    return bind(strip(number), unwrapped)


def map_label(native: Column, categories: Mapping[str, Sequence[str]] = config.CATEGORY_LABELS) -> Column:
    """Output category of a layout label; labels without one stay."""
    by_label: dict[str, str] = {}
    for category in ("image", "text", "table", "formula"):
        for label in categories.get(category, []):
            by_label.setdefault(label, category)
    return F.coalesce(lookup(by_label, native), native)


def format_title(content: Column, native: Column) -> Column:
    """Markdown heading marks for document and paragraph titles."""
    hashes = rf"(?U)^#+{SPACE}*"
    document = F.concat(F.lit("# "), F.regexp_replace(content, hashes, ""))
    item = F.when(starts_with_any(content, "- ", "* "), lstrip(drop_first(content, 2))).otherwise(content)
    paragraph = F.concat(F.lit("## "), lstrip(F.regexp_replace(item, hashes, "")))
    return first_matching(content, (native == "doc_title", document), (native == "paragraph_title", paragraph))


def format_formula(content: Column) -> Column:
    """Bare formula between lines of ``$$``."""
    opened = F.when(starts_with_any(content, "$$", "\\[", "\\("), strip(drop_first(content, 2))).otherwise(content)
    closed = bind(
        opened, lambda c: F.when(ends_with_any(c, "$$", "\\]", "\\)"), strip(drop_last(c, 2))).otherwise(c)
    )
    return F.concat(F.lit("$$\n"), closed, F.lit("\n$$"))


def close_code_fence(content: Column) -> Column:
    return F.when(
        content.startswith("```") & ~content.endswith("```"), F.concat(content, F.lit("\n```"))
    ).otherwise(content)


def normalise_bullet(content: Column) -> Column:
    return F.when(
        starts_with_any(content, "·", "•", "* "), F.concat(F.lit("- "), lstrip(drop_first(content, 1)))
    ).otherwise(content)


def normalise_enumerator(content: Column) -> Column:
    """``(1)x`` to ``(1) x`` and ``1.x`` to ``1. x``; only text on one line is an item."""
    gap = r"[\s\x1c-\x1f&&[^\n]]*"
    bracketed = F.regexp_replace(content, rf"(?Ud)^[(（](\d+|[A-Za-z])[)）]{gap}(.*)$", "($1) $2")
    plain = F.regexp_replace(bracketed, rf"(?Ud)^(\d+|[A-Za-z])([.)]){gap}(.*)$", "$1$2 $3")
    return F.regexp_replace(plain, rf"(?Ud)^(\d+|[A-Za-z])）{gap}(.*)$", "$1) $2")


def double_newlines(content: Column) -> Column:
    doubled = F.regexp_replace(content, r"(?<!\n)\n(?!\n)", "\n\n")
    return F.when(content.contains("\n"), doubled).otherwise(content)


def is_finished(content: Column, label: Column) -> Column:
    """A table or formula that already has its delimiters is taken as it is."""
    table = (label == "table") & content.startswith("<table") & content.endswith("</table>")
    formula = (label == "formula") & content.startswith("$$") & content.endswith("$$")
    return table | formula


def is_plausible_word(word: Column, frequency: Column | None = None) -> Column:
    """Whether two word halves make a word: frequent enough, or shaped like one."""
    token = F.lower(strip(word))
    shaped = token.rlike(r"\A[a-z][a-z'\-]{2,30}\z") & ~token.contains("--") & ~token.contains("''")
    if frequency is not None:
        shaped = F.coalesce(frequency >= config.LEXICON_MIN_FREQUENCY, F.lit(False))
    return ~is_blank(word) & shaped


# --- image references in Markdown -------------------------------------------

REFERENCE = r"!\[\]\(page=\d+,bbox=\[[\d,\s]+\]\)"


def reference_page(ref: Column) -> Column:
    """The page that an image reference names."""
    return F.regexp_extract(ref, r"page=(\d+)", 1).try_cast("int")


def scaled_reference(ref: Column, page: Column, width: Column, height: Column) -> Column:
    """An image reference with its box in thousandths of the page; as it is without page size or four numbers."""
    raw = F.regexp_extract(ref, r"bbox=\[([\d,\s]+)\]", 1)
    numbers = F.transform(F.split(raw, ","), lambda n: strip(n).try_cast("double"))
    parsed = F.struct(
        page.alias("page"), numbers.alias("numbers"), width.alias("width"), height.alias("height"), ref.alias("ref")
    )
    return bind(parsed, _scaled)


def _scaled(parsed: Column) -> Column:
    numbers, width, height = parsed["numbers"], parsed["width"], parsed["height"]
    sides = F.transform(
        numbers,
        lambda side, i: F.bround(side * 1000 / F.when(i % 2 == 0, width).otherwise(height)).cast("bigint").cast("string"),
    )
    usable = (F.size(numbers) == 4) & ~F.exists(numbers, lambda n: n.isNull()) & (width > 0) & (height > 0)
    joined = F.concat(
        F.lit("![](page="), parsed["page"].cast("string"), F.lit(",bbox=["), F.array_join(sides, ", "), F.lit("])")
    )
    return F.when(F.coalesce(usable, F.lit(False)), joined).otherwise(parsed["ref"])


def rewrite_image_refs(markdown: Column, page_sizes: Column) -> Column:
    """Bring the boxes of image references to thousandths of their page.

    ``page_sizes`` is an array of ``struct(width, height)``; for documents of very many pages see
    :func:`pagemill.operators.tags.rewrite_references`. References to unknown
    pages, pages without size or with other than four numbers stay.
    """

    def rewritten(ref: Column) -> Column:
        size = F.get(page_sizes, reference_page(ref))
        return scaled_reference(ref, reference_page(ref), size["width"], size["height"])

    # the text between references, each piece but the first behind its reference
    between = F.split(markdown, REFERENCE, -1)
    refs = F.concat(F.array(F.lit("")), F.transform(F.regexp_extract_all(markdown, F.lit(REFERENCE), F.lit(0)), rewritten))
    joined = F.array_join(F.zip_with(refs, between, lambda ref, text: F.concat(ref, text)), "")
    touched = markdown.contains("![](page=") & (F.size(page_sizes) > 0)
    return F.when(F.coalesce(touched, F.lit(False)), joined).otherwise(markdown)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence of ``old``; the text is returned when there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def resolve_image_tags(markdown: Column, images: Column) -> Column:
    """Replace the reference of each image region by its file, first occurrence only.

    ``images`` is an ordered array of ``struct(old, new)``.
    """
    return F.aggregate(images, markdown, lambda text, image: replace_first(text, image["old"], image["new"]))


# --- formulas inside HTML text ----------------------------------------------

_SKIPPED = r"(?is)<(code|pre|kbd|samp|script|style|textarea)\b[^>]*>.*?</\1\s*>"


def split_math_spans(html: Column) -> Column:
    """Formulas in running HTML text as an array of ``struct(expr, display)``.

    ``$$..$$`` is a display formula, ``$..$`` an inline one. Escaped dollars and blank
    spans are literal text, and code-like elements are left out. A formula lies within
    one text node, so it cannot reach over a tag.
    """
    text_nodes = F.split(F.regexp_replace(html, _SKIPPED, "<>"), r"<[^>]*>")
    display = r"\$\$(?!\s*\$\$)[^$\\]*+(?:(?:\\.|\$(?!\$))[^$\\]*+)*+\$\$"
    inline = r"\$(?!\s*\$)[^$\\]*+(?:\\.[^$\\]*+)*+\$"
    spans = F.flatten(
        F.transform(
            F.filter(text_nodes, lambda t: t.contains("$")),
            lambda t: F.regexp_extract_all(t, F.lit(rf"(?s)\\\$|{display}|{inline}|\$"), F.lit(0)),
        )
    )
    formulas = F.filter(spans, lambda s: s.startswith("$") & (F.length(s) > 2))
    return F.transform(
        formulas,
        lambda s: F.struct(
            F.when(s.startswith("$$"), drop_last(drop_first(s, 2), 2)).otherwise(drop_last(drop_first(s, 1), 1)).alias("expr"),
            s.startswith("$$").alias("display"),
        ),
    )
