"""String helpers that follow Unicode rules for white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four information separators
SPACE = r"[\s\x1c-\x1f]"
# the same characters one by one: trimming a set of characters looks at the ends only
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(SPACES))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACES))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_first(col: Column, count: int) -> Column:
    return F.substring(col, F.lit(count + 1), F.length(col))


def drop_last(col: Column, count: int) -> Column:
    return F.substring(col, F.lit(1), F.greatest(F.length(col) - count, F.lit(0)))


def is_blank(col: Column) -> Column:
    """Null or nothing but white space."""
    return col.isNull() | (strip(col) == "")


def first_matching(col: Column, *pairs: tuple[Column, Column]) -> Column:
    """``when`` chain that leaves ``col`` as it is when no condition holds."""
    result = None
    for condition, value in pairs:
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(col)


def starts_with_any(col: Column, *prefixes: str) -> Column:
    test = col.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | col.startswith(prefix)
    return test


def ends_with_any(col: Column, *suffixes: str) -> Column:
    test = col.endswith(suffixes[0])
    for suffix in suffixes[1:]:
        test = test | col.endswith(suffix)
    return test
