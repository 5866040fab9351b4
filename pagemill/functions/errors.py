"""Error messages of tasks: class and whether another attempt makes sense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import config

# --- fixed values: words looked for, in this order ---------------------------
ERROR_WORDS = (
    ("timeout", "timeout"),
    ("connection", "connection_error"),
    ("validation", "validation_error"),
    ("invalid", "validation_error"),
    ("not found", "not_found"),
    ("rate limit", "rate_limit_exceeded"),
)


def classify_error(message: Column) -> Column:
    lowered = F.lower(message)
    result = None
    for words, kind in ERROR_WORDS:
        test = lowered.contains(words)
        result = F.when(test, kind) if result is None else result.when(test, kind)
    return result.otherwise("unknown")


def is_retryable(kind: Column) -> Column:
    """Known permanent errors are final; everything else, unknown kinds too, may be tried again."""
    return ~kind.isin(*config.NON_RETRYABLE_ERRORS)
