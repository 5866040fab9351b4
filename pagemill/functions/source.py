"""What an input is: kinds, data URIs, names and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.strings import SPACE, drop_first

# --- fixed values: file signatures, accepted suffixes, prefixes --------------
SIGNATURES = (
    ("255044462D", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
)
OTHER_KIND = "application/octet-stream"
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp", "pdf")
BASE64_MARK = "<|base64|>"
BASE64_MIN_LENGTH = 128
BASE64_MIN_LENGTH_LOOSE = 32


def sniff_kind(content: Column) -> Column:
    """MIME type by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    result = None
    for signature, kind in SIGNATURES:
        test = head.startswith(signature)
        result = F.when(test, kind) if result is None else result.when(test, kind)
    return result.otherwise(OTHER_KIND)


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+", "")


def _padded(text: Column) -> Column:
    missing = F.pmod(-F.length(text), F.lit(4))
    return F.concat(text, F.repeat(F.lit("="), missing))


def looks_like_base64(text: Column, loose: bool = False) -> Column:
    """Whether a string is a base64 payload rather than a name.

    Blanks are ignored and the padding is completed; what is left must be in the strict
    alphabet, which also rules out paths with a scheme, a suffix or a backslash.
    """
    candidate = _compact(text)
    long_enough = F.length(candidate) >= (BASE64_MIN_LENGTH_LOOSE if loose else BASE64_MIN_LENGTH)
    if loose:
        candidate = F.when(
            candidate.startswith(BASE64_MARK), drop_first(candidate, len(BASE64_MARK))
        ).otherwise(candidate)
    return long_enough & _padded(candidate).rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")


def classify_source(text: Column) -> Column:
    """``url``, ``data_uri``, ``file_url``, ``base64`` or ``path``."""
    return (
        F.when(text.startswith("http://") | text.startswith("https://"), "url")
        .when(text.startswith("data:"), "data_uri")
        .when(text.startswith("file://"), "file_url")
        .when(looks_like_base64(text), "base64")
        .otherwise("path")
    )


def encode_base64(content: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def to_data_uri(content: Column, mime: Column | None = None) -> Column:
    return F.concat(
        F.lit("data:"), sniff_kind(content) if mime is None else mime, F.lit(";base64,"), encode_base64(content)
    )


def to_marked_base64(content: Column) -> Column:
    return F.concat(F.lit(BASE64_MARK), encode_base64(content))


def from_data_uri(text: Column) -> Column:
    """Bytes of a data URI or of (marked) base64 text; null when it does not decode."""
    payload = (
        F.when(text.startswith("data:"), F.get(F.split(text, ",", 2), F.lit(1)))
        .when(text.startswith(BASE64_MARK), drop_first(text, len(BASE64_MARK)))
        .otherwise(text)
    )
    return F.try_to_binary(_padded(_compact(payload)), F.lit("base64"))


def source_display_name(source: Column, is_bytes: Column, unit_idx: Column) -> Column:
    """Name shown for an input: numbered for raw bytes, otherwise the path."""
    return (
        F.when(is_bytes, F.concat(F.lit("document_"), unit_idx.cast("string")))
        .when(source.startswith("file://"), drop_first(source, 7))
        .otherwise(source)
    )


def to_file_url(source: Column, base_dir: str) -> Column:
    """URLs stay; a path becomes an absolute ``file://`` URL."""
    known = F.lit(False)
    for scheme in ("http://", "https://", "data:", "file://"):
        known = known | source.startswith(scheme)
    absolute = F.when(source.startswith("/"), source).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), source))
    return F.when(known, source).otherwise(F.concat(F.lit("file://"), absolute))


def sanitize_name(name: Column) -> Column:
    """File name without characters that file systems refuse."""
    safe = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_")
    safe = F.regexp_replace(safe, r"[ .]+\z", "")
    return F.when(safe == "", "result").otherwise(safe)


def is_document_path(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(SUFFIXES)})\z")


def crop_path(prefix: Column, page: Column, number: Column) -> Column:
    """File of a cropped image region."""
    return F.concat(
        F.lit("imgs/"), prefix, F.lit("_page"), page.cast("string"), F.lit("_idx"), number.cast("string"), F.lit(".jpg")
    )


def split_path(page_no: Column, block_id: Column) -> Column:
    """File of an image block in a task report."""
    return F.format_string("split_%d_%04d.png", page_no, block_id)
