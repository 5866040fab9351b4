"""Fixed values and default settings.

Everything here is data: class tables, thresholds and limits that decide what a
result looks like. Operators take them as arguments and default to these.
"""

from __future__ import annotations

# --- fixed values: layout classes of the detector, by class id -------------
ID_TO_LABEL = {
    0: "abstract",
    1: "algorithm",
    2: "aside_text",
    3: "chart",
    4: "content",
    5: "display_formula",
    6: "doc_title",
    7: "figure_title",
    8: "footer",
    9: "footer_image",
    10: "footnote",
    11: "formula_number",
    12: "header",
    13: "header_image",
    14: "image",
    15: "inline_formula",
    16: "number",
    17: "paragraph_title",
    18: "reference",
    19: "reference_content",
    20: "seal",
    21: "table",
    22: "text",
    23: "vertical_text",
    24: "vision_footnote",
}

# --- fixed values: recognition task of each layout label -------------------
TASK_LABELS = {
    "text": [
        "abstract",
        "algorithm",
        "content",
        "doc_title",
        "figure_title",
        "paragraph_title",
        "reference_content",
        "text",
        "vertical_text",
        "vision_footnote",
        "seal",
        "formula_number",
    ],
    "table": ["table"],
    "formula": ["display_formula", "inline_formula"],
    "skip": ["chart", "image"],
    "abandon": [
        "header",
        "footer",
        "number",
        "footnote",
        "aside_text",
        "reference",
        "footer_image",
        "header_image",
    ],
}

# --- fixed values: output category of each layout label --------------------
# Looked up in the order image, text, table, formula.
CATEGORY_LABELS = {
    "image": ["chart", "image"],
    "text": [
        "abstract",
        "algorithm",
        "content",
        "doc_title",
        "figure_title",
        "paragraph_title",
        "reference_content",
        "text",
        "vertical_text",
        "vision_footnote",
        "seal",
        "formula_number",
    ],
    "table": ["table"],
    "formula": ["display_formula", "inline_formula"],
}

# --- fixed values: prompts and generation parameters -----------------------
TASK_PROMPTS = {
    "text": "Text Recognition:",
    "table": "Table Recognition:",
    "formula": "Formula Recognition:",
}
GENERATION_DEFAULTS = {
    "max_tokens": 8192,
    "temperature": 0.0,
    "top_p": 0.00001,
    "top_k": 1,
    "repetition_penalty": 1.1,
}

# --- fixed values: box rules -----------------------------------------------
SCORE_THRESHOLD = 0.3
IOU_SAME_CLASS = 0.6
IOU_OTHER_CLASS = 0.98
CONTAINED_RATIO = 0.8
PAGE_IMAGE_RATIO_LANDSCAPE = 0.82
PAGE_IMAGE_RATIO_OTHER = 0.93
PRESERVED_LABELS = ("image", "seal", "chart")
# class 18 (reference) keeps its small boxes, every other class its large ones
MERGE_MODES = {cls: ("small" if cls == 18 else "large") for cls in ID_TO_LABEL}
UNCLIP_RATIO = (1.0, 1.0)
POLYGON_ATOL = 1.0
POLYGON_RTOL = 1e-5

# --- fixed values: text rules ----------------------------------------------
LONG_CONTENT = 2048
REPEAT_MIN_UNIT = 10
REPEAT_MIN_COUNT = 10
REPEAT_LINE_COUNT = 10
REPEAT_LINE_SHARE = 0.8
BULLET_TOLERANCE = 10
LEXICON_MIN_FREQUENCY = 2.5

# --- fixed values: page rendering and resizing -----------------------------
RENDER_DPI = 200
RENDER_MAX_SIDE = 3500
MIN_PIXELS = 12544
MAX_PIXELS = 71372800

# --- fixed values: task table ----------------------------------------------
NON_RETRYABLE_ERRORS = (
    "validation_error",
    "authentication_error",
    "authorization_error",
    "not_found",
    "invalid_input",
    "file_not_found",
)
RETRYABLE_ERRORS = (
    "timeout",
    "connection_error",
    "service_unavailable",
    "rate_limit_exceeded",
    "transient_error",
    "resource_temporarily_unavailable",
)
MAX_RETRY_DELAY = 3600
STAGE_WEIGHTS = (("convert", 0.0, 0.20), ("recognise", 20.0, 0.65), ("merge", 85.0, 0.15))

# --- sizes that steer the physical plan, never the result -------------------
# A page holding more rows than this leaves the per-page array path.
PAGE_ROWS_LIMIT = 2048
# Ordered scans over larger groups are cut into chunks of this many positions.
SCAN_CHUNK = 65536
# A document row covers this many pages; longer documents become several rows.
PAGES_PER_PART = 1024
# Documents whose files are written by one job; more take several, so that shuffle files take less disk.
DOCUMENTS_PER_SLICE = 500_000
# Regions of one page that may share a text fragment.
REGIONS_PER_FRAGMENT = 4096
# Key tables up to this many counted rows may be broadcast.
BROADCAST_ROWS = 100_000

PAGE_KEYS = ["unit_id", "page_idx"]
