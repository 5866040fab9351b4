"""Results as columns, tables and files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagemill.functions.source import sanitize_name


def _region(r: Column, image_path: bool) -> Column:
    fields = [
        r["idx"].alias("index"),
        r["label"].alias("label"),
        r["content"].alias("content"),
        F.array(r["bx1"], r["by1"], r["bx2"], r["by2"]).alias("bbox_2d"),
        r["native_label"].alias("native_label"),
    ]
    return F.struct(*fields, r["image_path"].alias("image_path")) if image_path else F.struct(*fields)


def page_json(regions: Column, image_path: bool = True) -> Column:
    """The regions of a page, or of a piece of it, as a JSON list."""
    return F.to_json(F.transform(regions, lambda r: _region(r, image_path)), {"ignoreNullFields": "false"})


def region_json(pages: Column, image_path: bool = True) -> Column:
    """List of pages of regions as JSON text; absent content stays as null."""
    shaped = F.transform(pages, lambda page: F.transform(page, lambda r: _region(r, image_path)))
    return F.to_json(shaped, {"ignoreNullFields": "false"})


def to_result_json(
    json_result: Column,
    markdown: Column,
    original_images: Column,
    usage: Column | None = None,
    data_info: Column | None = None,
    error: Column | None = None,
) -> Column:
    """One JSON object per result; optional members appear only when they have a value."""
    parts = [
        F.concat(F.lit('"json_result": '), F.coalesce(json_result, F.lit("null"))),
        F.concat(F.lit('"markdown_result": '), _quoted(F.coalesce(markdown, F.lit("")))),
        F.concat(F.lit('"original_images": '), F.to_json(original_images)),
    ]
    for name, value, is_json in (("usage", usage, True), ("data_info", data_info, True), ("error", error, False)):
        if value is not None:
            shown = value if is_json else _quoted(value)
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), shown)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _quoted(text: Column) -> Column:
    """Text as a JSON string: the single element of a JSON list."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def to_service_response(results: DataFrame, model: str = "default") -> DataFrame:
    """Results under both sets of field names that clients know."""
    return results.select(
        *[c for c in results.columns if c not in ("json_result", "markdown_result")],
        "json_result",
        "markdown_result",
        F.col("json_result").alias("layout_details"),
        F.col("markdown_result").alias("md_results"),
        F.struct(F.array().cast("array<struct<width:int,height:int>>").alias("pages")).alias("data_info"),
        F.lit("{}").alias("usage"),
        F.lit(model).alias("model"),
        F.concat(F.lit("chatcmpl-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 29)).alias("id"),
        F.unix_timestamp().alias("created"),
    )


def write_table(results: DataFrame, out: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Results as a table, the form that scales; optionally one folder per ``by``."""
    writer = results.write.mode("overwrite").format(fmt)
    (writer.partitionBy(by) if by else writer).save(out)


def write_documents(results: DataFrame, out: str) -> None:
    """One folder per document: ``<stem>.json``, ``<stem>_model.json``, ``<stem>.md``.

    ``results`` has ``rel_dir, stem, part_page, part_seq, json_text, raw_json, markdown``.
    The first part of a document has the plain name, further parts add their position.
    Files are written under a temporary name and moved, so a repeated task leaves the same
    files. ``out`` must be a folder all executors share.
    """
    named = results.select(
        F.coalesce("rel_dir", F.lit("")).alias("rel_dir"),
        sanitize_name(F.col("stem")).alias("stem"),
        "part_page",
        "part_seq",
        "json_text",
        "raw_json",
        "markdown",
    )

    def save(folder: str, name: str, text: str) -> None:
        temporary = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, os.path.join(folder, name))

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            folder = os.path.join(out, row.rel_dir, row.stem)
            os.makedirs(folder, exist_ok=True)
            first = row.part_page == 0 and row.part_seq == 0
            stem = row.stem if first else f"{row.stem}.{row.part_page:06d}.{row.part_seq:06d}"
            save(folder, f"{stem}.json", row.json_text)
            if row.raw_json is not None:
                save(folder, f"{stem}_model.json", row.raw_json)
            if row.markdown and row.markdown.strip():
                save(folder, f"{stem}.md", row.markdown)

    named.foreachPartition(write)
