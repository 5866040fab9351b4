"""Reading documents, recognition results, service responses and progress files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.boxes import to_thousandths_rounded
from pagemill.functions.source import is_document_path, sniff_kind
from pagemill.operators.sft import MESSAGES_TYPE

BLOCK_TYPE = "struct<index:int,label:string,content:string,bbox_2d:array<double>>"
RESPONSE_TYPE = (
    "struct<id:string,model:string,created:bigint,md_results:string,"
    "layout_details:array<array<struct<index:int,label:string,content:string,bbox_2d:array<double>>>>,"
    "data_info:struct<pages:array<struct<width:int,height:int>>>,usage:string,layout_visualization:array<string>>"
)
PROGRESS_SCHEMA = "completed bigint, total bigint, failed bigint, status string, timestamp double, _corrupt string"


def outermost(paths: Sequence[str]) -> list[str]:
    """The given paths, each once, without those that lie under another one."""
    plain = {p.removeprefix("file:").replace("///", "/").rstrip("/") or "/": p for p in paths}
    return [p for k, p in plain.items() if not any(k != o and k.startswith(o.rstrip("/") + "/") for o in plain)]


def scan_documents(spark: SparkSession, paths: str | Sequence[str], require: bool = True) -> DataFrame:
    """Documents under the given files and folders, each path once.

    The suffix test is not left to a glob, which is case-sensitive; only paths are read
    until something asks for the content. Paths that lie under another given one are left out
    first, so no file is listed twice and no content is shuffled to find copies.
    """
    wanted = outermost([paths] if isinstance(paths, str) else list(paths))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted)
    found = files.where(is_document_path(F.col("path")))
    if require and found.select("path").isEmpty():
        raise FileNotFoundError(f"no documents under {', '.join(wanted)}")
    return found.withColumn("kind", sniff_kind(F.col("content")))


def read_conversations_sft(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Fine-tuning samples, JSON arrays of ``messages`` and ``images``; a broken file gives a row of nulls."""
    schema = f"messages {MESSAGES_TYPE}, images array<string>"
    reader = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE")
    return reader.json(paths if isinstance(paths, str) else list(paths))


def read_region_json(results: DataFrame, column: str = "json_result") -> DataFrame:
    """Regions of results given as JSON text, a list of pages of regions.

    Text that is no JSON list keeps one row with ``raw_text``. Pages that are no list and
    blocks that are no object are passed over. Missing fields get their defaults.
    """
    rest = [c for c in results.columns if c != column]
    parsed = results.withColumn("_pages", F.from_json(column, "array<string>"))
    pages = parsed.select(
        *rest,
        F.when(F.col("_pages").isNull(), F.col(column)).alias("raw_text"),
        F.posexplode_outer("_pages").alias("page_idx", "_page"),
    )
    # a page without blocks leaves no row, as before exploding it held none
    blocks = pages.select(
        *rest, "raw_text", "page_idx", F.explode_outer(F.from_json("_page", "array<string>")).alias("_text")
    )
    block = blocks.withColumn("b", F.from_json("_text", BLOCK_TYPE))
    zeros = F.array(*[F.lit(0.0)] * 4)
    usable = F.col("raw_text").isNotNull() | F.ltrim(F.col("_text")).startswith("{")
    return block.where(usable).select(
        *rest,
        "raw_text",
        "page_idx",
        F.when(F.col("raw_text").isNull(), F.coalesce("b.index", F.lit(0))).alias("idx"),
        F.when(F.col("raw_text").isNull(), F.coalesce("b.label", F.lit("text"))).alias("label"),
        F.col("b.content").alias("content"),
        F.when(F.col("raw_text").isNull(), F.coalesce("b.bbox_2d", zeros)).alias("bbox_2d"),
    )


def normalised_service_box(box: Column, width: Column, height: Column) -> Column:
    """Service box in thousandths; unchanged without page size or with other than four sides."""
    usable = (F.size(box) == 4) & (width > 0) & (height > 0)
    scaled = F.transform(
        box, lambda side, i: to_thousandths_rounded(side, F.when(i % 2 == 0, width).otherwise(height))
    )
    return F.when(usable, scaled).otherwise(F.transform(box, lambda side: side.cast("int")))


def parse_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    return responses.withColumn("parsed", F.from_json(column, RESPONSE_TYPE))


def read_service_response(responses: DataFrame, column: str = "response") -> DataFrame:
    """Regions of service responses, boxes brought to thousandths of the page.

    A page without regions keeps one row without position, a response without pages one without page.
    """
    rest = [c for c in responses.columns if c != column]
    parsed = parse_responses(responses, column)
    pages = parsed.select(
        *rest,
        F.col("parsed.data_info.pages").alias("_sizes"),
        F.posexplode_outer("parsed.layout_details").alias("page_idx", "_page"),
    )
    regions = pages.select(
        *rest,
        "page_idx",
        F.get("_sizes", F.col("page_idx")).alias("_size"),
        F.posexplode_outer("_page").alias("pos", "r"),
    )
    return regions.select(
        *rest,
        "page_idx",
        "pos",
        F.when(F.col("pos").isNotNull(), F.coalesce("r.index", F.lit(0))).alias("idx"),
        F.when(F.col("pos").isNotNull(), F.coalesce("r.label", F.lit("text"))).alias("label"),
        F.when(F.col("pos").isNotNull(), F.coalesce("r.content", F.lit(""))).alias("content"),
        normalised_service_box(
            F.col("r.bbox_2d"), F.coalesce("_size.width", F.lit(0)), F.coalesce("_size.height", F.lit(0))
        ).alias("bbox_2d"),
    )


def extract_text(response: Column) -> Column:
    """Markdown of a response, null when it holds none as a string."""
    top = F.try_parse_json(response)

    def string_at(path: str) -> Column:
        member = F.try_variant_get(top, path, "variant")
        return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(top, path, "string"))

    return F.coalesce(string_at("$.md_results"), string_at("$.data.md_results"))


def response_envelope(responses: DataFrame, response: str = "response", source: str = "source", failure: str | None = None) -> DataFrame:
    """Uniform result rows: ``ok, text, layout_details, result, error, source, source_type``."""
    text = extract_text(F.col(response))
    rows = responses.withColumn("_text", text)
    message = F.when(F.col("_text").isNull(), "Invalid response schema: unable to extract text")
    if failure is not None:
        message = F.coalesce(F.col(failure), message)
    rows = rows.withColumn("_message", message)
    ok = F.col("_message").isNull()
    is_url = F.col(source).startswith("http://") | F.col(source).startswith("https://")
    return rows.select(
        *[c for c in responses.columns if c not in (response, failure)],
        ok.alias("ok"),
        F.when(ok, F.col("_text")).otherwise("").alias("text"),
        F.when(ok, F.get_json_object(response, "$.layout_details")).alias("layout_details"),
        F.when(ok, F.col(response)).alias("result"),
        F.when(~ok, F.struct(F.lit("API_ERROR").alias("code"), F.col("_message").alias("message"))).alias("error"),
        F.when(is_url, "url").otherwise("file").alias("source_type"),
    )


def read_progress(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Worker snapshots, one JSON file each; a broken file gives a row of nulls."""
    rows = (
        spark.read.schema(PROGRESS_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("ignoreMissingFiles", "true")
        .json(paths if isinstance(paths, str) else list(paths))
    )
    return rows.withColumn("worker", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
