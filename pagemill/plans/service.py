"""From the responses of a recognition service to results like those of the local chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import tags
from pagemill.sources import readers


def service_results(responses: DataFrame, loaded: DataFrame, prefix: str = "cropped") -> tuple[DataFrame, DataFrame]:
    """Results ``unit_id, n_pages, markdown, usage, data_info`` and their regions with ``image_path``.

    ``responses`` has one row ``unit_id, response`` per document, ``loaded`` the pages whose image can be cropped. Boxes of
    regions and of references in the text are brought to thousandths; references to image regions then name files.
    ``usage`` and ``data_info`` are carried as the JSON they came as, null where a response has none.
    """
    parsed = readers.parse_responses(responses)
    sizes = parsed.select("unit_id", F.posexplode("parsed.data_info.pages").alias("page_idx", "size"))
    sizes = sizes.select("unit_id", "page_idx", "size.width", "size.height")
    documents = parsed.select(
        "unit_id",
        F.coalesce(F.size("parsed.layout_details"), F.lit(0)).alias("n_pages"),
        F.coalesce(F.get_json_object("response", "$.md_results"), F.lit("")).alias("markdown"),
        F.get_json_object("response", "$.usage").alias("usage"),
        F.get_json_object("response", "$.data_info").alias("data_info"),
    )
    regions = readers.read_service_response(responses).where("pos is not null")
    return tags.resolve_tags(tags.rewrite_references(documents, sizes), regions, loaded, prefix)
