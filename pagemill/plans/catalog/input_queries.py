"""Queries on sources, responses, units and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import boxes
from pagemill.functions import source as source_functions
from pagemill.operators import pages as page_rules
from pagemill.operators import seams
from pagemill.operators.geometry import task_of
from pagemill.plans.catalog.registry import query
from pagemill.plans.catalog.text_queries import _case
from pagemill.plans.fixtures import Inputs, duckdb_with
from pagemill.sources import readers

PAGE = ["unit_id", "page_idx"]


# --- what an input is --------------------------------------------------------


def _contents(i: Inputs):
    text = F.encode("text", "utf-8")
    heads = ["255044462D", "89504E470D0A1A0A", "FFD8FF", ""]
    content = _case(
        [(k, F.concat(F.unhex(F.lit(h)), text)) for k, h in enumerate(heads)], F.col("doc_id") % 4, text
    )
    return i.table("documents").select("doc_id", "text", content.alias("content"))


_KIND = "case doc_id%4 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'image/jpeg' else 'application/octet-stream' end"
_HEAD = "(case doc_id%4 when 0 then unhex('255044462D') when 1 then unhex('89504E470D0A1A0A') when 2 then unhex('FFD8FF') else unhex('') end || encode(text))"


@query("sniff_kind", duckdb_with([], f"select doc_id, {_KIND} as kind from documents"))
def _(i: Inputs):
    return _contents(i).select("doc_id", source_functions.sniff_kind(F.col("content")).alias("kind"))


@query(
    "classify_source",
    duckdb_with(
        [],
        """select doc_id, case doc_id%6 when 0 then 'url' when 1 then 'data_uri' when 2 then 'file_url' when 3 then 'path'
when 4 then case when length(to_base64(encode(text))) >= 128 then 'base64' else 'path' end else case when length(rtrim(to_base64(encode(text)), '=')) >= 128 then 'base64' else 'path' end end as kind from documents""",
    ),
)
def _(i: Inputs):
    name = F.col("doc_id").cast("string")
    encoded = F.base64(F.encode("text", "utf-8"))
    text = _case(
        [
            (0, F.concat(F.lit("https://a.b/"), name)),
            (1, F.concat(F.lit("data:image/png;base64,"), encoded)),
            (2, F.concat(F.lit("file:///d/"), name)),
            (3, F.concat(F.lit("scans/"), F.repeat(name, F.lit(200)), F.lit(".pdf"))),
            (4, F.concat(F.lit(" "), encoded, F.lit("\n"))),
        ],
        F.col("doc_id") % 6,
        F.rtrim(encoded, F.lit("=")),
    )
    return i.table("documents").select("doc_id", source_functions.classify_source(text).alias("kind"))


@query(
    "data_uri_round_trip",
    duckdb_with(
        [],
        f"""select doc_id, md5('data:' || {_KIND} || ';base64,' || to_base64({_HEAD})) as uri, md5({_HEAD}) as decoded, length(to_base64({_HEAD}))+10 as n_marked from documents""",
    ),
)
def _(i: Inputs):
    rows = _contents(i).withColumns(
        {
            "uri": source_functions.to_data_uri(F.col("content")),
            "marked": source_functions.to_marked_base64(F.col("content")),
        }
    )
    return rows.select(
        "doc_id",
        F.md5("uri").alias("uri"),
        F.md5(source_functions.from_data_uri(F.when(F.col("doc_id") % 2 == 0, F.col("uri")).otherwise(F.col("marked")))).alias("decoded"),
        F.length("marked").alias("n_marked"),
    )


@query(
    "source_display_name",
    duckdb_with(
        [],
        "select page_id, case page_id%3 when 0 then 'document_' || page_id when 1 then '/d/' || page_id else url end as name from pages",
    ),
)
def _(i: Inputs):
    number = F.col("page_id")
    source = F.when(number % 3 == 1, F.concat(F.lit("file:///d/"), number.cast("string"))).otherwise(F.col("url"))
    return i.table("pages").select(
        "page_id", source_functions.source_display_name(source, number % 3 == 0, number).alias("name")
    )


@query(
    "to_file_url",
    duckdb_with(
        [],
        "select page_id, case page_id%3 when 0 then url when 1 then 'file:///base/scan' || page_id || '.png' else 'file:///abs/' || page_id end as name from pages",
    ),
)
def _(i: Inputs):
    number = F.col("page_id").cast("string")
    source = _case(
        [(0, F.col("url")), (1, F.concat(F.lit("scan"), number, F.lit(".png")))],
        F.col("page_id") % 3,
        F.concat(F.lit("/abs/"), number),
    )
    return i.table("pages").select("page_id", source_functions.to_file_url(source, "/base").alias("name"))


# --- recognition results -----------------------------------------------------


@query(
    "read_region_json",
    duckdb_with(
        ["fx_regions"],
        """select unit_id, page_idx as doc_page, cast(null as varchar) as raw_text, cast(k as int) as page_idx, case when k=0 then idx else 0 end as idx, case when k=0 then native_label else 'text' end as label,
case when k=0 then content end as content, case when k=0 then bx1::double else 0.0::double end as x1, case when k=0 then by2::double else 0.0::double end as y2 from fx_regions, (values (0), (2)) v(k)
union all select distinct unit_id, page_idx, 'plain words', null, null, null, null, null, null from fx_regions where page_idx=1""",
    ).replace("cast(k as int) as page_idx", "cast(k as int) as page_idx", 1),
)
def _(i: Inputs):
    # per region: a page with the region, a page that is no list, a page with bare blocks
    block = F.to_json(
        F.struct(
            F.col("idx").alias("index"),
            F.col("native_label").alias("label"),
            F.col("content"),
            F.array("bx1", "by1", "bx2", "by2").alias("bbox_2d"),
        )
    )
    text = F.concat(F.lit("[["), block, F.lit(', 5], {"not": "a list"}, [{}]]'))
    regions = i.regions().select("unit_id", F.col("page_idx").alias("doc_page"), text.alias("json_result"))
    words = i.regions().where("page_idx = 1").select("unit_id", F.col("page_idx").alias("doc_page")).distinct()
    both = regions.unionByName(words.withColumn("json_result", F.lit("plain words")))
    return readers.read_region_json(both).select(
        "unit_id",
        "doc_page",
        "raw_text",
        "page_idx",
        "idx",
        "label",
        "content",
        F.col("bbox_2d")[0].alias("x1"),
        F.col("bbox_2d")[3].alias("y2"),
    )


def _responses(i: Inputs):
    """One response per region: a sized page with it, and a page without size."""
    box = F.array("bx1", "by1", "bx2", "by2")
    region = F.struct(F.col("idx").alias("index"), F.col("native_label").alias("label"), F.col("content"), box.alias("bbox_2d"))
    bare = F.struct(
        F.lit(None).cast("int").alias("index"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("content"),
        box.alias("bbox_2d"),
    )
    sized = i.regions().join(i.doc_pages(), PAGE)
    body = F.struct(
        F.array(F.array(region), F.array(bare)).alias("layout_details"),
        F.col("content").alias("md_results"),
        F.struct(F.array(F.struct("width", "height")).alias("pages")).alias("data_info"),
        F.struct(F.lit(7).alias("total_tokens")).alias("usage"),
    )
    return sized.select("unit_id", F.col("page_idx").alias("doc_page"), F.col("idx").alias("doc_idx"), F.to_json(body).alias("response"))


@query(
    "read_service_response",
    duckdb_with(
        ["fx_regions", "fx_doc_pages"],
        """select unit_id, r.page_idx as doc_page, idx as doc_idx, cast(k as int) as page_idx, case k when 0 then idx else 0 end as idx, case k when 0 then native_label else 'text' end as label,
case k when 0 then coalesce(content, '') else '' end as content, case k when 0 then cast(round_even(bx1*1000.0::double/width,0) as int) else bx1 end as x1,
case k when 0 then cast(round_even(by2*1000.0::double/height,0) as int) else by2 end as y2
from fx_regions r join fx_doc_pages p using (unit_id, page_idx), (values (0), (1)) v(k)""",
    ),
)
def _(i: Inputs):
    rows = readers.read_service_response(_responses(i))
    return rows.select(
        "unit_id", "doc_page", "doc_idx", "page_idx", "idx", "label", "content",
        F.col("bbox_2d")[0].alias("x1"), F.col("bbox_2d")[3].alias("y2"),
    )


def _bodies(i: Inputs):
    text = F.struct(F.col("text").alias("md_results"))
    body = _case(
        [
            (0, F.to_json(text)),
            (1, F.to_json(F.struct(text.alias("data")))),
            (2, F.concat(F.lit('{"md_results": 5, "data": '), F.to_json(text), F.lit("}"))),
            (3, F.lit('{"md_results": {"a": 1}}')),
        ],
        F.col("doc_id") % 5,
        F.lit("not json"),
    )
    source = F.when(F.col("doc_id") % 2 == 0, "https://a.b/c").otherwise("c.png")
    return i.table("documents").select("doc_id", body.alias("response"), source.alias("source"))


@query(
    "extract_text",
    duckdb_with([], "select doc_id, case when doc_id%5 < 3 then md5(text) end as digest from documents"),
)
def _(i: Inputs):
    return _bodies(i).select("doc_id", F.md5(readers.extract_text(F.col("response"))).alias("digest"))


@query(
    "response_envelope",
    duckdb_with(
        [],
        """select doc_id, doc_id%5<3 as ok, case when doc_id%5<3 then md5(text) else md5('') end as digest, case when doc_id%5>=3 then 'API_ERROR' end as code,
case when doc_id%2=0 then 'url' else 'file' end as source_type from documents""",
    ),
)
def _(i: Inputs):
    rows = readers.response_envelope(_bodies(i))
    return rows.select("doc_id", "ok", F.md5("text").alias("digest"), F.col("error.code").alias("code"), "source_type")


# --- units and pages ---------------------------------------------------------


@query(
    "number_pages",
    duckdb_with(
        ["fx_doc_pages"],
        """with counts as (select unit_id, count(*) as n from fx_doc_pages group by 1),
offsets as (select unit_id, coalesce(sum(n) over (order by unit_id desc rows between unbounded preceding and 1 preceding), 0) as b from counts)
select unit_id, page_idx, cast(b+page_idx as bigint) as global_page from fx_doc_pages join offsets using (unit_id)""",
    ),
)
def _(i: Inputs):
    # units in descending order of their id
    units = i.doc_pages().select("unit_id").distinct().withColumn("unit_idx", F.lit(1_000_000) - F.col("unit_id"))
    numbered = page_rules.number_pages(i.doc_pages(), units)
    return numbered.select(*PAGE, F.col("global_page").cast("bigint").alias("global_page"))


@query(
    "local_page_index",
    duckdb_with(
        ["fx_pages"],
        "select unit_id, page_idx as page_no, cast(row_number() over (partition by unit_id order by page_idx)-1 as int) as local_idx from fx_pages where page_idx<>1",
    ),
)
def _(i: Inputs):
    pages = i.pages().where("page_idx <> 1").select("unit_id", F.col("page_idx").alias("page_no"))
    return page_rules.local_page_index(pages, "page_no", "local_idx")


@query("limit_pages", duckdb_with(["fx_pages"], "select unit_id, page_idx from fx_pages where page_idx < 3"))
def _(i: Inputs):
    return page_rules.limit_pages(i.pages(), "3").select(*PAGE)


@query("page_range", duckdb_with(["fx_pages"], "select unit_id, page_idx from fx_pages where page_idx between 1 and 2"))
def _(i: Inputs):
    return page_rules.page_range(i.pages(), 2, 3).select(*PAGE)


@query(
    "plan_render",
    duckdb_with(
        ["fx_pages"],
        """select unit_id, page_idx, case when greatest(width, height)*2*(200/72.0::double) > 3500 then 3500.0::double/(greatest(width, height)*2) else 200/72.0::double end as scale from fx_pages""",
    ),
)
def _(i: Inputs):
    scale = boxes.plan_render(F.col("width") * 2, F.col("height") * 2, 200, 3500)
    return i.pages().select(*PAGE, scale.alias("scale"))




@query(
    "smart_resize",
    duckdb_with(
        ["fx_pages"],
        """with dims as (select unit_id, page_idx, cast(case page_idx when 0 then height*12 when 1 then 40 else height end as double) as h, cast(case page_idx when 0 then width*12 when 1 then 60 else width end as double) as w from fx_pages),
near as (select *, round_even(h/28, 0)*28 as nh, round_even(w/28, 0)*28 as nw from dims)
select unit_id, page_idx, cast(case when nh*nw > 11760000 then floor(h/sqrt(h*w/11760000)/28)*28 when nh*nw < 12544 then ceil(h*sqrt(12544/(h*w))/28)*28 else nh end as int) as new_h,
cast(case when nh*nw > 11760000 then floor(w/sqrt(h*w/11760000)/28)*28 when nh*nw < 12544 then ceil(w*sqrt(12544/(h*w))/28)*28 else nw end as int) as new_w from near""",
    ),
)
def _(i: Inputs):
    def dim(name: str, small: int):
        return (
            F.when(F.col("page_idx") == 0, F.col(name) * 12).when(F.col("page_idx") == 1, small).otherwise(F.col(name))
        )

    size = boxes.smart_resize(dim("height", 40), dim("width", 60), F.lit(1))
    return i.pages().select(*PAGE, size.alias("s")).select(*PAGE, F.col("s.h").alias("new_h"), F.col("s.w").alias("new_w"))


@query(
    "tolerant_expand",
    duckdb_with(
        [],
        """with t as (select doc_id, case when doc_id%7=0 then 'unreadable' end as error, string_split(text, chr(10)) as lines from documents),
p as (select doc_id, error, case when error is null and doc_id%7<>1 then list_filter(lines, lambda l: length(l)%5<>0) else [] end as ls from t)
select doc_id as unit_id, error, cast(k as int) as page_idx, ls[k+1] as page from p, lateral (select unnest(range(0, len(ls))) as k) u
union all select doc_id, error, null, null from p where len(ls)=0""",
    ),
)
def _(i: Inputs):
    lines = F.transform(F.split("text", "\n"), lambda line: F.when(F.length(line) % 5 != 0, line))
    none = F.array().cast("array<string>")
    pages = F.when(F.col("doc_id") % 7 == 1, none).otherwise(lines)
    error = F.when(F.col("doc_id") % 7 == 0, "unreadable")
    units = i.table("documents").select(F.col("doc_id").alias("unit_id"), pages.alias("lines"), error.alias("failure"))
    found = page_rules.tolerant_expand(units, F.col("lines"), F.col("failure"))
    return found.select("unit_id", "error", "page_idx", "page")


@query(
    "units_without_pages",
    duckdb_with(["fx_regions"], "select doc_id as unit_id from documents where doc_id not in (select unit_id from fx_regions where page_idx > 0)"),
)
def _(i: Inputs):
    units = i.table("documents").select(F.col("doc_id").alias("unit_id"))
    return page_rules.units_without_pages(units, i.regions().where("page_idx > 0"))


@query(
    "document_metadata",
    duckdb_with(
        ["fx_doc_pages"],
        """select d.doc_id as unit_id, n_chars as length, 'docs/' || doc_id as path, cast(coalesce(n, 0) as int) as pages, width, height, 200 as dpi from documents d
left join (select unit_id, count(*) as n, arg_min(width, page_idx) as width, arg_min(height, page_idx) as height from fx_doc_pages where unit_id%10<>3 group by 1) p on p.unit_id=d.doc_id""",
    ),
)
def _(i: Inputs):
    units = i.table("documents").select(
        F.col("doc_id").alias("unit_id"),
        F.col("n_chars").alias("length"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
    )
    found = page_rules.document_metadata(units, i.doc_pages().where("unit_id % 10 <> 3"))
    return found.select("unit_id", "length", "path", "pages", "width", "height", "dpi")


@query("page_batches", duckdb_with(["fx_doc_pages"], "select unit_id, cast(page_idx//3 as int) as batch, count(*) as n from fx_doc_pages group by 1, 2"))
def _(i: Inputs):
    return page_rules.page_batches(i.doc_pages(), 3).groupBy("unit_id", "batch").agg(F.count(F.lit(1)).alias("n"))


_FILES = "files as (select distinct url as path from pages)"


@query(
    "round_robin",
    duckdb_with([], f"with {_FILES}\nselect path, cast((row_number() over (order by path)-1)%3 as int) as shard from files"),
)
def _(i: Inputs):
    files = i.table("pages").select(F.col("url").alias("path")).dropDuplicates(["path"])
    return page_rules.round_robin(files, 3)


@query(
    "reshard",
    duckdb_with(
        [],
        f"""with {_FILES}, dealt as (select path, (row_number() over (order by path)-1)%3 as shard from files)
select path, cast(shard as int) as shard from dealt where shard<>1
union all select path, cast(case (row_number() over (order by path)-1)%2 when 0 then 0 else 2 end as int) from dealt where shard=1""",
    ),
)
def _(i: Inputs):
    files = i.table("pages").select(F.col("url").alias("path")).dropDuplicates(["path"])
    return page_rules.reshard(page_rules.round_robin(files, 3), [1], [0, 2])


# --- models ------------------------------------------------------------------


def _load_detector():
    def detect(images):
        if any(len(image) % 11 == 0 for image in images):
            raise ValueError("cannot see")
        return [
            [
                {"cls_id": 22, "score": 0.9, "x1": 0.0, "y1": float(k), "x2": float(len(image)), "y2": k + 1.0, "order_seq": k}
                for k in range(len(image) % 3)
            ]
            for image in images
        ]

    return detect


@query(
    "apply_detector",
    duckdb_with(
        [],
        """with t as (select doc_id, strlen(text) as n from documents)
select doc_id as unit_id, cast(k as int) as det_id, n::double as x2 from t, lateral (select unnest(range(0, n%3)) as k) u where n%11<>0""",
    ),
)
def _(i: Inputs):
    pages = i.table("documents").select(
        F.col("doc_id").alias("unit_id"), F.lit(0).alias("page_idx"), F.encode("text", "utf-8").alias("image")
    )
    found = seams.detections_of(seams.apply_detector(pages, _load_detector, batch=4))
    return found.select("unit_id", "det_id", "x2")


def _load_recogniser():
    def recognise(rows):
        if any(row["idx"] == 6 for row in rows):
            raise RuntimeError("overloaded")
        return [(503, "busy") if row["idx"] == 5 else (200, f" {row['native_label']} ") for row in rows]

    return recognise


@query(
    "apply_recogniser",
    duckdb_with(
        ["fx_regions"],
        """select unit_id, page_idx, idx, native_label, case when native_label='image' or idx in (5, 6) then null else native_label end as content from fx_regions where native_label <> 'header'""",
    ),
)
def _(i: Inputs):
    regions = i.regions().where("native_label <> 'header'").withColumn("task_type", task_of(F.col("native_label")))
    done = seams.apply_recogniser(regions, _load_recogniser, ["idx", "native_label"])
    return done.select(*PAGE, "idx", "native_label", "content")


def _load_renderer():
    def expand(content, max_pages):
        lines = content.decode("utf-8").split("\n")
        if len(lines) % 9 == 0:
            raise ValueError("encrypted")
        for line in lines:
            yield {"width": len(line), "height": 1, "image": line.encode("utf-8")}

    return expand


@query(
    "expand_documents",
    duckdb_with(
        ["fx_lines"],
        """with n as (select doc_id, count(*) as n from fx_lines group by 1)
select doc_id as unit_id, cast(pos as int) as page_idx, cast(length(line) as int) as width, cast(null as varchar) as error from fx_lines join n using (doc_id) where n%9<>0 and pos<5
union all select doc_id, null, null, 'encrypted' from n where n%9=0""",
    ),
)
def _(i: Inputs):
    units = i.table("documents").select(F.col("doc_id").alias("unit_id"), F.encode("text", "utf-8").alias("content"))
    return seams.expand_documents(units, _load_renderer, 5).select("unit_id", "page_idx", "width", "error")


@query("crop_regions")
def _(i: Inputs):
    # page images whose pixels are all bytes of the document, in rows of 32, the last one filled up
    size = F.greatest(F.octet_length("text"), F.lit(1))
    rows = F.ceil(size / 32).cast("int")
    pixels = F.rpad(F.encode("text", "utf-8"), rows * 32, F.lit(b"\0"))
    image = F.struct(
        rows.alias("height"), F.lit(32).alias("width"), F.lit(1).alias("nChannels"), pixels.alias("data")
    )
    images = i.doc_pages().join(
        i.table("documents").select(F.col("doc_id").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text")), "unit_id"
    ).select(*PAGE, image.alias("image"))
    outline = F.array(F.array("bx1", "by1"), F.array("bx2", "by1"), F.array("bx2", "by2"))
    crops = seams.crop_regions(images, i.regions().withColumn("polygon", outline), use_polygon=True)
    return crops.select(*PAGE, "idx", "height", "width", F.md5("data").alias("digest"))


@query(
    "processing_modes",
    duckdb_with(["fx_pages"], "select unit_id, page_idx from fx_pages where page_idx < 1"),
)
def _(i: Inputs):
    page_rules.register_mode("first_page", lambda df: page_rules.limit_pages(df, 1))
    return page_rules.run_mode("first_page", i.pages()).select(*PAGE)


