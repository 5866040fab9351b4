"""Queries on repairs across regions, document assembly and results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import source as source_functions
from pagemill.operators import assemble, content, repair, sampling, sft, tasks
from pagemill.plans.catalog.registry import query
from pagemill.plans.catalog.text_queries import FORMATTED, SQL_WORD, sql_clean
from pagemill.plans.documents import document_pages, documents, on_pages, page_documents
from pagemill.plans.fixtures import Inputs, duckdb_with
from pagemill.plans.service import service_results
from pagemill.session import materialise, shared_dir
from pagemill.sources import readers, sinks
from pagemill.sources.document_files import read_document_files, write_document_pages

PAGE = ["unit_id", "page_idx"]
REGION = "unit_id, page_idx, idx, native_label, label, content"
BOX = ["bx1", "by1", "bx2", "by2"]

_R1 = f"""{FORMATTED},
r1 as (select unit_id, page_idx, cast(row_number() over (partition by unit_id, page_idx order by idx)-1 as int) as idx, idx as src,
  native_label, label, body as content, bx1, by1, bx2, by2 from formatted where label='image' or trim(coalesce(body, '')) <> '')"""

# left to right: a row is the second of a pair when the row before opened one
_R2 = """kinds as (select *, case when native_label='formula_number' then 'n' when label='formula' then 'f' end as kind from r1),
ahead as (select *, lead(kind) over w as next_kind, lead(content) over w as next_content, lead(native_label) over w as next_native,
  lead(label) over w as next_label, lead(src) over w as next_src, lead(bx1) over w as next_bx1 from kinds window w as (partition by unit_id, page_idx order by idx)),
walk as (select unit_id, page_idx, idx, false as second, coalesce(kind <> next_kind, false) as opens from ahead where idx=0
  union all select a.unit_id, a.page_idx, a.idx, w.opens, (not w.opens) and coalesce(a.kind <> a.next_kind, false)
  from walk w join ahead a on a.unit_id=w.unit_id and a.page_idx=w.page_idx and a.idx=w.idx+1),
paired as (select a.*, opens, case when kind='n' then content else next_content end as num, case when kind='n' then next_content else content end as frm
  from ahead a join walk using (unit_id, page_idx, idx) where not second and (kind is null or kind='f' or opens)),
r2 as (select unit_id, page_idx, cast(row_number() over (partition by unit_id, page_idx order by idx)-1 as int) as idx,
  case when opens and kind='n' then next_src else src end as src,
  case when opens and kind='n' then next_native else native_label end as native_label, case when opens and kind='n' then next_label else label end as label,
  case when opens and ends_with(frm, chr(10) || '$$') then substr(frm, 1, length(frm)-3) || ' \\tag{' ||
    case when starts_with(trim(num), '(') and ends_with(trim(num), ')') then substr(trim(num), 2, length(trim(num))-2) else trim(num) end || '}' || chr(10) || '$$'
    when opens then frm else content end as content,
  case when opens and kind='n' then next_bx1 else bx1 end as bx1 from paired)"""

_R3 = f"""heads as (select *, coalesce(label='text' and trim(content) <> '' and regexp_matches(ltrim(content, ' ' || chr(10)), '^\\p{{Ll}}'), false) as low,
  coalesce(label='text' and ends_with(rtrim(content, ' ' || chr(10)), '-'), false) as hyphen from r2),
aims as (select h.*, (select min(t.idx) from heads t where t.unit_id=h.unit_id and t.page_idx=h.page_idx and t.idx>h.idx and t.low) as target from heads h),
words as (select a.*, substr(rtrim(a.content, ' ' || chr(10)), 1, length(rtrim(a.content, ' ' || chr(10)))-1) as head, ltrim(t.content, ' ' || chr(10)) as tail
  from aims a left join heads t on t.unit_id=a.unit_id and t.page_idx=a.page_idx and t.idx=a.target),
joined as (select *, lower(regexp_extract(head, '(\\S+)\\s*$', 1) || regexp_extract(tail, '^(\\S+)', 1)) as word from words),
judged as (select *, coalesce(hyphen and tail is not null and trim(head, ' ' || chr(10)) <> '' and {SQL_WORD.format('word')}, false) as fits from joined),
chain as (select unit_id, page_idx, idx, case when fits then [target] else []::int[] end as gone from judged where idx=0
  union all select j.unit_id, j.page_idx, j.idx, case when fits and not list_contains(c.gone, j.idx) then list_append(c.gone, j.target) else c.gone end
  from chain c join judged j on j.unit_id=c.unit_id and j.page_idx=c.page_idx and j.idx=c.idx+1),
left_over as (select j.* from judged j join chain c using (unit_id, page_idx, idx) where not list_contains(c.gone, j.idx)),
r3 as (select unit_id, page_idx, cast(row_number() over (partition by unit_id, page_idx order by idx)-1 as int) as idx, src, native_label, label,
  case when fits then head || tail else content end as content, bx1 from left_over)"""

_R4 = """r4 as (select unit_id, page_idx, idx, src, native_label, label, case when native_label='text' and not starts_with(content, '- ')
  and lag(native_label) over w='text' and lead(native_label) over w='text' and starts_with(lag(content) over w, '- ') and starts_with(lead(content) over w, '- ')
  and abs(bx1-lag(bx1) over w) <= 10 and abs(bx1-lead(bx1) over w) <= 10 then '- ' || content else content end as content
  from r3 window w as (partition by unit_id, page_idx order by idx))"""


def _repair_sql(*steps: str, last: str) -> str:
    chain = ",\n".join(steps)
    return duckdb_with(["fx_regions"], f"with {chain}\nselect {REGION} from {last}", recursive=True)


@query("format_regions", _repair_sql(_R1, last="r1"))
def _(i: Inputs):
    return on_pages(i.regions(), repair.format_regions).select(*PAGE, "idx", "native_label", "label", "content")


@query("merge_formula_numbers", _repair_sql(_R1, _R2, last="r2"))
def _(i: Inputs):
    rows = on_pages(i.regions(), lambda df, o: repair.merge_formula_numbers(repair.format_regions(df, o), o))
    return rows.select(*PAGE, "idx", "native_label", "label", "content")


@query("merge_hyphenated", _repair_sql(_R1, _R2, _R3, last="r3"))
def _(i: Inputs):
    rows = on_pages(i.regions(), lambda df, o: repair.repair_regions(df, o, bullets=False))
    return rows.select(*PAGE, "idx", "native_label", "label", "content")


def _parted_words(lines):
    """Last words of lines joined with the first of the next; taken before the lines meet, so no line is shuffled."""
    ends = lines.select("doc_id", "pos", F.regexp_extract("line", r"(\S+)\s*$", 1).alias("last"))
    starts = lines.select("doc_id", (F.col("pos") - 1).alias("pos"), F.regexp_extract("line", r"^\s*(\S+)", 1).alias("first"))
    return ends.join(starts, ["doc_id", "pos"]).select(F.lower(F.concat("last", "first")).alias("word")).where("word <> ''").distinct()


# the words that hyphens part, each with a frequency by its length: about half of them count as words
_LEXICON = r"""lexicon as (select distinct word, 2.0 + length(word)%2 as zipf from (
  select lower(regexp_extract(a.line, '(\S+)\s*$', 1) || regexp_extract(b.line, '^\s*(\S+)', 1)) as word
  from fx_lines a join fx_lines b on a.doc_id = b.doc_id and a.pos + 1 = b.pos) t where word <> '')"""


@query(
    "merge_hyphenated_with_lexicon",
    _repair_sql(
        _LEXICON,
        _R1,
        _R2,
        _R3.replace(SQL_WORD.format("word"), "exists (select 1 from lexicon l where l.word = joined.word and l.zipf >= 2.5)"),
        last="r3",
    ),
)
def _(i: Inputs):
    words = _parted_words(i.lines())
    lexicon = words.withColumn("zipf", F.lit(2.0) + F.length("word") % 2)
    rows = on_pages(i.regions(), lambda df, o: repair.repair_regions(df, o, bullets=False, lexicon=lexicon))
    return rows.select(*PAGE, "idx", "native_label", "label", "content")


@query("infill_bullets", _repair_sql(_R1, _R2, _R3, _R4, last="r4"))
def _(i: Inputs):
    return on_pages(i.regions(), repair.repair_regions).select(*PAGE, "idx", "native_label", "label", "content")


@query(
    "infill_bullets_on_lists",
    duckdb_with(
        ["fx_regions"],
        """with lists as (select unit_id, page_idx, idx, case when idx%3=1 then 'item' else '- item' end as c, bx1 from fx_regions)
select unit_id, page_idx, idx, case when idx%3=1 and lag(c) over w='- item' and lead(c) over w='- item' and abs(bx1-lag(bx1) over w) <= 10
  and abs(bx1-lead(bx1) over w) <= 10 then '- item' else c end as content from lists window w as (partition by unit_id, page_idx order by idx)""",
    ),
)
def _(i: Inputs):
    item = F.when(F.col("idx") % 3 == 1, "item").otherwise("- item")
    lists = i.regions().withColumns({"content": item, "native_label": F.lit("text"), "label": F.lit("text")})
    return on_pages(lists, repair.infill_bullets).select(*PAGE, "idx", "content")


@query(
    "stable_order",
    duckdb_with(
        ["fx_regions"],
        "select unit_id, page_idx, 0 as fragment, cast(count(*) as int) as n, string_agg(idx || ':' || native_label, ',' order by idx) as labels from fx_regions group by 1, 2",
    ),
)
def _(i: Inputs):
    pages = assemble.stable_order(i.regions().select(*PAGE, "idx", "native_label"))
    listed = F.array_join(
        F.transform("regions", lambda r: F.concat(r["idx"].cast("string"), F.lit(":"), r["native_label"])), ","
    )
    return pages.select(*PAGE, F.col("fragment").cast("int"), F.size("regions").alias("n"), listed.alias("labels"))


# --- assembly ----------------------------------------------------------------

_IMAGES = """images as (select r.unit_id, r.page_idx, r.idx as src, row_number() over (partition by r.unit_id order by r.page_idx, r.idx)-1 as image_no
  from fx_regions r join (select distinct * from fx_crops) c using (unit_id, page_idx, bx1, by1, bx2, by2) where r.native_label='image')"""

_TEXTS = f"""{_R1},
{_R2},
{_R3},
{_R4},
{_IMAGES},
pieces as (select r.*, case when label='image' then '![Image ' || page_idx || '-' || image_no || '](imgs/cropped_page' || page_idx || '_idx' || image_no || '.jpg)'
  else content end as piece from r4 r left join images using (unit_id, page_idx, src)),
texts as (select p.unit_id, p.page_idx, coalesce(string_agg(piece, chr(10) || chr(10) order by idx) filter (where piece <> ''), '') as page_text,
  count(idx) as n_regions from fx_doc_pages p left join pieces r using (unit_id, page_idx) group by 1, 2),
docs as (select unit_id, cast(count(*) as int) as n_pages, cast(sum(n_regions) as int) as n_regions,
  string_agg(page_text, chr(10) || chr(10) order by page_idx) as markdown from texts group by unit_id)"""
_VIEWS = ["fx_regions", "fx_doc_pages", "fx_crops"]


@query(
    "document_markdown",
    duckdb_with(
        _VIEWS, f"with {_TEXTS}\nselect unit_id, 0 as part_page, 0 as part_seq, n_pages, n_regions, markdown from docs", True
    ),
)
def _(i: Inputs):
    return page_documents(i.regions(), i.doc_pages(), crops=i.crops())


@query(
    "assemble_pages",
    duckdb_with(_VIEWS, f"with {_TEXTS}\nselect unit_id, page_idx, 0 as fragment, cast(n_regions as int) as n_regions, page_text from texts", True),
)
def _(i: Inputs):
    images = materialise(assemble.matched_crops(i.regions(), i.crops()))
    rows = on_pages(
        i.regions(), lambda df, o: repair.repair_regions(assemble.attach_image_numbers(df, images), o)
    )
    rows = assemble.with_pieces(rows)
    pages = assemble.assemble_pages(rows, i.doc_pages())
    return pages.select(*PAGE, "fragment", F.size("regions").alias("n_regions"), "page_text")


@query(
    "document_json",
    duckdb_with(
        _VIEWS,
        f"""with {_TEXTS}
select p.unit_id, cast(p.page_idx as int) as page_idx, cast(r.idx as int) as idx, r.label, r.content, case when r.label='image' and image_no is not null then 'imgs/cropped_page' || p.page_idx || '_idx' || image_no || '.jpg' end as image_path
from fx_doc_pages p left join (select r4.*, image_no from r4 left join images using (unit_id, page_idx, src)) r using (unit_id, page_idx)""",
        True,
    ),
)
def _(i: Inputs):
    pages = document_pages(i.regions(), i.doc_pages(), i.crops())
    region = "array<struct<index: int, label: string, content: string, image_path: string>>"
    return pages.select(*PAGE, F.explode_outer(F.from_json("page_json", region)).alias("r")).select(
        *PAGE, F.col("r.index").alias("idx"), "r.label", "r.content", "r.image_path"
    )


@query(
    "document_files",
    duckdb_with(
        _VIEWS,
        f"with {_TEXTS}\nselect unit_id, n_pages, n_regions, case when trim(markdown, ' ' || chr(10)) = '' then null else markdown end as markdown from docs",
        True,
    ),
)
def _(i: Inputs):
    out = f"{shared_dir(i.spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    pages = document_pages(i.regions(), i.doc_pages(), i.crops())
    named = pages.withColumns(
        {"rel_dir": F.format_string("part %d", F.col("unit_id") % 10), "stem": F.format_string("doc_%d", "unit_id"), "raw_json": F.lit(None).cast("string")}
    )
    write_document_pages(named, out, 1 + i.table("documents").count() // config.DOCUMENTS_PER_SLICE)

    lists = F.from_json("json", "array<array<struct<index: int>>>")
    found = read_document_files(i.spark, out).withColumn("pages", lists)
    counted = F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(p))
    return found.select("unit_id", F.size("pages").alias("n_pages"), counted.alias("n_regions"), F.col("md").alias("markdown"))


_ONLY_FORMATTED = _TEXTS.replace("from r4 r left join images", "from r1 r left join images").replace("else content end", "else '<p>' || content || '</p>' end")


@query(
    "documents_by_formatter",
    duckdb_with(_VIEWS, f"with {_ONLY_FORMATTED}\nselect unit_id, n_pages, n_regions, markdown from docs", True),
)
def _(i: Inputs):
    def paragraphs(rows, order):
        formatted = repair.format_regions(rows, order)
        return formatted.withColumn("content", F.concat(F.lit("<p>"), "content", F.lit("</p>")))

    docs = documents(i.regions(), i.doc_pages(), i.crops(), formatter=paragraphs)
    return docs.select("unit_id", "n_pages", "n_regions", "markdown")


@query(
    "number_images",
    duckdb_with(_VIEWS, f"with {_IMAGES}\nselect unit_id, page_idx, src as idx, cast(image_no as int) as image_no from images"),
)
def _(i: Inputs):
    return assemble.matched_crops(i.regions(), i.crops()).select(*PAGE, "idx", "image_no")


@query(
    "raw_snapshot",
    duckdb_with(
        ["fx_regions"],
        "select unit_id, page_idx, cast(row_number() over (partition by unit_id, page_idx order by idx)-1 as int) as idx, native_label as label, content, bx1, by2 from fx_regions where idx <> 2",
    ),
)
def _(i: Inputs):
    rows = assemble.raw_snapshot(i.regions().where("idx <> 2"))
    return rows.select(*PAGE, "idx", "label", "content", "bx1", "by2")


@query(
    "unit_completion",
    duckdb_with(
        ["fx_unit_events"],
        """with counts as (select unit_id, count(distinct region_id) as n from fx_unit_events where kind='region_done' group by 1),
units as (select distinct unit_id from fx_unit_events where kind='unit_final')
select u.unit_id, 15+u.unit_id%6 as expected, coalesce(n, 0) as n_done, coalesce(n, 0) >= 15+u.unit_id%6 as ready from units u left join counts using (unit_id)""",
    ),
)
def _(i: Inputs):
    events = i.unit_events()
    units = events.where("kind = 'unit_final'").select("unit_id").distinct()
    units = units.withColumn("expected", F.lit(15) + F.col("unit_id") % 6)
    return assemble.unit_completion(units, events.where("kind = 'region_done'")).select(
        "unit_id", "expected", "n_done", "ready"
    )


_PLAIN = f"""src as (select doc_id as unit_id, page_idx, string_agg(line, chr(10) order by pos) as c from (select *, cast(pos//20 as int) as page_idx from fx_lines) t group by 1, 2)"""


@query(
    "format_plain_pages",
    duckdb_with(
        ["fx_lines"],
        f"""with {_PLAIN},
{sql_clean('unit_id, page_idx', 'src')}
select unit_id, 0 as part_page, cast(count(*) as int) as n_pages, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_idx) as markdown from cleaned group by 1""",
    ),
)
def _(i: Inputs):
    lines = i.lines().withColumn("page_idx", F.floor(F.col("pos") / 20).cast("int"))
    grouped = lines.groupBy(F.col("doc_id").alias("unit_id"), "page_idx").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")
    )
    texts = grouped.select(*PAGE, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
    return assemble.format_plain_pages(texts).select("unit_id", "part_page", "n_pages", "markdown")


@query(
    "merge_units",
    duckdb_with(
        ["fx_messages"],
        """select conv_id as request_id, 0 as part_unit, cast(count(*) as int) as n_units, case when count(*)=1 then min('{"t":' || turn || '}') else '[' || string_agg('{"t":' || turn || '}', ', ' order by turn) || ']' end as json_result,
string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as markdown_result from fx_messages group by 1""",
    ),
)
def _(i: Inputs):
    results = i.messages().select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("unit_idx"),
        F.concat(F.lit('{"t":'), F.col("turn").cast("string"), F.lit("}")).alias("json"),
        F.col("text").alias("markdown"),
    )
    return assemble.merge_units(results).select("request_id", "part_unit", "n_units", "json_result", "markdown_result")


_BLOCKS = """blocks as (select unit_id, page_idx, idx, cast(row_number() over (partition by unit_id order by page_idx, idx) as int) as block_id, page_idx+1 as page_index,
  native_label, content, bx1, by1, bx2, by2 from fx_regions),
merged as (select *, case when native_label='image' then '<div style="text-align: center;"><img src="file?path=split_' || page_index || '_' || lpad(block_id::varchar, cast(greatest(4, length(block_id::varchar)) as int), '0') || '.png" alt="Image"/></div>' || chr(10)
  else coalesce(content, '') end as block_content from blocks)"""


@query(
    "merge_blocks",
    duckdb_with(["fx_regions"], f"with {_BLOCKS}\nselect unit_id, page_idx, idx, block_id, page_index, block_content from merged"),
)
def _(i: Inputs):
    return assemble.merge_blocks(i.regions()).select(*PAGE, "idx", "block_id", "page_index", "block_content")


@query(
    "merged_document",
    duckdb_with(
        ["fx_regions"],
        f"with {_BLOCKS}\nselect unit_id, 0 as part_page, 0 as part_seq, cast(count(*) as int) as n_blocks, string_agg(block_content || chr(10), '' order by block_id) as full_markdown from merged group by 1",
    ),
)
def _(i: Inputs):
    report = assemble.merged_document(assemble.merge_blocks(i.regions()))
    return report.select("unit_id", "part_page", "part_seq", F.size("layout").alias("n_blocks"), "full_markdown")


@query(
    "task_report_documents",
    duckdb_with(
        ["fx_tasks", "fx_regions", "fx_doc_pages"],
        f"""with {_BLOCKS},
reports as (select unit_id, string_agg(block_content || chr(10), '' order by block_id) as full_markdown, cast(count(*) as int) as n_blocks,
  max(block_id) as last_block, max_by(page_index, block_id) as last_page, max_by(bx2, block_id) as last_x2 from merged group by 1),
metadata as (select unit_id, '{{"document_id":' || unit_id || ',"total_pages":' || count(*) || ',"widest":' || max(width) || '}}' as metadata from fx_doc_pages group by 1)
select task_id, status, priority, retry_count, worker_id, metadata, full_markdown, n_blocks, last_block, cast(last_page as int) as last_page, last_x2
from fx_tasks left join reports on task_id = reports.unit_id left join metadata on reports.unit_id = metadata.unit_id""",
    ),
)
def _(i: Inputs):
    described = i.doc_pages().groupBy("unit_id").agg(F.count("*").alias("total_pages"), F.max("width").alias("widest"))
    metadata = described.select("unit_id", F.to_json(F.struct(F.col("unit_id").alias("document_id"), "total_pages", "widest")).alias("metadata"))
    reports = assemble.merged_document(assemble.merge_blocks(i.regions()), metadata).withColumnRenamed("unit_id", "task_id")
    rows = tasks.task_report(i.tasks(), reports)
    last = F.try_element_at("layout", F.lit(-1))
    return rows.select(
        "task_id", "status", "priority", "retry_count", "worker_id", "metadata", "full_markdown",
        F.when(F.col("layout").isNotNull(), F.size("layout")).alias("n_blocks"),
        last["block_id"].alias("last_block"), last["page_index"].alias("last_page"), last["bbox"][2].alias("last_x2"),
    )


@query(
    "label_profile",
    duckdb_with(["fx_regions"], "select unit_id, page_idx, native_label, count(*) as n from fx_regions group by 1, 2, 3"),
)
def _(i: Inputs):
    return assemble.label_profile(i.regions(), "native_label")


@query(
    "profile_difference",
    duckdb_with(
        ["fx_regions"],
        """with a as (select unit_id, page_idx, native_label, count(*) as n_left from fx_regions group by 1, 2, 3),
b as (select unit_id, page_idx, native_label, count(*) as n_right from fx_regions where not (unit_id%50=0 and idx=3) group by 1, 2, 3)
select unit_id, page_idx, native_label, n_left, n_right from a full join b using (unit_id, page_idx, native_label) where n_left is distinct from n_right""",
    ),
)
def _(i: Inputs):
    left = assemble.label_profile(i.regions(), "native_label")
    right = assemble.label_profile(i.regions().where("not (unit_id % 50 = 0 and idx = 3)"), "native_label")
    return assemble.profile_difference(left, right).select(*PAGE, "native_label", "n_left", "n_right")


# --- results -----------------------------------------------------------------


def _messages(i: Inputs):
    return i.messages().select(
        "conv_id",
        "turn",
        F.concat(F.lit('[[{"t":'), F.col("turn").cast("string"), F.lit("}]]")).alias("json_result"),
        F.when(F.col("turn") % 3 != 0, F.col("text")).alias("markdown"),
        F.array(F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".png"))).alias("images"),
        F.when(F.col("turn") % 2 == 0, "broken \"pipe\"\n").alias("error"),
    )


@query(
    "result_json",
    duckdb_with(
        ["fx_messages"],
        """select conv_id, turn, turn as t, case when turn%3<>0 then text else '' end as markdown, 'img/' || conv_id || '.png' as image,
case when turn%2=0 then 'broken "pipe"' || chr(10) end as error, turn%2=0 as has_error from fx_messages""",
    ),
)
def _(i: Inputs):
    rows = _messages(i).select(
        "conv_id",
        "turn",
        sinks.to_result_json(F.col("json_result"), F.col("markdown"), F.col("images"), error=F.col("error")).alias("j"),
    )
    at = lambda path: F.get_json_object("j", path)
    return rows.select(
        "conv_id",
        "turn",
        at("$.json_result[0][0].t").cast("int").alias("t"),
        at("$.markdown_result").alias("markdown"),
        at("$.original_images[0]").alias("image"),
        at("$.error").alias("error"),
        F.col("j").contains('"error"').alias("has_error"),
    )


@query(
    "service_response",
    duckdb_with(
        ["fx_messages"],
        """select conv_id, turn, '[[{"t":' || turn || '}]]' as layout_details, text as md_results, 'default' as model, 38 as id_length from fx_messages""",
    ),
)
def _(i: Inputs):
    rows = _messages(i).join(i.messages().select("conv_id", "turn", "text"), ["conv_id", "turn"])
    results = rows.select("conv_id", "turn", "json_result", F.col("text").alias("markdown_result"))
    return sinks.to_service_response(results).select(
        "conv_id", "turn", "layout_details", "md_results", "model", F.length("id").alias("id_length")
    )


@query(
    "sanitize_name",
    duckdb_with(
        [],
        """select page_id, case when n='' then 'result' else n end as name from (select page_id,
 regexp_replace(regexp_replace(case page_id%3 when 0 then url when 1 then url || ' .. ' else '. .' end, '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g'), '[ .]+$', '') as n from pages) t""",
    ),
)
def _(i: Inputs):
    raw = (
        F.when(F.col("page_id") % 3 == 0, F.col("url"))
        .when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(" .. ")))
        .otherwise(". .")
    )
    return i.table("pages").select("page_id", source_functions.sanitize_name(raw).alias("name"))


@query(
    "output_paths",
    duckdb_with(
        ["fx_regions"],
        """select unit_id, page_idx, idx, 'imgs/' || native_label || '_page' || page_idx || '_idx' || idx || '.jpg' as crop,
'split_' || (page_idx+1) || '_' || lpad((idx*7)::varchar, 4, '0') || '.png' as block from fx_regions""",
    ),
)
def _(i: Inputs):
    return i.regions().select(
        *PAGE,
        "idx",
        source_functions.crop_path(F.col("native_label"), F.col("page_idx"), F.col("idx")).alias("crop"),
        source_functions.split_path(F.col("page_idx") + 1, F.col("idx") * 7).alias("block"),
    )


@query(
    "clean_content_rows",
    duckdb_with(
        [],
        f"""with src as (select doc_id, text as c from documents),
{sql_clean('doc_id', 'src')}
select doc_id, cast(length(body) as int) as n, md5(body) as digest from cleaned""",
    ),
)
def _(i: Inputs):
    docs = i.table("documents").select("doc_id", F.col("text").alias("c"))
    return content.clean_content(docs, "c").select("doc_id", F.length("c").alias("n"), F.md5("c").alias("digest"))


# --- fine-tuning samples -------------------------------------------------------

_SAMPLES = """samples as (select request_id, turns, case when request_id%4=0 then 0 else 1 end as tags, case when request_id%4=1 then 2 else 1 end as n_images,
  request_id%5=0 as absolute, bad_role from (select conv_id as request_id, count(*) as turns, bool_or(role not in ('user', 'assistant')) as bad_role from fx_messages group by 1) t)"""


def _samples(i: Inputs):
    """Every conversation as a sample; by its number it lacks its tag, has an image too many or an absolute path."""
    marked = F.when((F.col("turn") == F.col("first")) & (F.col("conv_id") % 4 != 0), F.concat(F.lit("<image>"), "text")).otherwise(F.col("text"))
    messages = i.messages()
    messages = messages.join(messages.groupBy("conv_id").agg(F.min("turn").alias("first")), "conv_id")
    path = F.concat(F.when(F.col("request_id") % 5 == 0, "/data/").otherwise("data/"), F.col("request_id").cast("string"), F.lit(".png"))
    listed = messages.groupBy(F.col("conv_id").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", marked.alias("content")))).alias("m")
    )
    return listed.select(
        "request_id",
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"),
        F.array_repeat(path, F.when(F.col("request_id") % 4 == 1, 2).otherwise(1)).alias("images"),
    )


_PROBLEM = """case when bad_role then 'unknown role' when tags <> n_images then 'image tags and images differ in number'
  when absolute then 'image path is not relative' end as problem"""


@query("validate_sft", duckdb_with(["fx_messages"], f"with {_SAMPLES}\nselect request_id, cast(turns as int) as n_messages, {_PROBLEM} from samples"))
def _(i: Inputs):
    return sft.validate_sft(_samples(i)).select("request_id", F.size("messages").alias("n_messages"), "problem")


@query(
    "read_conversations_sft",
    duckdb_with(
        ["fx_messages"],
        f"with {_SAMPLES}\nselect {_PROBLEM}, cast(sum(turns) as bigint) as n_messages, count(*) as n from samples group by 1",
    ),
)
def _(i: Inputs):
    folder = f"{shared_dir(i.spark).rstrip('/')}/samples-{uuid.uuid4().hex}"
    # one file per partition, each one JSON array
    rows = _samples(i).select(F.to_json(F.struct("messages", "images")).alias("j"), F.spark_partition_id().alias("p"), "request_id")
    slot = F.pmod("request_id", F.lit(1000))
    arrays = rows.groupBy("p", slot).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    read = sft.validate_sft(readers.read_conversations_sft(i.spark, folder))
    return read.groupBy("problem").agg(F.sum(F.size("messages")).alias("n_messages"), F.count(F.lit(1)).alias("n"))


@query(
    "regions_to_sft",
    duckdb_with(
        ["fx_regions"],
        """with t as (select *, case when idx%3=0 then 'text' when idx%3=1 then 'table' else 'skip' end as task from fx_regions)
select unit_id, page_idx, idx, 'crops/' || unit_id || '_' || page_idx || '_' || idx || '.png' as image, '<image>' || case task when 'text' then 'Text Recognition:' else 'Table Recognition:' end as question, content as answer
from t where task <> 'skip' and coalesce(content, '') <> ''""",
    ),
)
def _(i: Inputs):
    task = F.when(F.col("idx") % 3 == 0, "text").when(F.col("idx") % 3 == 1, "table").otherwise("skip")
    path = F.concat(F.lit("crops/"), F.concat_ws("_", *PAGE, "idx"), F.lit(".png"))
    made = sft.regions_to_sft(i.regions().withColumn("task_type", task), path)
    return made.select(
        *PAGE,
        "idx",
        F.col("images")[0].alias("image"),
        F.col("messages")[0]["content"].alias("question"),
        F.col("messages")[1]["content"].alias("answer"),
    )


_KEY = "unit_id || '-' || page_idx || '-' || idx"


@query(
    "sample_n",
    duckdb_with(["fx_regions"], f"select unit_id, page_idx, idx, content from fx_regions order by md5('7:' || {_KEY}) limit 500"),
)
def _(i: Inputs):
    rows = i.regions().select("unit_id", "page_idx", "idx", "content")
    return sampling.sample_n(rows, 500, F.concat_ws("-", "unit_id", "page_idx", "idx"), seed=7)


@query(
    "truncate_tokens",
    duckdb_with(
        [],
        r"""with cut as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '') as tokens from documents)
select doc_id, case when len(tokens) > 100 then array_to_string(tokens[1:100], ' ') else text end as text from cut""",
    ),
)
def _(i: Inputs):
    return i.table("documents").select("doc_id", sampling.truncate_tokens(F.col("text"), 100).alias("text"))


# --- the service path --------------------------------------------------------

# Markdown names every region of an image in pixels; two thirds of the pages can be cropped
_SERVICE_VIEWS = ["fx_regions", "fx_doc_pages"]
_SERVICE = """boxes as (select r.*, cast(round_even(bx1*1000.0::double/width, 0) as int) as nx1, cast(round_even(by1*1000.0::double/height, 0) as int) as ny1,
  cast(round_even(bx2*1000.0::double/width, 0) as int) as nx2, cast(round_even(by2*1000.0::double/height, 0) as int) as ny2,
  r.native_label = 'image' and (unit_id+page_idx)%3 <> 0 as cropped from fx_regions r join fx_doc_pages p using (unit_id, page_idx)),
shown as (select *, cast(count(*) filter (where cropped) over (partition by unit_id order by page_idx, idx) - 1 as varchar(20)) as image_no from boxes)"""


def _service_responses(i: Inputs):
    box = F.array(*BOX)
    image = F.col("native_label") == "image"
    tag = F.concat(F.lit("![](page="), F.col("page_idx").cast("string"), F.lit(",bbox=["), F.concat_ws(",", *BOX), F.lit("])"))
    region = F.struct(
        F.col("idx").alias("index"), F.col("native_label").alias("label"), "content", box.alias("bbox_2d")
    )
    piece = F.when(image, tag).otherwise(F.coalesce("content", F.lit("")))
    by_page = i.regions().groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("idx", region.alias("r"), piece.alias("t")))).alias("rows"))
    pages = i.doc_pages().join(by_page, PAGE, "left")
    empty = F.array().cast(by_page.schema["rows"].dataType)
    whole = pages.groupBy("unit_id").agg(
        F.sort_array(F.collect_list(F.struct("page_idx", "width", "height", F.coalesce("rows", empty).alias("rows")))).alias("pages")
    )
    response = F.struct(
        F.transform("pages", lambda p: F.transform(p["rows"], lambda r: r["r"])).alias("layout_details"),
        F.array_join(F.flatten(F.transform("pages", lambda p: F.transform(p["rows"], lambda r: r["t"]))), "\n").alias("md_results"),
        F.struct(F.transform("pages", lambda p: F.struct(p["width"].alias("width"), p["height"].alias("height"))).alias("pages")).alias("data_info"),
        F.struct(F.col("unit_id").alias("total_tokens")).alias("usage"),
    )
    return whole.select("unit_id", F.to_json(response, {"ignoreNullFields": "false"}).alias("response"))


@query(
    "service_results",
    duckdb_with(
        _SERVICE_VIEWS,
        f"""with {_SERVICE},
texts as (select unit_id, string_agg(case when native_label <> 'image' then coalesce(content, '')
    when cropped then '![Image ' || page_idx || '-' || image_no || '](imgs/cropped_page' || page_idx || '_idx' || image_no || '.jpg)'
    else '![](page=' || page_idx || ',bbox=[' || nx1 || ', ' || ny1 || ', ' || nx2 || ', ' || ny2 || '])' end, chr(10) order by page_idx, idx) as markdown
  from shown group by unit_id),
sizes as (select unit_id, cast(count(*) as int) as n_pages, cast(max(width) as int) as widest from fx_doc_pages group by unit_id)
select unit_id, n_pages, markdown, unit_id as total_tokens, widest from texts join sizes using (unit_id)""",
    ),
)
def _(i: Inputs):
    results, _ = service_results(_service_responses(i), i.doc_pages().where("(unit_id + page_idx) % 3 <> 0"))
    widths = F.from_json("data_info", "struct<pages: array<struct<width: int>>>")["pages"]["width"]
    tokens = F.get_json_object("usage", "$.total_tokens").cast("bigint")
    return results.select("unit_id", "n_pages", "markdown", tokens.alias("total_tokens"), F.array_max(widths).alias("widest"))


@query(
    "service_regions",
    duckdb_with(
        _SERVICE_VIEWS,
        f"""with {_SERVICE}
select unit_id, cast(page_idx as int) as page_idx, cast(idx as int) as idx, native_label as label, coalesce(content, '') as content, nx1, ny2,
  case when cropped then 'imgs/cropped_page' || page_idx || '_idx' || image_no || '.jpg' end as image_path from shown""",
    ),
)
def _(i: Inputs):
    _, regions = service_results(_service_responses(i), i.doc_pages().where("(unit_id + page_idx) % 3 <> 0"))
    box = F.col("bbox_2d")
    return regions.select(*PAGE, "idx", "label", "content", box[0].alias("nx1"), box[3].alias("ny2"), "image_path")
