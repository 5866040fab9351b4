"""Inputs derived from the given tables, as DataFrames and as SQL for the check.

The tables hold no boxes or recognised regions, so pages, detections, regions,
tasks, messages and unit events are computed from them by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = """
select cast(floor(o_orderkey/4.0) as bigint) as unit_id, cast(o_orderkey%4 as int) as page_idx,
       cast(800+(o_custkey%5)*150 as int) as width, cast(1000+(o_custkey%3)*200 as int) as height
from orders"""

DETECTIONS = """
select cast(floor(l_orderkey/4.0) as bigint) as unit_id, cast(l_orderkey%4 as int) as page_idx,
  cast(row_number() over (partition by l_orderkey
       order by l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 as int) as det_id,
  cast(l_partkey%25 as int) as cls_id,
  cast((l_partkey*31+l_suppkey*17+l_linenumber*7)%1000 as double)/1000 as score,
  cast((l_partkey*37)%500-20 as double) as x1, cast((l_suppkey*53)%600-20 as double) as y1,
  cast((l_partkey*37)%500+180+l_quantity*8 as double) as x2,
  cast((l_suppkey*53)%600+180+l_quantity*8 as double) as y2,
  cast((l_partkey+l_linenumber*13)%40 as int) as order_seq
from lineitem"""

LINES_DUCKDB = """
select doc_id, generate_subscripts(string_split(text,chr(10)),1)-1 as pos,
       unnest(string_split(text,chr(10))) as line from documents"""

REGIONS = """
select doc_id as unit_id, cast(floor(pos/8.0) as int) as page_idx, cast(pos%8 as int) as idx,
  case (doc_id*7+pos)%12 when 0 then 'doc_title' when 1 then 'paragraph_title' when 2 then 'display_formula'
    when 3 then 'formula_number' when 4 then 'table' when 5 then 'image' when 6 then 'header' else 'text' end as native_label,
  case (doc_id*7+pos)%12 when 2 then '$$' || 'x_' || cast(pos as varchar(20)) || '$$'
    when 3 then '(' || cast(pos as varchar(20)) || ')'
    when 4 then '<table><tr><td>' || line || '</td></tr></table>' when 5 then null
    when 7 then '* ' || line when 8 then line || '-' when 9 then lower(line)
    when 10 then '1.' || line || '.....' else line end as content,
  cast((doc_id*13+pos*7)%400 as int) as bx1, cast((pos%8)*120 as int) as by1,
  cast((doc_id*13+pos*7)%400+500 as int) as bx2, cast((pos%8)*120+100 as int) as by2
from fx_lines"""

# Pages that carry regions, with one empty page in front of the last one of every
# third unit so that empty pages are exercised.
DOC_PAGES = """
select unit_id, page_idx, cast(800+(unit_id%5)*150 as int) as width,
       cast(1000+(page_idx%3)*200 as int) as height
from (select distinct unit_id, page_idx from fx_regions
      union
      select unit_id, cast(max(page_idx)+1 as int) as page_idx from fx_regions
      where unit_id%3=0 group by unit_id) p"""

# Crops exist for two thirds of the image regions.
CROPS = """
select unit_id, page_idx, bx1, by1, bx2, by2 from fx_regions
where native_label='image' and (unit_id+page_idx+idx)%3<>0"""

TASKS = """
select o_orderkey as task_id,
  case o_orderkey%6 when 0 then 'pending' when 1 then 'processing' when 2 then 'completed'
    when 3 then 'failed' when 4 then 'cancelled' else 'dead_letter' end as status,
  cast(case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '5-LOW' then 1 else 2 end as int) as priority,
  cast(o_orderkey%5 as int) as retry_count, 3 as max_retries, 60 as retry_delay,
  case when o_orderkey%6 in (1) then 'worker-' || cast(o_custkey%5+1 as varchar(10)) end as worker_id,
  o_orderdate as created_at,
  case when o_orderkey%6 in (1,2,3) then o_orderdate + interval 1 day end as started_at,
  case when o_orderkey%6 in (2,3,4) then o_orderdate + interval 3 day end as completed_at,
  case when o_orderkey%6=1 then o_orderdate + interval 2 day end as lock_expires_at,
  case o_orderkey%7 when 0 then 'Request timeout' when 1 then 'connection reset' when 2 then 'invalid page'
    when 3 then 'file not found' when 4 then 'Rate limit hit' when 5 then 'boom' end as error_message
from orders"""

MESSAGES = """
select conv_id, cast(turn as int) as turn, role, text from conversations"""

UNIT_EVENTS = """
select event_id, ts, user_id as unit_id,
  case event_type when 'signup' then 'unit_final' else 'region_done' end as kind,
  cast(event_id%20 as int) as region_id
from events"""

_SQL = {
    "fx_pages": (PAGES, []),
    "fx_detections": (DETECTIONS, []),
    "fx_lines": (LINES_DUCKDB, []),
    "fx_regions": (REGIONS, ["fx_lines"]),
    "fx_doc_pages": (DOC_PAGES, ["fx_regions"]),
    "fx_crops": (CROPS, ["fx_regions"]),
    "fx_tasks": (TASKS, []),
    "fx_messages": (MESSAGES, []),
    "fx_unit_events": (UNIT_EVENTS, []),
}


def duckdb_with(names: list[str], body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in _SQL[name][1]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} as ({_SQL[name][0]})" for name in ordered)
    body = body.strip()
    head = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"


class Inputs:
    """The given tables and the derived inputs of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **views: DataFrame) -> DataFrame:
        for name, df in views.items():
            text = text.replace(f"from {name}", f"from {{{name}}}")
        return self.spark.sql(text.replace("varchar(20)", "string").replace("varchar(10)", "string"), **views)

    def pages(self) -> DataFrame:
        return self._sql(PAGES, orders=self.table("orders"))

    def detections(self) -> DataFrame:
        return self._sql(DETECTIONS, lineitem=self.table("lineitem"))

    def lines(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))

    def regions(self) -> DataFrame:
        return self._sql(REGIONS, fx_lines=self.lines())

    def doc_pages(self) -> DataFrame:
        return self._sql(DOC_PAGES, fx_regions=self.regions())

    def crops(self) -> DataFrame:
        return self._sql(CROPS, fx_regions=self.regions())

    def tasks(self) -> DataFrame:
        return self._sql(TASKS, orders=self.table("orders"))

    def messages(self) -> DataFrame:
        return self._sql(MESSAGES, conversations=self.table("conversations"))

    def unit_events(self) -> DataFrame:
        return self._sql(UNIT_EVENTS, events=self.table("events"))
