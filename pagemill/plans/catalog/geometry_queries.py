"""Queries on detections, boxes, points and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import boxes
from pagemill.operators import geometry
from pagemill.plans.catalog.registry import query
from pagemill.plans.fixtures import Inputs, duckdb_with
from pagemill.plans.layout import LayoutSettings, layout_regions

KEYS = ["unit_id", "page_idx", "det_id"]
ROW = "unit_id, page_idx, det_id"


def sql_iou(a: str, b: str) -> str:
    inter = (
        f"(greatest(0.0::double, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1)+1)"
        f"*greatest(0.0::double, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)+1))"
    )
    area = lambda s: f"(({s}.x2-{s}.x1+1)*({s}.y2-{s}.y1+1))"
    return f"({inter}/({area(a)}+{area(b)}-{inter}))"


def sql_ratio(a: str, b: str) -> str:
    area = f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"
    inter = (
        f"(greatest(0.0::double, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
        f"*greatest(0.0::double, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    )
    return f"(case when {area}>0 then {inter}/{area} else 0.0 end)"


def sql_nms(source: str, same: float, other: float) -> str:
    """Greedy suppression as a fold over the boxes of a page in score order."""
    clash = f"{sql_iou('k', 'x[1]')} >= (case when k.cls_id = x[1].cls_id then {same} else {other} end)"
    return f"""
select unit_id, page_idx, unnest(list_reduce(items, lambda acc, x:
    case when len(list_filter(acc, lambda k: {clash})) > 0 then acc else list_concat(acc, x) end)) as b
from (select unit_id, page_idx, list([{{'det_id':det_id,'cls_id':cls_id,'score':score,'x1':x1,'y1':y1,'x2':x2,'y2':y2,'order_seq':order_seq}}]
        order by score desc, det_id) as items from {source} group by unit_id, page_idx) t"""


def sql_labels(col: str) -> str:
    cases = " ".join(f"when {cls} then '{name}'" for cls, name in config.ID_TO_LABEL.items())
    return f"(case {col} {cases} else 'class_' || {col} end)"


def sql_tasks(col: str) -> str:
    cases = " ".join(
        f"when {col} in ({', '.join(repr(n) for n in names)}) then '{task}'" for task, names in config.TASK_LABELS.items()
    )
    return f"(case {cases} end)"


# --- scores and overlap ------------------------------------------------------


@query(
    "threshold_by_class",
    duckdb_with(
        ["fx_detections"],
        f"select {ROW}, cls_id, score from fx_detections where score >= case cls_id when 5 then 0.5 when 22 then 0.7 else 0.3 end",
    ),
)
def _(i: Inputs):
    kept = geometry.threshold_by_class(i.detections(), per_class={5: 0.5, "text": 0.7, "unheard of": 0.1})
    return kept.select(*KEYS, "cls_id", "score")


@query(
    "pre_threshold",
    duckdb_with(["fx_detections"], "select cls_id, count(*) as n from fx_detections where score >= 0.2 group by cls_id"),
)
def _(i: Inputs):
    return geometry.pre_threshold(i.detections(), 0.3, {5: 0.2}).groupBy("cls_id").agg(F.count(F.lit(1)).alias("n"))


_NEXT = "fx_detections a join fx_detections b on a.unit_id=b.unit_id and a.page_idx=b.page_idx and b.det_id=a.det_id+1"


def _neighbours(i: Inputs):
    fields = F.struct("cls_id", *boxes.SIDES)
    det = i.detections().select(*KEYS, fields.alias("a"))
    after = det.select("unit_id", "page_idx", (F.col("det_id") - 1).alias("det_id"), F.col("a").alias("b"))
    return det.join(after, KEYS)


@query(
    "iou",
    duckdb_with(["fx_detections"], f"select a.unit_id, a.page_idx, a.det_id, {sql_iou('a', 'b')} as iou from {_NEXT}"),
)
def _(i: Inputs):
    return _neighbours(i).select(*KEYS, boxes.iou(F.col("a"), F.col("b")).alias("iou"))


@query(
    "is_contained",
    duckdb_with(
        ["fx_detections"],
        f"select a.unit_id, a.page_idx, a.det_id, {sql_ratio('a', 'b')} as ratio, {sql_ratio('a', 'b')} >= 0.8 as contained from {_NEXT}",
    ),
)
def _(i: Inputs):
    a, b = F.col("a"), F.col("b")
    return _neighbours(i).select(
        *KEYS, boxes.contained_ratio(a, b).alias("ratio"), boxes.is_contained(a, b, config.CONTAINED_RATIO).alias("contained")
    )


@query(
    "nms",
    duckdb_with(
        ["fx_detections"],
        f"select unit_id, page_idx, b.det_id as det_id, b.cls_id as cls_id, b.score as score from ({sql_nms('fx_detections', 0.6, 0.98)}) n",
    ),
)
def _(i: Inputs):
    return geometry.nms(i.detections()).select(*KEYS, "cls_id", "score")


@query(
    "nms_low_thresholds",
    duckdb_with(
        ["fx_detections"],
        f"select unit_id, page_idx, b.det_id as det_id, b.score as score from ({sql_nms('fx_detections', 0.3, 0.49)}) n",
    ),
)
def _(i: Inputs):
    return geometry.nms(i.detections(), 0.3, 0.49).select(*KEYS, "score")


# --- page-sized images and nesting ------------------------------------------

# small pages, so that some image boxes cover them
_TIGHT = """tight as (select unit_id, page_idx, cast(420+(unit_id%3)*100 as int) as width,
  cast(400+(page_idx%2)*150 as int) as height from fx_pages)"""
_FITS = """(cls_id <> 14 or (least(width::double, x2)-greatest(0.0::double, x1))*(least(height::double, y2)-greatest(0.0::double, y1))
  <= (case when width > height then 0.82::double else 0.93::double end)*(width*height))"""


def _tight_pages(i: Inputs):
    return i.pages().select(
        "unit_id",
        "page_idx",
        (F.lit(420) + F.col("unit_id") % 3 * 100).cast("int").alias("width"),
        (F.lit(400) + F.col("page_idx") % 2 * 150).cast("int").alias("height"),
    )


@query(
    "drop_page_sized_images",
    duckdb_with(
        ["fx_detections", "fx_pages"],
        f"""with {_TIGHT},
judged as (select d.*, {_FITS} as fits, count(*) over w as n_all, sum(case when {_FITS} then 1 else 0 end) over w as n_fit
  from fx_detections d join tight using (unit_id, page_idx) window w as (partition by unit_id, page_idx))
select {ROW}, cls_id from judged where fits or n_all <= 1 or n_fit = 0""",
    ),
)
def _(i: Inputs):
    return geometry.drop_page_sized_images(i.detections(), _tight_pages(i)).select(*KEYS, "cls_id")


_PAIRS = f"""pairs as (select i.unit_id, i.page_idx, i.det_id as i_det, i.cls_id as i_cls, j.det_id as j_det, j.cls_id as j_cls
  from {{source}} i join {{source}} j on i.unit_id=j.unit_id and i.page_idx=j.page_idx and i.det_id<>j.det_id
  where i.cls_id not in (14, 20, 3) and {sql_ratio('i', 'j')} >= 0.8)"""


def _flags_sql(condition: str) -> str:
    return duckdb_with(
        ["fx_detections"],
        f"""with {_PAIRS.format(source='fx_detections')},
outer_ as (select distinct unit_id, page_idx, j_det as det_id from pairs where {condition}),
inner_ as (select distinct unit_id, page_idx, i_det as det_id from pairs where {condition})
select d.unit_id, d.page_idx, d.det_id, cast(o.det_id is not null as int) as contains_other,
  cast(n.det_id is not null as int) as contained_by_other
from fx_detections d left join outer_ o using (unit_id, page_idx, det_id) left join inner_ n using (unit_id, page_idx, det_id)""",
    )


@query("containment_flags", _flags_sql("true"))
def _(i: Inputs):
    return geometry.containment_flags(i.detections()).select(*KEYS, "contains_other", "contained_by_other")


@query("containment_flags_inner_class", _flags_sql("i_cls = 18"))
def _(i: Inputs):
    flags = geometry.containment_flags(i.detections(), category=18, mode="small")
    return flags.select(*KEYS, "contains_other", "contained_by_other")


@query("containment_flags_outer_class", _flags_sql("j_cls = 21"))
def _(i: Inputs):
    flags = geometry.containment_flags(i.detections(), category=21, mode="large")
    return flags.select(*KEYS, "contains_other", "contained_by_other")


def _merge_sql(dropped: str) -> str:
    return duckdb_with(
        ["fx_detections"],
        f"""with {_PAIRS.format(source='fx_detections')},
inner_ as (select distinct unit_id, page_idx, i_det as det_id from pairs),
dropped as ({dropped})
select {ROW}, cls_id from fx_detections anti join dropped using (unit_id, page_idx, det_id)""",
    )


@query("merge_boxes_large", _merge_sql("select * from inner_"))
def _(i: Inputs):
    return geometry.merge_boxes(i.detections(), "large").select(*KEYS, "cls_id")


@query(
    "merge_boxes_small",
    _merge_sql(
        "select distinct unit_id, page_idx, j_det as det_id from pairs anti join inner_ on pairs.unit_id=inner_.unit_id and pairs.page_idx=inner_.page_idx and pairs.j_det=inner_.det_id"
    ),
)
def _(i: Inputs):
    return geometry.merge_boxes(i.detections(), "small").select(*KEYS, "cls_id")


def merge_by_class_sql(large: str, small: str) -> str:
    """Dropped boxes under a per-class table; ``large`` and ``small`` test a class column."""
    return f"""select distinct unit_id, page_idx, i_det as det_id from pairs where {large.format('j_cls')}
union
select distinct p.unit_id, p.page_idx, p.j_det from pairs p left join inner_ n
  on p.unit_id=n.unit_id and p.page_idx=n.page_idx and p.j_det=n.det_id
where {small.format('i_cls')} and (p.i_cls <> p.j_cls or n.det_id is null)"""


@query("merge_boxes_by_class", _merge_sql(merge_by_class_sql("{}%3<>0", "{}%3=0")))
def _(i: Inputs):
    modes = {cls: "small" if cls % 3 == 0 else "large" for cls in config.ID_TO_LABEL}
    return geometry.merge_boxes(i.detections(), modes).select(*KEYS, "cls_id")


# --- order, size and coordinates --------------------------------------------


@query(
    "reading_order",
    duckdb_with(
        ["fx_detections"],
        f"""select {ROW}, cast(row_number() over (partition by unit_id, page_idx order by order_seq, det_id)-1 as int) as idx,
case when order_seq > 0 then order_seq end as "order" from fx_detections""",
    ),
)
def _(i: Inputs):
    return geometry.reading_order(i.detections()).select(*KEYS, "idx", "order")


def _unclip_sql(rw: str, rh: str) -> str:
    return duckdb_with(
        ["fx_detections"],
        f"""select {ROW},
coalesce((x1+(x2-x1)/2)-(x2-x1)*{rw}/2, x1) as x1, coalesce((y1+(y2-y1)/2)-(y2-y1)*{rh}/2, y1) as y1,
coalesce((x1+(x2-x1)/2)+(x2-x1)*{rw}/2, x2) as x2, coalesce((y1+(y2-y1)/2)+(y2-y1)*{rh}/2, y2) as y2 from fx_detections""",
    )


@query("unclip", _unclip_sql("1.25::double", "0.75::double"))
def _(i: Inputs):
    return geometry.unclip(i.detections(), (1.25, 0.75)).select(*KEYS, *boxes.SIDES)


@query(
    "unclip_by_class",
    _unclip_sql(
        "(case cls_id when 5 then 1.5::double when 21 then 1.125::double end)",
        "(case cls_id when 5 then 1.25::double when 21 then 2.0::double end)",
    ),
)
def _(i: Inputs):
    return geometry.unclip(i.detections(), {5: (1.5, 1.25), 21: (1.125, 2.0)}).select(*KEYS, *boxes.SIDES)


_CLAMPED = """clamped as (select d.unit_id, d.page_idx, d.det_id, d.cls_id, d.score, d.order_seq, width, height,
  greatest(0.0::double, least(x1, width::double)) as x1, greatest(0.0::double, least(y1, height::double)) as y1,
  greatest(0.0::double, least(x2, width::double)) as x2, greatest(0.0::double, least(y2, height::double)) as y2
  from {source} d join {pages} using (unit_id, page_idx))"""


@query(
    "clamp_boxes",
    duckdb_with(
        ["fx_detections", "fx_pages"],
        f"""with {_TIGHT}, {_CLAMPED.format(source='fx_detections', pages='tight')}
select {ROW}, cast(trunc(x1) as int) as x1, cast(trunc(y1) as int) as y1, cast(trunc(x2) as int) as x2, cast(trunc(y2) as int) as y2
from clamped where x1 < x2 and y1 < y2""",
    ),
)
def _(i: Inputs):
    clamped = geometry.clamp_boxes(geometry.with_page_size(i.detections(), _tight_pages(i)))
    return clamped.select(*KEYS, *[F.col(s).cast("int").alias(s) for s in boxes.SIDES])


_SIZED = "fx_detections join fx_pages using (unit_id, page_idx)"


def _thousandths(form: str) -> str:
    return ", ".join(
        form.format(s, "width" if s[0] == "x" else "height") + f" as b{s}" for s in boxes.SIDES
    )


@query(
    "normalise_bbox",
    duckdb_with(["fx_detections", "fx_pages"], f"select {ROW}, {_thousandths('cast(trunc({0}/{1}*1000) as int)')} from {_SIZED}"),
)
def _(i: Inputs):
    sized = geometry.with_page_size(i.detections(), i.pages())
    return geometry.normalise_boxes(sized).select(*KEYS, *["b" + s for s in boxes.SIDES])


@query(
    "normalise_bbox_service",
    duckdb_with(
        ["fx_detections", "fx_pages"],
        f"select {ROW}, {_thousandths('cast(round_even({0}*1000/{1}, 0) as int)')} from {_SIZED}",
    ),
)
def _(i: Inputs):
    sized = geometry.with_page_size(i.detections(), i.pages())
    return sized.select(
        *KEYS,
        *[
            boxes.to_thousandths_rounded(F.col(s), F.col("width" if s[0] == "x" else "height")).alias("b" + s)
            for s in boxes.SIDES
        ],
    )


@query(
    "denormalise_bbox",
    duckdb_with(
        ["fx_regions", "fx_doc_pages"],
        """select unit_id, page_idx, idx, cast(trunc(bx1*width/1000.0::double) as int) as px1,
cast(trunc(by2*height/1000.0::double) as int) as py2,
cast(trunc(bx2*(width/1000.0::double)) as int)-cast(trunc(bx1*width/1000.0::double) as int) as poly_x
from fx_regions join fx_doc_pages using (unit_id, page_idx)""",
    ),
)
def _(i: Inputs):
    sized = geometry.with_page_size(i.regions(), i.doc_pages())
    px1 = boxes.from_thousandths(F.col("bx1"), F.col("width"))
    return sized.select(
        "unit_id",
        "page_idx",
        "idx",
        px1.alias("px1"),
        boxes.from_thousandths(F.col("by2"), F.col("height")).alias("py2"),
        boxes.polygon_from_thousandths(F.col("bx2"), F.col("width"), px1).alias("poly_x"),
    )


# --- polygons ----------------------------------------------------------------


def _with_polygons(i: Inputs):
    x1, y1, x2, y2 = (F.col(s) for s in boxes.SIDES)
    outline = F.array(F.array(x1 + 5, y1), F.array(x2, y1 + 5), F.array(x2 - 5, y2), F.array(x1, y2 - 5))
    return i.detections().withColumn("polygon", F.when(F.col("det_id") % 3 != 0, outline))


_POLY = """raws as (select *, case when det_id%3<>0 then x1+5 end as p0x, case when det_id%3<>0 then y1 end as p0y,
  case when det_id%3<>0 then x2-5 end as p2x, case when det_id%3<>0 then y2 end as p2y from fx_detections)"""


def _poly_columns(of: str, col: str, limit: str, fallback: str) -> str:
    return (
        f"coalesce(case when {of}.{col} is not null then greatest(0.0::double, least({of}.{col}, {limit}::double)) end, "
        f"greatest(0.0::double, least({fallback}, {limit}::double))) as {col}"
    )


@query(
    "attach_polygons",
    duckdb_with(
        ["fx_detections", "fx_pages"],
        f"""with {_POLY},
kept as (select unit_id, page_idx, det_id, x1+(det_id%4)*0.5 as x1, y1, x2+(det_id%4)*0.5 as x2, y2 from fx_detections),
near as (select k.unit_id, k.page_idx, k.det_id as kept_id, r.*, row_number() over (partition by k.unit_id, k.page_idx, k.det_id order by r.det_id) as rn
  from kept k join raws r on k.unit_id=r.unit_id and k.page_idx=r.page_idx
  where {' and '.join(f'abs(r.{s}-k.{s}) <= 1.0+0.00001::double*abs(k.{s})' for s in boxes.SIDES)})
select k.unit_id, k.page_idx, k.det_id, {_poly_columns('n', 'p0x', 'width', 'k.x1')}, {_poly_columns('n', 'p0y', 'height', 'k.y1')},
  {_poly_columns('n', 'p2x', 'width', 'k.x2')}, {_poly_columns('n', 'p2y', 'height', 'k.y2')}
from kept k join fx_pages p on k.unit_id=p.unit_id and k.page_idx=p.page_idx
left join near n on n.unit_id=k.unit_id and n.page_idx=k.page_idx and n.kept_id=k.det_id and n.rn=1""",
    ),
)
def _(i: Inputs):
    raw = _with_polygons(i)
    shift = F.col("det_id") % 4 * 0.5
    kept = raw.withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift})
    found = geometry.attach_polygons(kept, raw, i.pages())
    at = lambda p, c: F.get(F.get("polygon", F.lit(p)), F.lit(c))
    return found.select(
        *KEYS, at(0, 0).alias("p0x"), at(0, 1).alias("p0y"), at(2, 0).alias("p2x"), at(2, 1).alias("p2y")
    )


@query(
    "polygon_or_rectangle",
    duckdb_with(
        ["fx_detections"],
        f"""select {ROW}, case when det_id%3=1 then x1+5 else trunc(x1) end as p0x, case when det_id%3=1 then y2 else trunc(y2) end as p2y from fx_detections""",
    ),
)
def _(i: Inputs):
    # outlines of four points, of two points, and none
    outline = _with_polygons(i).withColumn(
        "polygon", F.when(F.col("det_id") % 3 == 2, F.slice("polygon", 1, 2)).otherwise(F.col("polygon"))
    )
    usable = boxes.polygon_or_rectangle(F.col("polygon"), *[F.col(s) for s in boxes.SIDES])
    return outline.withColumn("polygon", usable).select(
        *KEYS, F.col("polygon")[0][0].alias("p0x"), F.col("polygon")[2][1].alias("p2y")
    )


# --- labels and the whole chain ---------------------------------------------


@query(
    "map_label_id",
    duckdb_with(["fx_detections"], f"select {sql_labels('c')} as label, count(*) as n from (select cls_id*2 as c from fx_detections) t group by 1"),
)
def _(i: Inputs):
    return (
        i.detections()
        .select(geometry.label_of(F.col("cls_id") * 2).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "route_task",
    duckdb_with(
        ["fx_detections"],
        f"""select {ROW}, {sql_tasks('label')} as task_type, cast(row_number() over (partition by unit_id, page_idx order by det_id)-1 as int) as idx
from (select *, {sql_labels('cls_id')} as label from fx_detections) t where {sql_tasks('label')} <> 'abandon'""",
    ),
)
def _(i: Inputs):
    labelled = i.detections().withColumn("label", geometry.label_of(F.col("cls_id")))
    routed = geometry.route_tasks(labelled).withColumn("idx", F.col("det_id"))
    from pagemill.plans.layout import reindex

    return reindex(routed).select(*KEYS, "task_type", "idx")


LAYOUT_SQL = f"""with passed as (select * from fx_detections where score >= 0.3),
suppressed as (select unit_id, page_idx, b.* from ({sql_nms('passed', 0.6, 0.98)}) n),
judged as (select d.*, {_FITS} as fits, count(*) over w as n_all, sum(case when {_FITS} then 1 else 0 end) over w as n_fit
  from suppressed d join fx_pages using (unit_id, page_idx) window w as (partition by unit_id, page_idx)),
sized as (select * from judged where fits or n_all <= 1 or n_fit = 0),
{_PAIRS.format(source='sized')},
inner_ as (select distinct unit_id, page_idx, i_det as det_id from pairs),
dropped as ({merge_by_class_sql('{}<>18', '{}=18')}),
merged as (select * from sized anti join dropped using (unit_id, page_idx, det_id)),
{_CLAMPED.format(source='merged', pages='fx_pages')},
pixels as (select unit_id, page_idx, det_id, score, order_seq, width, height, {sql_labels('cls_id')} as label,
  trunc(x1) as x1, trunc(y1) as y1, trunc(x2) as x2, trunc(y2) as y2 from clamped where x1 < x2 and y1 < y2)
select unit_id, page_idx, cast(row_number() over (partition by unit_id, page_idx order by order_seq, det_id)-1 as int) as idx,
  det_id, label, {sql_tasks('label')} as task_type, score, {_thousandths('cast(trunc({0}/{1}*1000) as int)')}
from pixels where {sql_tasks('label')} <> 'abandon'"""


@query("layout_regions", duckdb_with(["fx_detections", "fx_pages"], LAYOUT_SQL))
def _(i: Inputs):
    found = layout_regions(i.detections(), i.pages())
    return found.select(
        "unit_id", "page_idx", "idx", "det_id", "label", "task_type", "score", *["b" + s for s in boxes.SIDES]
    )


@query("layout_regions_with_polygons")
def _(i: Inputs):
    found = layout_regions(_with_polygons(i), i.pages(), LayoutSettings(unclip_ratio=(1.0, 1.0)))
    return found.select("unit_id", "page_idx", "idx", "label", F.to_json("polygon").alias("polygon"))


# --- points and blocks -------------------------------------------------------


def _points(i: Inputs):
    return i.table("lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("unit_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("point_id"),
        (F.col("l_orderkey") % 4).cast("int").alias("page_index"),
        ((F.col("l_partkey") * 41) % 900).cast("double").alias("px"),
        ((F.col("l_suppkey") * 59) % 1000).cast("double").alias("py"),
    ).dropDuplicates(["unit_id", "point_id"])


@query(
    "point_in_box",
    duckdb_with(
        ["fx_detections"],
        """with points as (select distinct cast(l_orderkey//4 as bigint) as unit_id, cast(l_orderkey%4 as int) as page_index,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as point_id,
  cast((l_partkey*41)%900 as double) as px, cast((l_suppkey*59)%1000 as double) as py from lineitem)
select p.unit_id, p.page_index, p.px, p.py, count(*) as n, min(b.block_id) as block_id from points p left join
 (select p.unit_id, p.point_id, min(d.det_id) as block_id from points p join fx_detections d on p.unit_id=d.unit_id and p.page_index=d.page_idx
  where p.px between d.x1 and d.x2 and p.py between d.y1 and d.y2 group by 1, 2) b using (unit_id, point_id)
group by 1, 2, 3, 4""",
    ),
)
def _(i: Inputs):
    blocks = i.detections().select(
        "unit_id", F.col("page_idx").alias("page_index"), F.col("det_id").alias("block_id"), *boxes.SIDES
    )
    hits = geometry.blocks_at_points(_points(i), blocks)
    return hits.groupBy("unit_id", "page_index", "px", "py").agg(
        F.count(F.lit(1)).alias("n"), F.min("block_id").alias("block_id")
    )


@query(
    "rescale_points",
    duckdb_with(
        ["fx_detections", "fx_pages"],
        f"select {ROW}, x1/(640.0::double/width) as dx, y1/(480.0::double/height) as dy from fx_detections join fx_pages using (unit_id, page_idx)",
    ),
)
def _(i: Inputs):
    sized = geometry.with_page_size(i.detections(), i.pages()).withColumns({"px": F.col("x1"), "py": F.col("y1")})
    shown = geometry.rescale_points(sized, F.lit(640.0), F.lit(480.0), F.col("width"), F.col("height"))
    return shown.select(*KEYS, "dx", "dy")


@query(
    "block_table",
    duckdb_with(
        ["fx_regions"],
        """select unit_id, page_idx, idx, trim(c) as content, case when idx%4=0 then 1 else page_idx+1 end as page_index,
starts_with(trim(c), '![](') as is_image, bx2-bx1 as width, by2-by1 as height
from (select *, case when native_label='image' then ' ![](page=0) ' else content end as c from fx_regions) t
where c is not null and trim(c) <> ''""",
    ),
)
def _(i: Inputs):
    layout = i.regions().select(
        "unit_id",
        "page_idx",
        "idx",
        F.when(F.col("native_label") == "image", " ![](page=0) ").otherwise(F.col("content")).alias("block_content"),
        F.when(F.col("idx") % 4 != 0, F.col("page_idx") + 1).alias("page_index"),
        *[F.col("b" + s).alias(s) for s in boxes.SIDES],
    )
    table = geometry.block_table(layout)
    return table.select("unit_id", "page_idx", "idx", "content", "page_index", "is_image", "width", "height")
