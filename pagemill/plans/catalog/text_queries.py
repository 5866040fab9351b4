"""Queries on text functions. Inputs are document lines with marks added by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import chat, errors, text
from pagemill.operators import content
from pagemill.plans.catalog.registry import query
from pagemill.plans.fixtures import Inputs, duckdb_with

KEYS = ["doc_id", "pos"]


def _case(values: list[tuple[int, Column]], by: Column, other: Column) -> Column:
    result = None
    for number, value in values:
        result = F.when(by == number, value) if result is None else result.when(by == number, value)
    return result.otherwise(other)


def _marked(i: Inputs, *forms: str):
    """Lines put into one of several forms; ``{}`` stands for the line."""
    line = F.col("line")
    pick = (F.col("doc_id") + F.col("pos")) % len(forms)
    shaped = []
    for number, form in enumerate(forms):
        before, after = form.split("{}")
        shaped.append((number, F.concat(F.lit(before), line, F.lit(after))))
    return i.lines().select(*KEYS, _case(shaped, pick, line).alias("c"))


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _text(value: str) -> str:
    """SQL for a text with control characters spelled out."""
    if value == "":
        return "''"
    parts = value.split("\n")
    return " || chr(10) || ".join(_quote(p) for p in parts)


def marked_sql(*forms: str) -> str:
    cases = []
    for number, form in enumerate(forms):
        before, after = form.split("{}")
        cases.append(f"when {number} then {_text(before)} || line || {_text(after)}")
    return f"marked as (select doc_id, pos, case (doc_id+pos)%{len(forms)} {' '.join(cases)} end as c from fx_lines)"


def _over_lines(forms: tuple[str, ...], expression: str, extra: str = "") -> str:
    return duckdb_with(
        ["fx_lines"], f"with {marked_sql(*forms)}{extra}\nselect doc_id, pos, {expression} as c from marked"
    )


# --- clean-up ----------------------------------------------------------------


def sql_cut(keys: str, source: str, prefix: str = "") -> str:
    """CTEs ``<prefix>kept(keys, n_keep)``: where ``source(keys, s)`` is cut at a repetition.

    For every unit length, equal characters one unit apart are looked for at multiples of
    the unit; lengths with eight in a row are then tested at every position.
    """
    return f"""{prefix}chars as (select {keys}, string_split(s, '') as ch, length(s) as n from {source} where length(s) > 100),
{prefix}units as (select {keys}, ch, n, unnest(range(10, n//10+1)) as u from {prefix}chars),
{prefix}steps as (select {keys}, u, unnest(range(0, (n-1)//u)) as k, ch from {prefix}units),
{prefix}equal as (select {keys}, u, k, k - row_number() over (partition by {keys}, u order by k) as island from {prefix}steps where ch[k*u+1] = ch[(k+1)*u+1]),
{prefix}likely as (select distinct {keys}, u from {prefix}equal group by {keys}, u, island having count(*) >= 8),
{prefix}places as (select {keys}, u, unnest(range(0, n-u)) as k, ch from {prefix}likely join {prefix}chars using ({keys})),
{prefix}same as (select {keys}, u, k, k - row_number() over (partition by {keys}, u order by k) as island from {prefix}places where ch[k+1] = ch[k+u+1]),
{prefix}runs_ as (select {keys}, u, min(k) as start from {prefix}same group by {keys}, u, island having count(*) >= 9*u),
{prefix}kept as (select {keys}, min(start)+arg_min(u, start*100000+u) as n_keep from {prefix}runs_ group by {keys})"""


_CLEAN = ("\\t\\t  {}\\t", "{}....... ____ \\_\\_\\_\\_\\_x", "{}····", "\n {} \n", "{}")


def sql_punctuation(col: str) -> str:
    space = r"\s"
    steps = f"regexp_replace({col}, '^(\\\\t)+', '')"
    steps = f"regexp_replace({steps}, '^{space}+', '')"
    steps = f"regexp_replace({steps}, '(\\\\t)+$', '')"
    steps = f"regexp_replace({steps}, '{space}+$', '')"
    for mark, short in ((r"\.", "..."), ("·", "···"), ("_", "___")):
        steps = f"regexp_replace({steps}, '{mark}{{3,}}', '{short}', 'g')"
    return f"regexp_replace({steps}, '(\\\\_){{3,}}', '\\\\_\\\\_\\\\_', 'g')"


def sql_repeated_lines(keys: str, source: str, prefix: str = "") -> str:
    """CTEs ``<prefix>line_cut(keys, p)``: the line after which ``source(keys, s)`` is cut, where one line makes up most of it."""
    return f"""{prefix}lines as (select {keys}, generate_subscripts(string_split(s, chr(10)), 1) as p, trim(unnest(string_split(s, chr(10)))) as line from {source}),
{prefix}full_ as (select *, row_number() over (partition by {keys} order by p) as i, count(*) over (partition by {keys}) as total from {prefix}lines where line <> ''),
{prefix}counted as (select {keys}, line, count(*) as n, any_value(total) as total, min(i) as first_i from {prefix}full_ group by {keys}, line),
{prefix}top as (select {keys}, line, n, total from {prefix}counted qualify row_number() over (partition by {keys} order by n desc, first_i) = 1),
{prefix}three as (select *, lead(line) over w as l1, lead(line, 2) over w as l2 from {prefix}full_ window w as (partition by {keys} order by i)),
{prefix}line_cut as (select {keys}, min(p) as p from {prefix}three join {prefix}top using ({keys}, line) where l1=line and l2=line and n >= 10 and n/{prefix}top.total >= 0.8 group by {keys})"""


def sql_clean(keys: str, source: str) -> str:
    """CTEs up to ``cleaned(keys, body)``: the clean-up of ``source(keys, c)``, long texts cut at repetitions.

    No line of the tables has a dollar span, so formulas stay as they are.
    """
    return f"""punctuated as (select {keys}, {sql_punctuation('c')} as s from {source}),
long_ as (select * from punctuated where length(s) >= 2048),
{sql_cut(keys, 'long_')},
{sql_repeated_lines(keys, 'long_', 'rep_')},
cleaned as (select {keys}, trim(case when n_keep is not null then substr(s, 1, n_keep)
  when p is not null then array_to_string(string_split(s, chr(10))[1:p], chr(10)) else s end, ' ' || chr(10)) as body
  from punctuated left join kept using ({keys}) left join rep_line_cut using ({keys}))"""


@query(
    "clean_content",
    duckdb_with(
        ["fx_lines"],
        f"with {marked_sql(*_CLEAN)},\n{sql_clean('doc_id, pos', 'marked')}\nselect doc_id, pos, body as c from cleaned",
    ),
)
def _(i: Inputs):
    return content.clean_content(_marked(i, *_CLEAN), "c")


@query(
    "cut_repeated_substrings",
    duckdb_with(
        [],
        f"""with shaped as (select doc_id, case when doc_id%3=0 then text || chr(10) || repeat(substr(text, 1, 40) || ' ... ', 20) || 'end' else text end as c from documents),
src as (select doc_id, trim(c, ' ' || chr(10)) as s from shaped),
{sql_cut('doc_id', 'src')}
select doc_id, length(c) as n_before, cast(n_keep as int) as n_after, md5(substr(s, 1, n_keep)) as digest
from shaped join src using (doc_id) left join kept using (doc_id)""",
    ),
)
def _(i: Inputs):
    # every third document ends in a phrase said twenty times
    phrase = F.repeat(F.concat(F.substring("text", 1, 40), F.lit(" ... ")), F.lit(20))
    shaped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\n"), phrase, F.lit("end"))).otherwise(
        F.col("text")
    )
    cut = i.table("documents").select("doc_id", shaped.alias("c")).withColumn("cut", text.cut_repeats(F.col("c")))
    return cut.select(
        "doc_id", F.length("c").alias("n_before"), F.length("cut").alias("n_after"), F.md5("cut").alias("digest")
    )


# three texts of four go on with lines that repeat, so often that one line makes up most of the text
_REPEATED = """sized as (select *, len(string_split(text, chr(10))) as m, string_split(text, chr(10))[1] as line_1 from documents),
shaped as (select doc_id, case doc_id%4
  when 0 then text
  when 1 then text || chr(10) || repeat(' ' || line_1 || chr(10), 12 + 5*m) || 'tail'
  when 2 then repeat(line_1 || chr(10) || chr(10), 9) || text
  else text || chr(10) || repeat('a' || doc_id || chr(10) || repeat('b' || chr(10), 8), 11 + m) end as s from sized)"""


@query(
    "cut_repeated_lines",
    duckdb_with(
        [],
        f"""with {_REPEATED},
{sql_repeated_lines('doc_id', 'shaped')}
select s.doc_id, md5(case when k.p is not null then array_to_string(string_split(s.s, chr(10))[1:k.p], chr(10)) else s.s end) as digest
from shaped s left join line_cut k using (doc_id)""",
    ),
)
def _(i: Inputs):
    line, m = F.get(F.split("text", "\n"), F.lit(0)), F.size(F.split("text", "\n"))
    nl = F.lit("\n")
    shaped = _case(
        [
            (0, F.col("text")),
            (1, F.concat("text", nl, F.repeat(F.concat(F.lit(" "), line, nl), 12 + 5 * m), F.lit("tail"))),
            (2, F.concat(F.repeat(F.concat(line, nl, nl), F.lit(9)), F.col("text"))),
        ],
        F.col("doc_id") % 4,
        F.concat("text", nl, F.repeat(F.concat(F.lit("a"), F.col("doc_id").cast("string"), nl, F.lit("b\n" * 8)), 11 + m)),
    )
    docs = i.table("documents").select("doc_id", shaped.alias("c"))
    return content.cut_repeated_lines(docs, "c").select("doc_id", F.md5("c").alias("digest"))


# whole lines; only a dollar or a backslash, which would open or escape a further formula, is another sign
_WORD = "trim(translate(line, '$' || chr(92), '§/'))"


@query(
    "normalise_inline_formula",
    duckdb_with(
        ["fx_lines"],
        f"""select doc_id, pos, case (doc_id+pos)%4 when 0 then 'a $' || w || 'x$ b' when 1 then '($' || w || 'x$), $y$'
when 2 then w || ' $' || ' $ z' else w || 'q $x$ y $$ ' || w || ' $$' end as c from (select doc_id, pos, {_WORD} as w from fx_lines) t""",
    ),
)
def _(i: Inputs):
    word = F.trim(F.translate("line", "$\\", "§/"))
    shaped = _case(
        [
            (0, F.concat(F.lit("a$ "), word, F.lit("x $b"))),
            (1, F.concat(F.lit("($"), word, F.lit("x  $), $ y$"))),
            (2, F.concat(word, F.lit(" $ $ z"))),
        ],
        (F.col("doc_id") + F.col("pos")) % 4,
        F.concat(word, F.lit("q$ x$y $$ "), word, F.lit(" $$")),
    )
    return i.lines().select(*KEYS, text.normalise_inline_formula(shaped).alias("c"))


# --- single rules ------------------------------------------------------------

_NUMBERS = (" ({}) ", "（{}）", "({}", "{}")


@query(
    "clean_formula_number",
    _over_lines(
        _NUMBERS,
        "case when starts_with(trim(c), '(') and ends_with(trim(c), ')') or starts_with(trim(c), '（') and ends_with(trim(c), '）') "
        "then substr(trim(c), 2, length(trim(c))-2) else trim(c) end",
    ),
)
def _(i: Inputs):
    return _marked(i, *_NUMBERS).select(*KEYS, text.clean_formula_number(F.col("c")).alias("c"))


def sql_categories(col: str) -> str:
    cases = " ".join(
        f"when {col} in ({', '.join(repr(n) for n in names)}) then '{category}'"
        for category, names in config.CATEGORY_LABELS.items()
    )
    return f"(case {cases} else {col} end)"


@query(
    "map_label",
    duckdb_with(["fx_regions"], f"select native_label, {sql_categories('native_label')} as label, count(*) as n from fx_regions group by 1, 2"),
)
def _(i: Inputs):
    return content.map_labels(i.regions()).groupBy("native_label", "label").agg(F.count(F.lit(1)).alias("n"))


def sql_title(col: str, native: str) -> str:
    item = f"case when starts_with({col}, '- ') or starts_with({col}, '* ') then ltrim(substr({col}, 3)) else {col} end"
    return (
        f"(case {native} when 'doc_title' then '# ' || regexp_replace({col}, '^#+\\s*', '') "
        f"when 'paragraph_title' then '## ' || ltrim(regexp_replace({item}, '^#+\\s*', '')) else {col} end)"
    )


_TITLES = ("## {}", "- # {}", "* {}", "{}")
_NATIVE = "(case (doc_id+pos)%3 when 0 then 'doc_title' when 1 then 'paragraph_title' else 'text' end)"


@query("format_title", _over_lines(_TITLES, sql_title("c", _NATIVE)))
def _(i: Inputs):
    native = _case(
        [(0, F.lit("doc_title")), (1, F.lit("paragraph_title"))], (F.col("doc_id") + F.col("pos")) % 3, F.lit("text")
    )
    return _marked(i, *_TITLES).select(*KEYS, text.format_title(F.col("c"), native).alias("c"))


def sql_formula(col: str) -> str:
    opened = (
        f"(case when starts_with({col}, '$$') or starts_with({col}, '\\[') or starts_with({col}, '\\(') "
        f"then trim(substr({col}, 3), ' '||chr(10)) else {col} end)"
    )
    closed = (
        f"(case when ends_with({opened}, '$$') or ends_with({opened}, '\\]') or ends_with({opened}, '\\)') "
        f"then trim(substr({opened}, 1, length({opened})-2), ' '||chr(10)) else {opened} end)"
    )
    return f"('$$' || chr(10) || {closed} || chr(10) || '$$')"


_FORMULAS = ("$$ {} $$", "\\[{}\\]", "\\({} \\)", "$${}", "{}")


@query("format_formula", _over_lines(_FORMULAS, sql_formula("c")))
def _(i: Inputs):
    return _marked(i, *_FORMULAS).select(*KEYS, text.format_formula(F.col("c")).alias("c"))


def sql_fence(col: str) -> str:
    return f"(case when starts_with({col}, '```') and not ends_with({col}, '```') then {col} || chr(10) || '```' else {col} end)"


_FENCES = ("```py\n{}", "```{}```", "{}")


@query("close_code_fence", _over_lines(_FENCES, sql_fence("c")))
def _(i: Inputs):
    return _marked(i, *_FENCES).select(*KEYS, text.close_code_fence(F.col("c")).alias("c"))


def sql_bullet(col: str) -> str:
    return (
        f"(case when starts_with({col}, '·') or starts_with({col}, '•') or starts_with({col}, '* ') "
        f"then '- ' || ltrim(substr({col}, 2)) else {col} end)"
    )


_BULLETS = ("·{}", "• {}", "* {}", "*{}", "{}")


@query("normalise_bullet", _over_lines(_BULLETS, sql_bullet("c")))
def _(i: Inputs):
    return _marked(i, *_BULLETS).select(*KEYS, text.normalise_bullet(F.col("c")).alias("c"))


def sql_enumerator(col: str) -> str:
    one = f"regexp_replace({col}, '^[(（](\\d+|[A-Za-z])[)）][ \\t]*([^\\n]*)$', '(\\1) \\2')"
    two = f"regexp_replace({one}, '^(\\d+|[A-Za-z])([.)])[ \\t]*([^\\n]*)$', '\\1\\2 \\3')"
    return f"regexp_replace({two}, '^(\\d+|[A-Za-z])）[ \\t]*([^\\n]*)$', '\\1) \\2')"


_ITEMS = ("(1){}", "（a） {}", "12.{}", "b){}", "3）{}", "(1){}\nnext", "ab.{}", "{}")


@query("normalise_enumerator", _over_lines(_ITEMS, sql_enumerator("c")))
def _(i: Inputs):
    return _marked(i, *_ITEMS).select(*KEYS, text.normalise_enumerator(F.col("c")).alias("c"))


_BREAKS = ("a\n{}", "{}\n\nb", "{}\n\n\nc\nd", "{}")


@query(
    "double_newlines",
    _over_lines(_BREAKS, "case (doc_id+pos)%4 when 0 then 'a' || chr(10) || c0 when 2 then c2 else c end").replace("from marked", "from (select *, chr(10) || substr(c, 3) as c0, replace(c, 'c' || chr(10) || 'd', 'c' || chr(10) || chr(10) || 'd') as c2 from marked) m"),
)
def _(i: Inputs):
    return _marked(i, *_BREAKS).select(*KEYS, text.double_newlines(F.col("c")).alias("c"))


_WHOLE = ("<table>{}</table>", "$$ {} $$", "<table>{}", "{}")


@query(
    "passthrough_finished",
    _over_lines(
        _WHOLE,
        "(doc_id+pos)%4 = 0 as table_done, (doc_id+pos)%4 = 1 as formula_done",
    ).replace(" as c from marked", " from marked"),
)
def _(i: Inputs):
    return _marked(i, *_WHOLE).select(
        *KEYS,
        text.is_finished(F.col("c"), F.lit("table")).alias("table_done"),
        text.is_finished(F.col("c"), F.lit("formula")).alias("formula_done"),
    )


# content rules in their order, for the label and native label columns of fx_regions
FORMATTED = f"""labelled as (select *, {sql_categories('native_label')} as label,
  case when native_label='table' and starts_with(content, '<table') and ends_with(content, '</table>') then true
       when native_label='display_formula' and starts_with(content, '$$') and ends_with(content, '$$') then true else false end as whole from fx_regions),
collapsed as (select *, case when not whole then trim({sql_punctuation('content')}) end as s from labelled),
long_ as (select unit_id, page_idx, idx, s from collapsed where length(s) >= 2048),
{sql_cut('unit_id, page_idx, idx', 'long_')},
cleaned as (select collapsed.*, case when whole then content when n_keep is not null then trim(substr(s, 1, n_keep)) else s end as body
  from collapsed left join kept using (unit_id, page_idx, idx)),
titled as (select * replace ({sql_title('body', 'native_label')} as body) from cleaned),
framed as (select * replace (case when label='formula' then {sql_formula('body')} else body end as body) from titled),
fenced as (select * replace (case when label='text' then {sql_fence('body')} else body end as body) from framed),
dotted as (select * replace (case when label='text' then {sql_bullet('body')} else body end as body) from fenced),
formatted as (select * replace (case when label='text' then {sql_enumerator('body')} else body end as body) from dotted)"""


@query(
    "format_content",
    duckdb_with(["fx_regions"], f"with {FORMATTED}\nselect unit_id, page_idx, idx, label, body as content from formatted"),
)
def _(i: Inputs):
    formatted = content.format_content(content.map_labels(i.regions()))
    return formatted.select("unit_id", "page_idx", "idx", "label", "content")


SQL_WORD = "regexp_full_match({0}, '[a-z][a-z''\\-]{{2,30}}') and {0} not like '%--%' and {0} not like '%''''%'"


@query(
    "is_plausible_word",
    duckdb_with(
        ["fx_lines"],
        f"""select w, {SQL_WORD.format('lower(w)')} as ok, count(*) as n
from (select unnest(string_split(line, ' ')) as w from fx_lines) t where w <> '' group by w""",
    ),
)
def _(i: Inputs):
    words = i.lines().select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''")
    # words are counted first, so each is judged once
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("w", text.is_plausible_word(F.col("w")).alias("ok"), "n")


@query(
    "is_plausible_word_with_lexicon",
    duckdb_with(
        ["fx_lines"],
        """with words as materialized (select lower(w) as w, count(*) as n from (select unnest(string_split(line, ' ')) as w from fx_lines) t where w <> '' group by 1),
lexicon as (select w, log10(n)+1 as zipf from words where n >= 3)
select words.w, n, coalesce(zipf >= 2.5, false) as ok from words left join lexicon using (w)""",
    ),
)
def _(i: Inputs):
    words = i.lines().select(F.explode(F.split(F.lower("line"), " ")).alias("w")).where("w <> ''")
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    lexicon = counted.where("n >= 3").select("w", (F.log10("n") + 1).alias("zipf"))
    return counted.join(lexicon, "w", "left").select(
        "w", "n", text.is_plausible_word(F.col("w"), F.col("zipf")).alias("ok")
    )


# --- image references --------------------------------------------------------


@query(
    "rewrite_image_refs",
    duckdb_with(
        ["fx_regions", "fx_doc_pages"],
        """with refs as (select r.unit_id, r.page_idx, r.idx, r.bx1, r.by1, r.bx2, r.by2, p.width, p.height
  from fx_regions r join fx_doc_pages p using (unit_id, page_idx))
select unit_id, page_idx, idx, 'see ![](page=0,bbox=[' || cast(round_even(bx1*1000.0::double/width,0) as bigint) || ', ' || cast(round_even(by1*1000.0::double/height,0) as bigint)
 || ', ' || cast(round_even(bx2*1000.0::double/width,0) as bigint) || ', ' || cast(round_even(by2*1000.0::double/height,0) as bigint) || ']) and ![](page=7,bbox=['
 || bx1 || ',1,2,3]) or ![](page=0,bbox=[1,2,3])' as c from refs""",
    ),
)
def _(i: Inputs):
    joined = i.regions().join(i.doc_pages(), ["unit_id", "page_idx"])
    box = F.concat_ws(",", "bx1", "by1", "bx2", "by2")
    markdown = F.concat(
        F.lit("see ![](page=0,bbox=["), box, F.lit("]) and ![](page=7,bbox=["), F.col("bx1"),
        F.lit(",1,2,3]) or ![](page=0,bbox=[1,2,3])"),
    )
    sized = joined.withColumn("sizes", F.array(F.struct("width", "height")))
    return sized.select(
        "unit_id", "page_idx", "idx", text.rewrite_image_refs(markdown, F.col("sizes")).alias("c")
    )


@query(
    "resolve_image_tags",
    duckdb_with(
        ["fx_lines"],
        """select doc_id, pos, line || ' ![Image 0-0](imgs/a.jpg) ![](page=0,bbox=[1, 2, 3, 4]) ![Image 1-1](imgs/b.jpg)' as c from fx_lines""",
    ),
)
def _(i: Inputs):
    tag = "![](page=0,bbox=[1, 2, 3, 4])"
    other = "![](page=1,bbox=[5, 6, 7, 8])"
    images = F.array(
        F.struct(F.lit(tag).alias("old"), F.lit("![Image 0-0](imgs/a.jpg)").alias("new")),
        F.struct(F.lit(other).alias("old"), F.lit("![Image 1-1](imgs/b.jpg)").alias("new")),
        F.struct(F.lit("not there").alias("old"), F.lit("x").alias("new")),
    )
    shaped = F.concat(F.col("line"), F.lit(f" {tag} {tag} {other}"))
    return i.lines().select(*KEYS, text.resolve_image_tags(shaped, images).alias("c"))


@query(
    "math_spans",
    duckdb_with(
        [],
        """with shaped as (select page_id, replace(replace(html, '$', ''), chr(92), '') as h from pages)
select page_id, 3 as n, 'x_' || page_id as first_expr, true as first_display, 'y' as second_expr, 'a$b' as third_expr from shaped""",
    ),
)
def _(i: Inputs):
    html = F.regexp_replace("html", r"[$\\]", "")
    shaped = F.concat(
        html,
        F.lit("<p>$$x_"), F.col("page_id").cast("string"),
        F.lit("$$ and $y$ costs \\$5 $ $</p><code>$z$</code><p>$$a$b$$</p>"),
    )
    spans = i.table("pages").select("page_id", text.split_math_spans(shaped).alias("s"))
    return spans.select(
        "page_id",
        F.size("s").alias("n"),
        F.col("s")[0]["expr"].alias("first_expr"),
        F.col("s")[0]["display"].alias("first_display"),
        F.col("s")[1]["expr"].alias("second_expr"),
        F.col("s")[2]["expr"].alias("third_expr"),
    )


# --- errors, requests and responses -----------------------------------------


def sql_error(col: str) -> str:
    return (
        f"(case when lower({col}) like '%timeout%' then 'timeout' when lower({col}) like '%connection%' then 'connection_error' "
        f"when lower({col}) like '%validation%' or lower({col}) like '%invalid%' then 'validation_error' "
        f"when lower({col}) like '%not found%' then 'not_found' when lower({col}) like '%rate limit%' then 'rate_limit_exceeded' else 'unknown' end)"
    )


@query(
    "classify_error",
    duckdb_with(["fx_tasks"], f"select error_message, {sql_error('error_message')} as kind, count(*) as n from fx_tasks group by 1, 2"),
)
def _(i: Inputs):
    kind = errors.classify_error(F.col("error_message"))
    return i.tasks().groupBy("error_message", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "is_retryable",
    duckdb_with(
        ["fx_tasks"],
        f"select task_id, {sql_error('error_message')} not in ('validation_error', 'not_found') as retryable from fx_tasks",
    ),
)
def _(i: Inputs):
    return i.tasks().select("task_id", errors.is_retryable(errors.classify_error(F.col("error_message"))).alias("retryable"))


@query(
    "extract_recognised_text",
    duckdb_with(
        ["fx_messages"],
        """select conv_id, turn, case turn%3 when 0 then trim(text, ' '||chr(10)) when 1 then '' end as content, case when turn%3=2 then 500 else 200 end as status from fx_messages""",
    ),
)
def _(i: Inputs):
    choice = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    body = _case(
        [(0, F.to_json(choice)), (1, F.lit('{"choices":[{"message":{"content":null,"role":"assistant"}}]}'))],
        F.col("turn") % 3,
        F.lit('{"choices":[]}'),
    )
    got = i.messages().select("conv_id", "turn", chat.extract_recognised_text(body).alias("r"))
    return got.select("conv_id", "turn", "r.content", "r.status")


@query(
    "build_request",
    duckdb_with(
        ["fx_regions"],
        """select unit_id, page_idx, idx, 'user' as role, 'data:image/jpeg;base64,' || idx as url,
case native_label when 'table' then 'Table Recognition:' when 'display_formula' then 'Formula Recognition:' when 'image' then null when 'header' then null else 'Text Recognition:' end as prompt, 8192 as max_tokens from fx_regions""",
    ),
)
def _(i: Inputs):
    from pagemill.operators.geometry import task_of

    uri = F.concat(F.lit("data:image/jpeg;base64,"), F.col("idx").cast("string"))
    request = i.regions().select("unit_id", "page_idx", "idx", chat.build_request(uri, task_of(F.col("native_label"))).alias("r"))
    at = lambda path: F.get_json_object("r", path)
    return request.select(
        "unit_id",
        "page_idx",
        "idx",
        at("$.messages[0].role").alias("role"),
        at("$.messages[0].content[0].image_url.url").alias("url"),
        at("$.messages[0].content[1].text").alias("prompt"),
        at("$.max_tokens").cast("int").alias("max_tokens"),
    )


def _requests(i: Inputs):
    """One request per message: a system message, then the message with an image."""
    part = lambda kind, text_, url: F.struct(
        F.lit(kind).alias("type"), text_.alias("text"), url.alias("url"), F.lit(None).cast("string").alias("data")
    )
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("data:image/png;base64,"), F.col("conv_id").cast("string"), F.lit(","), F.col("turn").cast("string"))
    plain = F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit(".png"))
    kind = F.when(F.col("turn") % 5 == 4, F.lit("audio")).otherwise(F.lit("image_url"))
    second = F.struct(kind.alias("type"), none.alias("text"), plain.alias("url"), none.alias("data"))
    parts = F.array(part("text", F.lit("first"), none), part("image_url", none, url), second, part("text", F.col("text"), none))
    opening = F.struct(F.lit("system").alias("role"), F.array(part("text", F.lit("be exact"), none)).alias("content"))
    request = F.struct(
        F.array(opening, F.struct(F.col("role").alias("role"), parts.alias("content"))).alias("messages"),
        F.when(F.col("turn") % 2 == 0, 100).alias("max_tokens"),
        F.lit(None).cast("double").alias("temperature"),
        F.lit(None).cast("double").alias("top_p"),
        F.lit(None).cast("int").alias("top_k"),
        F.when(F.col("turn") % 2 == 0, 1.5).alias("repetition_penalty"),
    )
    return i.messages().select("conv_id", "turn", request.alias("request"))


@query(
    "extract_image_sources",
    duckdb_with(
        ["fx_messages"],
        """select conv_id, turn, cast(k as int) as k, case k when 0 then 'data:image/png;base64,' || conv_id || ',' || turn else 'img/' || conv_id || '.png' end as source
from fx_messages, (values (0), (1)) v(k) where role='user' and not (k=1 and turn%5=4)""",
    ),
)
def _(i: Inputs):
    got = _requests(i).select(
        "conv_id", "turn", F.posexplode(chat.extract_image_sources(F.col("request.messages"))).alias("k", "source")
    )
    return got.select("conv_id", "turn", "k", "source")


@query(
    "apply_request_defaults",
    duckdb_with(
        ["fx_messages"],
        """select conv_id, turn, case when turn%2=0 then 100 else 8192 end as max_tokens, case when turn%2=0 then 1.5::double else 1.1::double end as repetition_penalty,
1 as top_k, case when role='user' and turn%5=4 then 'audio is not a valid type.' end as error from fx_messages""",
    ),
)
def _(i: Inputs):
    got = _requests(i).select("conv_id", "turn", chat.apply_request_defaults(F.col("request")).alias("r"))
    return got.select("conv_id", "turn", "r.max_tokens", "r.repetition_penalty", "r.top_k", "r.error")


@query(
    "chat_to_generate",
    duckdb_with(
        ["fx_messages"],
        """select conv_id, turn, case when role='user' and text <> '' then text else 'Text Recognition:' end as prompt,
case when role='user' then conv_id || ',' || turn end as first_image, case when role <> 'user' then 0 when turn%5=4 then 1 else 2 end as n_images,
case when turn%2=0 then 100 end as num_predict, case when turn%2=0 then 1.5::double end as repeat_penalty from fx_messages""",
    ),
)
def _(i: Inputs):
    got = _requests(i).select("conv_id", "turn", chat.chat_to_generate(F.col("request")).alias("g"))
    return got.select(
        "conv_id",
        "turn",
        "g.prompt",
        F.get("g.images", F.lit(0)).alias("first_image"),
        F.coalesce(F.size("g.images"), F.lit(0)).cast("int").alias("n_images"),
        "g.options.num_predict",
        "g.options.repeat_penalty",
    ).withColumn("n_images", F.greatest("n_images", F.lit(0)))
