"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.bagminhash import near_duplicates
from pagemill.llm.bpe import bpe_digests
from pagemill.llm.common import table
from pagemill.llm.exact_dedup import content_sort
from pagemill.llm.filter_audit import audit
from pagemill.llm.language_id import identify
from pagemill.llm.line_templates import line_report
from pagemill.llm.packing import pack
from pagemill.llm.periodic_runs import periodic_runs
from pagemill.llm.quality import classify
from pagemill.llm.sharding import hilbert_shards
from pagemill.llm.suffix_dedup import suffix_digests
from pagemill.llm.warc import archive_pages
from pagemill.llm.winnowing import edit_fingerprints

#: The tokenizer file of the token queries.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: The vocabulary of the language models.
PIECES = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op1_bpe_lexicon")
def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query(
    "op2_content_sort",
    """
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window g as (partition by coalesce(text, ''))
    """,
)
def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"))


@query("op3_suffix_sort")
def op3_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(table(spark, sf_dir, "documents"))


@query("op4_line_templates")
def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


@query(
    "op5_warc_archive",
    """
    select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest,
           case when page_id = first or strlen(html) < 100 then 'response' else 'revisit' end as record_type,
           case when page_id = first or strlen(html) < 100 then null else first end as refers_to
    from (select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages)
    """,
)
def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages"))


@query("op6_winnowing")
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


@query("op7_hilbert_shards")
def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


@query("op8_best_two_fit")
def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op9_co_training")
def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_bagminhash")
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_segment_unigrams")
def op11_segment_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), PIECES)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


@query(
    "op13_filter_audit",
    r"""
    with recursive words as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
               min(doc_id) over (partition by coalesce(text, '')) as first
        from documents
    ), known as (
        select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
        from labels group by doc_id
    ), judged as (
        select w.part, coalesce(k.good, 0) as good, coalesce(k.toxic, 0) as toxic,
               case when len(words) < 200 then 'A' else '' end
               || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
               || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end
               || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
               || case when w.doc_id > first then 'E' else '' end as fails
        from words w left join known k on w.doc_id = k.doc_id
    ), counted as (select part, good, toxic, fails, count(*) as n from judged group by all),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
    orders as (
        select f as filter_order from letters
        union all
        select filter_order || f from orders join letters on not contains(filter_order, f)
    ), steps as (
        select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before
        from orders, (select unnest(range(1, 6)) as step) where length(filter_order) = 5
    ), outcomes as (
        select part, filter_order, step, f, n, good, toxic, contains(fails, f) as here, fails = f as alone,
               fails <> '' and len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 as gone
        from counted, steps
    ), summed as (
        select part, filter_order, step::int as step, f,
               sum(case when not here and not gone then n else 0 end)::bigint as kept,
               sum(case when here and not gone then n else 0 end)::bigint as removed,
               sum(case when here and gone then n else 0 end)::bigint as redundant,
               sum(case when alone then n else 0 end)::bigint as unique_fails,
               sum(case when here and not gone then n * good else 0 end)::bigint as good_lost,
               sum(case when here and not gone then n * toxic else 0 end)::bigint as toxic_lost
        from outcomes group by all
    )
    select * exclude (f), sum(removed) over (partition by part, f)::bigint as shapley from summed
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
