"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.llm import decontaminate, html_text, line_dedup, media, quality, sentencepiece_fst, simhash, token_store, toxicity, url_filter
from velora.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_store.store_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_back(spark, path)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_cut", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are decoded from the ids that the encoder gave; the digest tells whether they came back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"), path)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "score")), "keep")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is labels.quality of the row with its id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: Windows of items are words in a row, so that equal windows are equal strings.
OP1_SQL = r"""
with words as (
  select doc_id, row_number() over () as row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id::varchar as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null
), windows as (
  select distinct item_id, least(8, len(w)) as size, array_to_string(w[k : k + least(8, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) as k from items where len(w) > 0)
), places as (
  select row_id, k, size, array_to_string(w[k : k + size - 1], ' ') as win
  from (select row_id, w, size, unnest(range(1, len(w) - size + 2)) as k from words, (select distinct size from windows))
), found as (select row_id, k, size, item_id from places join windows using (size, win)),
hits as (select row_id, count(distinct spot) as n_hit from (select row_id, unnest(range(k, k + size)) as spot from (select distinct row_id, k, size from found)) group by row_id),
of_doc as (select row_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct row_id, item_id from found) group by row_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from words left join hits using (row_id) left join of_doc using (row_id)
"""

OP9_SQL = """
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages)
), known as (
  select doc_id, count(*) as n, sum(quality) as good from labels where quality in (0, 1) group by doc_id
), hosts as (
  select host, case when address then 'ip' when country then array_to_string(labels[-2:], '.') else labels[-1] end as suffix,
    case when address then name when country then array_to_string(labels[-3:], '.') else array_to_string(labels[-2:], '.') end as dom, n, good
  from (select *, string_split(name, '.') as labels, regexp_matches(name, '^([0-9]{1,3}([.][0-9]{1,3}){3}|\\[.*\\])$') as address,
      regexp_matches(name, '(^|[.])(ac|co|com|edu|go|gov|ne|net|or|org)[.][a-z][a-z]$') as country
    from (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name, coalesce(sum(n), 0) as n, coalesce(sum(good), 0) as good
      from parts left join known on page_id = doc_id group by host))
), total as (
  select (sum(good) + 1.0) / (sum(n) + 1.0) as m_0 from hosts
), suffixes as (
  select suffix, (sum(good) + 8.0::double * max(m_0::double)) / (sum(n) + 8.0::double) as m_s from hosts, total group by suffix
), domains as (
  select dom, (sum(good) + 8.0::double * max(m_s)) / (sum(n) + 8.0::double) as m_d from hosts join suffixes using (suffix) group by dom
), posterior as (
  select host, n, (good + 8.0::double * m_d) / (n + 8.0::double) as m from hosts join domains using (dom)
), rated as (
  select host, m + 1.645::double * sqrt(m * (1 - m) / (n + 8.0::double + 1)) as upper_bound from posterior
), ruled as (
  select parts.*, upper_bound,
    case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
         when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
         when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from parts join rated using (host)
)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
       when upper_bound < 0.5 then 'block' else 'allow' end as verdict,
  round(upper_bound, 6) as reputation
from ruled
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_token_store": op2_token_store,
    "op3_html_extraction": op3_html_extraction,
    "op4_media_columns": op4_media_columns,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op1_benchmark_decontamination": OP1_SQL, "op9_url_filter": OP9_SQL}
