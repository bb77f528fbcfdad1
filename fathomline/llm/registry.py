"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import align, bpe, decontam, lm, planes, quality, repair, secrets, sharding, simhash, suffix, topk, warc
from fathomline.llm.common import table


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"))


def op12_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.report(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_histogram_shards, op2_quality, op3_pivot_top_k, op4_bpe, op5_decontamination, op6_simhash, op7_warc, op8_secrets, op9_gru, op10_suffix_dedup, op11_align, op12_planes, op13_repair)}


OP5_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), i as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) as s from b)
), m as (select distinct m from i), h as (
  select doc_id, s, m.m, array_to_string(w[s:s + m.m - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as s from d), m
  where s + m.m - 1 <= len(w)
), f as (
  select h.doc_id, h.s, h.m, i.item_id from h join i using (m, g)
), c as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from f) group by doc_id
), n as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, cast(item_id as varchar) as item_id from f) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join n using (doc_id)
"""


OP3_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.n, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s) where rank <= 5
"""

OP7_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), m as (select *, min(page_id) over (partition by payload_digest) as low from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> low then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> low then low end as refers_to
from m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_pivot_top_k": OP3_SQL, "op7_warc": OP7_SQL, "op5_decontamination": OP5_SQL}
