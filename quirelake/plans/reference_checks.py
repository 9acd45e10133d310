"""Queries p3_*: dangling references between the tables of the memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.references import as_references, as_targets, by_month, dangling
from quirelake.tables import load


def all_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dangling references of correspondence, source_chunk and recovered_chunk_pair."""
    chunks = load(spark, sf_dir, "source_chunk")
    pairs = load(spark, sf_dir, "recovered_chunk_pair")
    paths = as_targets(load(spark, sf_dir, "path_map"), ["path_checksum"], "registered_at", "removed_at")
    to_paths = as_references(
        load(spark, sf_dir, "correspondence"), "correspondence", "corr_id", ["path_checksum"], "written_at"
    ).unionByName(as_references(chunks, "source_chunk", "chunk_id", ["path_checksum"], "scanned_at"))
    to_chunks = as_references(
        pairs, "recovered_chunk_pair", "pair_id", ["path_checksum", "src_checksum"], "recovered_at"
    )
    stored = as_targets(chunks, ["path_checksum", "checksum"], "scanned_at", "dropped_at")
    return dangling(to_paths, paths).unionByName(dangling(to_chunks, stored, n_keys=2))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_dangling(spark, sf_dir).select("table_name", "record_id", "kind")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_month(all_dangling(spark, sf_dir))


def _with_nulls(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    """Failed calls that refer to chunks by file and number, either of which may be null."""
    chunks = load(spark, sf_dir, "source_chunk").join(load(spark, sf_dir, "path_map").select("path_checksum", "relative_path").distinct(), "path_checksum")
    stored = chunks.select("relative_path", F.col("chunk_index").cast("string").alias("chunk_no"), "scanned_at", "dropped_at")
    failures = load(spark, sf_dir, "chunk_failure").select("failure_id", "source_path", F.when(F.col("source_line").isNotNull(), F.col("chunk_index").cast("string")).alias("chunk_no"), "failed_at")
    refs = as_references(failures, "chunk_failure", "failure_id", ["source_path", "chunk_no"], "failed_at")
    found = dangling(refs, as_targets(stored, ["relative_path", "chunk_no"], "scanned_at", "dropped_at"), n_keys=2, match=match)
    return found.select("table_name", "record_id", "kind")


def p3_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir, "partial")


def p3_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir, "full")


_KEY = r"nullif(lower(regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')), '')"
_CASES = f"""
with refs as (
  select 'correspondence' as table_name, corr_id as record_id, {_KEY.format('path_checksum')} as k0, '' as k1, written_at as ref_at from correspondence
  union all
  select 'source_chunk', chunk_id, {_KEY.format('path_checksum')}, '', scanned_at from source_chunk
  union all
  select 'recovered_chunk_pair', pair_id, {_KEY.format('path_checksum')}, {_KEY.format('src_checksum')}, recovered_at from recovered_chunk_pair
), targets as (
  select {_KEY.format('path_checksum')} as k0, '' as k1, registered_at as b, removed_at as e from path_map
  union all
  select {_KEY.format('path_checksum')}, {_KEY.format('checksum')}, scanned_at, dropped_at from source_chunk
), judged as (
  select r.table_name, r.record_id, r.ref_at, count(t.b) as n,
         count(*) filter (where t.b <= r.ref_at and (t.e is null or r.ref_at < t.e)) as n_alive, min(t.b) as first_begin
  from refs r left join targets t on r.k0 = t.k0 and r.k1 = t.k1
  where r.k0 is not null and r.k1 is not null
  group by r.table_name, r.record_id, r.ref_at
), cases as (
  select table_name, record_id, ref_at,
         case when n = 0 then 'missing' when first_begin > ref_at then 'late' else 'deleted' end as kind
  from judged where n_alive = 0
)
"""

_NULLS = f"""
with refs as (
  select failure_id as record_id, {_KEY.format('source_path')} as k0, case when source_line is not null then chunk_index::varchar end as k1, failed_at as ref_at from chunk_failure
), targets as (
  select {_KEY.format('p.relative_path')} as k0, chunk_index::varchar as k1, scanned_at as b, dropped_at as e
  from source_chunk c join (select distinct path_checksum, relative_path from path_map) p on p.path_checksum = c.path_checksum
), judged as (
  select r.record_id, r.ref_at, r.k0, r.k1, count(t.b) as n, count(*) filter (where t.b <= r.ref_at and (t.e is null or r.ref_at < t.e)) as n_alive, min(t.b) as first_begin
  from refs r left join targets t on (r.k0 is null or r.k0 = t.k0) and (r.k1 is null or r.k1 = t.k1) and t.k0 is not null
  where r.k0 is not null or r.k1 is not null group by all
)
select 'chunk_failure' as table_name, record_id, case when {{always}} or n = 0 then 'missing' when first_begin > ref_at then 'late' else 'deleted' end as kind
from judged where {{always}} or n = 0 or (n_alive = 0 and ref_at is not null)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_partial": p3_partial, "p3_full": p3_full}
SQL = {
    "p3_partial": _NULLS.format(always="false"),
    "p3_full": _NULLS.format(always="(k0 is null or k1 is null)"),
    "p3_found": _CASES + "select table_name, record_id, kind from cases",
    "p3_report": _CASES + "select table_name, strftime(ref_at, '%Y-%m') as month, kind, count(*) as n from cases group by all",
}
