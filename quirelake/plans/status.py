"""Progress of the memory per language and file: how much of the live chunks is translated, and needs review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.languages import COLUMNS, column_of, sql_column_of
from quirelake.operators.references import tidy_key
from quirelake.tables import load


def _project(path: str):
    return F.element_at(F.split(path, "/"), 1)


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, path_hash, rel_path, project, chunk_index, checksum of the chunks that are in their file now."""
    paths = load(spark, sf_dir, "path_map").where("removed_at is null").select(
        F.col("path_checksum").alias("path_hash"), F.col("relative_path").alias("rel_path")
    ).distinct()
    chunks = load(spark, sf_dir, "source_chunk").where("dropped_at is null").select(
        "chunk_id", tidy_key("path_checksum").alias("path_hash"), "chunk_index", "checksum"
    )
    return chunks.join(paths, "path_hash").withColumn("project", _project("rel_path"))


def target_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, src_lang, lang: the source and target languages of each project whose labels name one."""
    dirs = load(spark, sf_dir, "lang_dir").withColumn("lang", column_of(F.col("language"))).where("lang is not null")
    sources = dirs.where("role = 'source'").groupBy("project").agg(F.min("lang").alias("src_lang"))
    return dirs.where("role = 'target'").select("project", "lang").distinct().join(sources, "project").where("lang <> src_lang")


def wide_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correspondence table with path_hash, row_id, ord (time and number of the row) and the languages."""
    rows = load(spark, sf_dir, "correspondence")
    return rows.select(
        F.coalesce(tidy_key("path_checksum"), F.lit("")).alias("path_hash"),
        F.col("corr_id").alias("row_id"),
        F.col("written_at").alias("ord"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS),
    )


def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, rel_path, chunk_index, lang of the chunks of which a call failed: their translation is to be reviewed."""
    dirs = load(spark, sf_dir, "lang_dir").select("lang_dir_id", "project", column_of(F.col("language")).alias("lang"))
    failures = load(spark, sf_dir, "chunk_failure").where("source_path is not null")
    return (
        failures.join(dirs, "lang_dir_id")
        .where("lang is not null")
        .select(F.col("source_path").alias("rel_path"), "chunk_index", "lang")
        .distinct()
        .withColumn("to_review", F.lit(1))
    )


def judged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each live chunk and target language: rel_path, lang, translated, needs_review, known."""
    wanted = live_chunks(spark, sf_dir).join(target_languages(spark, sf_dir), "project")
    wide = wide_memory(spark, sf_dir).where("path_hash <> ''")
    cells = F.filter(F.array(*(F.struct(F.lit(c).alias("lang"), F.col(c).alias("checksum")) for c in COLUMNS)), lambda c: c["checksum"] != "")
    # the last row of each (file, language, checksum) wins, whole
    rows = wide.withColumn("cells", cells).withColumn("cell", F.explode("cells"))
    last = rows.groupBy("path_hash", F.col("cell.lang").alias("src_lang"), F.col("cell.checksum").alias("checksum")).agg(
        F.max_by("cells", F.struct("ord", "row_id")).alias("cells")
    )
    joined = wanted.join(last, ["path_hash", "src_lang", "checksum"], "left").join(
        review_marks(spark, sf_dir), ["rel_path", "chunk_index", "lang"], "left"
    )
    translated = F.coalesce(F.exists("cells", lambda c: c["lang"] == F.col("lang")), F.lit(False))
    return joined.select(
        "rel_path", "lang", translated.alias("translated"), (translated & F.col("to_review").isNotNull()).alias("needs_review"),
        F.col("cells").isNotNull().alias("known"),
    )


def _counts(grouped) -> DataFrame:
    out = grouped.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("translated").alias("translated"), F.count_if("needs_review").alias("needs_review")
    )
    percent = lambda x, y: F.when(y > 0, F.floor(x * 100 / y)).otherwise(0).cast("bigint")
    return out.withColumns(
        {
            "untranslated": F.col("total") - F.col("translated"),
            "proofread": F.col("translated") - F.col("needs_review"),
            "pct_translated": percent(F.col("translated"), F.col("total")),
        }
    ).withColumn("pct_proofread", percent(F.col("proofread"), F.col("translated")))


def status_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(judged_chunks(spark, sf_dir).groupBy("lang"))


def status_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(judged_chunks(spark, sf_dir).groupBy("lang", "rel_path"))


def status_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both at once; rel_path is null in the rows of a whole language."""
    judged = judged_chunks(spark, sf_dir)
    return _counts(judged.groupingSets([["lang"], ["lang", "rel_path"]], "lang", "rel_path"))


def never_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which no chunk has a row in the memory, whatever its targets."""
    judged = judged_chunks(spark, sf_dir)
    return judged.groupBy("rel_path").agg(F.bool_or("known").alias("known")).where("not known").select("rel_path")


_TIDY = r"nullif(lower(regexp_replace(path_checksum, '^\s+|\s+$', '', 'g')), '')"
_UNPIVOT = " union all ".join(
    f"select path_hash, row_id, ord, '{c}' as lang, {c} as checksum from wide where {c} <> ''" for c in COLUMNS
)
WIDE_SQL = f"""wide as (
  select coalesce({_TIDY}, '') as path_hash, corr_id as row_id, written_at as ord, {', '.join(f"coalesce({c}, '') as {c}" for c in COLUMNS)}
  from correspondence
), cells as ({_UNPIVOT})"""
_BASE = f"""with {WIDE_SQL}, paths as (
  select distinct path_checksum as path_hash, relative_path as rel_path from path_map where removed_at is null
), dirs as (
  select *, {sql_column_of('language')} as lang from lang_dir
), sources as (select project, min(lang) as src_lang from dirs where role = 'source' and lang is not null group by project
), targets as (
  select distinct d.project, s.src_lang, d.lang from dirs d join sources s using (project)
  where d.role = 'target' and d.lang is not null and d.lang <> s.src_lang
), wanted as (
  select c.chunk_id, p.path_hash, p.rel_path, c.chunk_index, c.checksum, t.src_lang, t.lang
  from (select *, {_TIDY} as ph from source_chunk where dropped_at is null) c
  join paths p on c.ph = p.path_hash join targets t on t.project = split_part(p.rel_path, '/', 1)
), last as (
  select path_hash, lang as src_lang, checksum, arg_max(row_id, (ord, row_id)) as row_id from cells where path_hash <> '' group by all
), marks as (
  select distinct f.source_path as rel_path, f.chunk_index, d.lang from chunk_failure f join dirs d using (lang_dir_id)
  where f.source_path is not null and d.lang is not null
), judged as (
  select w.rel_path, w.lang, l.row_id is not null as known, c.checksum is not null as translated,
         c.checksum is not null and m.lang is not null as needs_review
  from wanted w
  left join last l on l.path_hash = w.path_hash and l.src_lang = w.src_lang and l.checksum = w.checksum
  left join cells c on c.row_id = l.row_id and c.lang = w.lang
  left join marks m on m.rel_path = w.rel_path and m.chunk_index = w.chunk_index and m.lang = w.lang
)"""
_COUNTS = """count(*) as total, count_if(translated)::bigint as translated, count_if(needs_review)::bigint as needs_review,
  (count(*) - count_if(translated))::bigint as untranslated, (count_if(translated) - count_if(needs_review))::bigint as proofread,
  floor(count_if(translated) * 100 / count(*))::bigint as pct_translated,
  coalesce(floor((count_if(translated) - count_if(needs_review)) * 100 / nullif(count_if(translated), 0)), 0)::bigint as pct_proofread"""

QUERIES = {
    "status_by_lang": status_by_lang,
    "status_by_file": status_by_file,
    "status_grouping_sets": status_grouping_sets,
    "never_processed": never_processed,
}
SQL = {
    "status_by_lang": f"{_BASE} select lang, {_COUNTS} from judged group by lang",
    "status_by_file": f"{_BASE} select lang, rel_path, {_COUNTS} from judged group by lang, rel_path",
    "status_grouping_sets": f"{_BASE} select lang, rel_path, {_COUNTS} from judged group by grouping sets ((lang), (lang, rel_path))",
    "never_processed": f"{_BASE} select rel_path from judged group by rel_path having not bool_or(known)",
}
