"""Queries of the translation memory on the correspondence, chunk and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.languages import COLUMNS, column_of, sql_column_of
from quirelake.functions.text import checksum, is_blank, path_checksum, strip, summary
from quirelake.operators import memory
from quirelake.operators.references import tidy_key
from quirelake.plans.status import _TIDY, WIDE_SQL, live_chunks, target_languages, wide_memory
from quirelake.tables import load


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.wide_to_long(wide_memory(spark, sf_dir), COLUMNS)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered pairs with path_hash, languages by column name and both checksums; only those with both languages."""
    dirs = load(spark, sf_dir, "lang_dir").select("lang_dir_id", column_of(F.col("language")).alias("tgt_lang"))
    pairs = load(spark, sf_dir, "recovered_chunk_pair").join(dirs, "lang_dir_id")
    return pairs.select(
        "pair_id", F.coalesce(tidy_key("path_checksum"), F.lit("")).alias("path_hash"), column_of(F.col("src_lang")).alias("src_lang"), "tgt_lang",
        tidy_key("src_checksum").alias("src_checksum"), checksum(F.col("tgt_text")).alias("tgt_checksum"), "src_text", "tgt_text", "chunk_index",
        "recovered_at",
    ).where("src_lang is not null and tgt_lang is not null and tgt_text is not null")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    empty = spark.createDataFrame([], "lang string, path_hash string, checksum string, text string")
    texts = pairs.select(F.col("src_lang").alias("lang"), "path_hash", checksum(F.col("src_text")).alias("checksum"), F.col("src_text").alias("text")).unionByName(
        pairs.select(F.col("tgt_lang").alias("lang"), "path_hash", F.col("tgt_checksum").alias("checksum"), F.col("tgt_text").alias("text"))
    )
    return memory.put_texts(empty, texts)


def _source_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_hash -> the source language of the file's project."""
    paths = load(spark, sf_dir, "path_map").select(F.col("path_checksum").alias("path_hash"), F.split("relative_path", "/")[0].alias("project")).distinct()
    return paths.join(target_languages(spark, sf_dir).select("project", F.col("src_lang").alias("source_language")).distinct(), "project").drop("project")


def _long_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir).join(_source_languages(spark, sf_dir), "path_hash", "left")
    return long.withColumn("source_language", F.coalesce("source_language", F.lit("english")))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = live_chunks(spark, sf_dir).join(target_languages(spark, sf_dir), "project")
    return wanted.select("chunk_id", "path_hash", "rel_path", "chunk_index", F.col("checksum").alias("src_checksum"), "src_lang", F.col("lang").alias("tgt_lang"))


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.lookup(_requests(spark, sf_dir), memory.index(_long(spark, sf_dir)), _store(spark, sf_dir))


def correspondence_long(spark, sf_dir):
    return _long(spark, sf_dir).select("row_id", "path_hash", "lang", "checksum")


def correspondence_wide(spark, sf_dir):
    return memory.long_to_wide(_long(spark, sf_dir), COLUMNS).select("row_id", "path_hash", *COLUMNS)


def correspondence_add_lang(spark, sf_dir):
    return memory.add_language(wide_memory(spark, sf_dir), "armenian").drop("ord")


def correspondence_drop_lang(spark, sf_dir):
    return memory.drop_language(wide_memory(spark, sf_dir), "italian").drop("ord")


def chunk_store(spark, sf_dir):
    return _store(spark, sf_dir).select("lang", "path_hash", "checksum", F.length("text").cast("bigint").alias("n_chars"))


def store_any_text(spark, sf_dir):
    """For each checksum the text of the first (lang, path_hash) that has it."""
    return _store(spark, sf_dir).groupBy("checksum").agg(F.min(F.struct("lang", "path_hash")).alias("p")).select("checksum", "p.lang", "p.path_hash")


def path_registry(spark, sf_dir):
    known = load(spark, sf_dir, "path_map").select(path_checksum(F.col("relative_path")).alias("path_hash"), F.col("relative_path").alias("rel_path"))
    failures = load(spark, sf_dir, "chunk_failure").where("source_path is not null").select(path_checksum(F.col("source_path")).alias("path_hash"), F.col("source_path").alias("rel_path"))
    return memory.register_paths(known, failures)


def lookup_hits(spark, sf_dir):
    return _looked_up(spark, sf_dir).where("tgt_text is not null").select("chunk_id", "tgt_lang", "tgt_checksum", F.length("tgt_text").cast("bigint").alias("n_chars"))


def lookup_misses(spark, sf_dir):
    return _looked_up(spark, sf_dir).where("tgt_text is null").select("chunk_id", "tgt_lang")


def lookup_reverse(spark, sf_dir):
    """From target to source: what each recovered target text corresponds to in its source's language."""
    asked = _pairs(spark, sf_dir).select("pair_id", "path_hash", F.col("tgt_lang").alias("src_lang"), F.col("src_lang").alias("tgt_lang"), F.col("tgt_checksum").alias("src_checksum"))
    found = asked.join(memory.index(_long(spark, sf_dir)), ["path_hash", "src_lang", "tgt_lang", "src_checksum"])
    return found.select("pair_id", F.col("tgt_checksum").alias("source_checksum"))


def find_first_match(spark, sf_dir):
    """What the memory answers for the English chunks of every file that it or the scan knows."""
    wide = wide_memory(spark, sf_dir)
    asked = wide.where("path_hash <> '' and english <> ''").select("path_hash", F.col("english").alias("src_checksum"))
    scanned = load(spark, sf_dir, "source_chunk").select(F.coalesce(tidy_key("path_checksum"), F.lit("")).alias("path_hash"), F.col("checksum").alias("src_checksum"))
    return memory.first_match(wide, "english", "german", asked.union(scanned.where("path_hash <> ''")))


def wide_rows(spark, sf_dir):
    """The rows of the wide table with a checksum in some language."""
    return memory.drop_empty(wide_memory(spark, sf_dir), COLUMNS).select("row_id")


def index_last_wins(spark, sf_dir):
    return memory.index(_long(spark, sf_dir))


def upsert_pairs(spark, sf_dir):
    own = _long(spark, sf_dir)
    source = own.select(*memory.KEY, F.col("lang").alias("src_lang"), F.col("checksum").alias("src_checksum"))
    known = source.join(own.select(*memory.KEY, F.col("lang").alias("tgt_lang"), F.col("checksum").alias("tgt_checksum")), memory.KEY).where("src_lang <> tgt_lang")
    new = _pairs(spark, sf_dir).where("path_hash <> ''").select("path_hash", "src_lang", "src_checksum", "tgt_lang", "tgt_checksum", F.col("recovered_at").alias("ord"))
    return memory.upsert(known, new)


def clear_missing_rows(spark, sf_dir):
    kept, _ = memory.clear_missing(_long_with_source(spark, sf_dir), _store(spark, sf_dir), F.col("source_language"))
    return kept.select("row_id", "lang", "checksum")


def clear_missing_stats(spark, sf_dir):
    _, counts = memory.clear_missing(_long_with_source(spark, sf_dir), _store(spark, sf_dir), F.col("source_language"))
    return counts


def orphan_chunks(spark, sf_dir):
    store = _store(spark, sf_dir)
    kept, _ = memory.clear_missing(_long_with_source(spark, sf_dir), store, F.col("source_language"))
    return memory.orphans(store, kept).select("lang", "path_hash", "checksum")


def _least(df: DataFrame, column: str, condition: str = "true") -> str:
    return df.where(condition).agg(F.min(column).alias("x")).first()["x"]


def _cleared_checksum(spark, sf_dir, language_of_checksum: str, lang: str | None):
    long = _long_with_source(spark, sf_dir)
    value = _least(long, "checksum", language_of_checksum)
    kept, _ = memory.clear_checksum(long, _store(spark, sf_dir), value, F.col("source_language"), lang)
    return kept.select("row_id", "lang", "checksum")


def clear_checksum_source(spark, sf_dir):
    return _cleared_checksum(spark, sf_dir, "lang = source_language", None)


def clear_checksum_source_lang(spark, sf_dir):
    return _cleared_checksum(spark, sf_dir, "lang = source_language", "german")


def clear_checksum_stats(spark, sf_dir):
    """What clearing a source checksum for one language changes."""
    long, store = _long_with_source(spark, sf_dir), _store(spark, sf_dir)
    value = _least(long, "checksum", "lang = source_language")
    kept, left = memory.clear_checksum(long, store, value, F.col("source_language"), "german")
    return memory.change_counts(long, kept, store, left)


def clear_all_stats(spark, sf_dir):
    """What deleting all German texts changes."""
    long, store = _long(spark, sf_dir), _store(spark, sf_dir)
    return memory.change_counts(long, memory.clear_all(long, store, lang="german")[0], store, memory.clear_all(long, store, lang="german")[1])


def clear_checksum_target(spark, sf_dir):
    return _cleared_checksum(spark, sf_dir, "lang = 'german' and lang <> source_language", None)


def clear_all_lang(spark, sf_dir):
    kept, _ = memory.clear_all(_long(spark, sf_dir), _store(spark, sf_dir), lang="german")
    return kept.select("row_id", "lang", "checksum")


def clear_all_file(spark, sf_dir):
    long = _long(spark, sf_dir)
    kept, _ = memory.clear_all(long, _store(spark, sf_dir), path_hash=_least(long, "path_hash", "path_hash <> ''"))
    return kept.select("row_id", "lang", "checksum")


def clear_all_keyword(spark, sf_dir):
    """Texts left after all that contain a word are deleted."""
    _, store = memory.clear_all(_long(spark, sf_dir), _store(spark, sf_dir), keyword="matrix")
    return store.select("lang", "path_hash", "checksum")


def clear_all_keyword_file(spark, sf_dir):
    long = _long(spark, sf_dir)
    kept, _ = memory.clear_all(long, _store(spark, sf_dir), path_hash=_least(long, "path_hash", "path_hash <> ''"), keyword="e")
    return kept.select("row_id", "lang", "checksum")


def _sources(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "source_chunk").select(
        F.coalesce(tidy_key("path_checksum"), F.lit("")).alias("path_hash"), F.col("checksum").alias("src_checksum"), F.col("content").alias("src_text"),
        F.struct("scanned_at", "chunk_id").alias("ord"),
    )


def rebuild_pairs(spark, sf_dir):
    targets = _pairs(spark, sf_dir).drop("src_text")
    return memory.rebuild_pairs(_sources(spark, sf_dir), targets).select("pair_id", "src_lang", "tgt_lang", "src_checksum", "tgt_checksum", F.length("src_text").cast("bigint").alias("n_src_chars"))


def rebuild_unmatched(spark, sf_dir):
    return memory.unmatched_targets(_sources(spark, sf_dir), _pairs(spark, sf_dir)).select("pair_id")


def corrected_chunks(spark, sf_dir):
    """Pairs whose (stripped) target text is not what the memory has recorded, though it has recorded something."""
    targets = _pairs(spark, sf_dir).withColumn("tgt_checksum", checksum(strip(F.col("tgt_text"))))
    judged = memory.corresponds(targets, memory.index(_long(spark, sf_dir)))
    return judged.where("recorded_checksum is not null and not corresponds").select("pair_id", "recorded_checksum", F.col("tgt_checksum").alias("new_checksum"))


def session_dedupe(spark, sf_dir):
    """What becomes of each request: from the memory, translated, or a repetition of one translated before in the file."""
    marked = memory.mark_session(_looked_up(spark, sf_dir))
    outcome = F.when(F.col("tgt_text").isNotNull(), "hit").when(~F.col("is_first"), "repeated").otherwise("call")
    return marked.select("chunk_id", "rel_path", "tgt_lang", outcome.alias("outcome"))


def stats_by_file(spark, sf_dir):
    own = session_dedupe(spark, sf_dir)
    return own.groupBy("rel_path", "tgt_lang").agg(
        F.count_if(F.col("outcome") != "call").alias("from_cache"), F.count_if(F.col("outcome") == "call").alias("translated"), F.count(F.lit(1)).alias("total")
    )


def translation_stats(spark, sf_dir):
    return stats_by_file(spark, sf_dir).groupBy("tgt_lang").agg(*(F.sum(c).alias(c) for c in ("from_cache", "translated", "total")))


def run_summaries(spark, sf_dir):
    """What the command line says of a run, per target language."""
    rows = translation_stats(spark, sf_dir)
    none = F.lit(0)
    return rows.select("tgt_lang", summary(F.col("from_cache"), F.col("translated"), none, F.when(F.col("translated") > 5, 1).otherwise(0)).alias("summary"))


def run_labels(spark, sf_dir):
    """What each request comes to before a model is asked."""
    contents = load(spark, sf_dir, "source_chunk").select("chunk_id", "content", "chunk_type")
    marked = memory.mark_session(_looked_up(spark, sf_dir)).join(contents, "chunk_id")
    long = (F.col("chunk_type") == "typst") & (F.length("content") > 2000)
    label = F.when(is_blank(F.col("content")), "blank").when(F.col("tgt_text").isNotNull(), "hit").when(~F.col("is_first"), "repeated").when(long, "parts").otherwise("call")
    return marked.select("chunk_id", "tgt_lang", label.alias("label"))


def carry_over_metadata(spark, sf_dir):
    """Hits with what the existing target has for the chunk: its first failure's error and when it was recovered first."""
    hits = _looked_up(spark, sf_dir).where("tgt_text is not null")
    existing = _pairs(spark, sf_dir).groupBy("path_hash", "src_lang", "tgt_lang", "src_checksum").agg(
        F.min_by("pair_id", F.struct("recovered_at", "pair_id")).alias("first_pair_id"), F.min("recovered_at").alias("first_recovered_at")
    )
    return hits.join(existing, ["path_hash", "src_lang", "tgt_lang", "src_checksum"], "left").select("chunk_id", "tgt_lang", "first_pair_id", "first_recovered_at")


_STORE = f"""dirs as (select *, {sql_column_of('language')} as lang from lang_dir
), pairs as (
  select pair_id, coalesce({_TIDY}, '') as path_hash, {sql_column_of('src_lang')} as src_lang, d.lang as tgt_lang,
         nullif(lower(regexp_replace(src_checksum, '^\\s+|\\s+$', '', 'g')), '') as src_checksum, sha256(tgt_text) as tgt_checksum,
         src_text, tgt_text, chunk_index, recovered_at
  from recovered_chunk_pair join dirs d using (lang_dir_id)
  where {sql_column_of('src_lang')} is not null and d.lang is not null and tgt_text is not null
), store as (
  select lang, path_hash, checksum, any_value(text) as text from (
    select src_lang as lang, path_hash, sha256(src_text) as checksum, src_text as text from pairs where src_text is not null
    union all select tgt_lang, path_hash, tgt_checksum, tgt_text from pairs) group by all
), project_sources as (select project, min(lang) as src_lang from dirs where role = 'source' and lang is not null group by project
), project_targets as (
  select distinct d.project, s.src_lang, d.lang from dirs d join project_sources s using (project)
  where d.role = 'target' and d.lang is not null and d.lang <> s.src_lang
), path_sources as (
  select distinct path_checksum as path_hash, s.src_lang as source_language
  from path_map p join (select distinct project, src_lang from project_targets) s on s.project = split_part(p.relative_path, '/', 1)
), long as (
  select c.*, coalesce(p.source_language, 'english') as source_language from cells c left join path_sources p using (path_hash)
), mem_index as (
  select s.path_hash, s.lang as src_lang, t.lang as tgt_lang, s.checksum as src_checksum, arg_max(t.checksum, (s.ord, s.row_id)) as tgt_checksum
  from cells s join cells t on s.row_id = t.row_id and s.lang <> t.lang where s.path_hash <> '' group by all
), paths as (
  select distinct path_checksum as path_hash, relative_path as rel_path from path_map where removed_at is null
), requests as (
  select c.chunk_id, p.path_hash, p.rel_path, c.chunk_index, c.checksum as src_checksum, t.src_lang, t.lang as tgt_lang
  from (select *, {_TIDY} as ph from source_chunk where dropped_at is null) c
  join paths p on c.ph = p.path_hash join project_targets t on t.project = split_part(p.rel_path, '/', 1)
), looked as (
  select r.*, i.tgt_checksum, s.text as tgt_text from requests r
  left join (mem_index i join store s on s.path_hash = i.path_hash and s.lang = i.tgt_lang and s.checksum = i.tgt_checksum)
    on i.path_hash = r.path_hash and i.src_lang = r.src_lang and i.tgt_lang = r.tgt_lang and i.src_checksum = r.src_checksum
), present as (
  select l.*, s.checksum is not null as there from long l left join store s on s.lang = l.lang and s.path_hash = l.path_hash and s.checksum = l.checksum
), row_stays as (
  select row_id, bool_or(lang = source_language and there) and bool_or(lang <> source_language and there) as stays from present group by row_id
), kept as (select p.* from present p join row_stays r using (row_id) where r.stays and p.there
), outcomes as (
  select chunk_id, rel_path, tgt_lang, case when tgt_text is not null then 'hit'
    when row_number() over (partition by path_hash, tgt_lang, src_checksum order by chunk_index, chunk_id) > 1 then 'repeated' else 'call' end as outcome
  from looked
)"""
_B = f"with {WIDE_SQL}, {_STORE} "


def _sql_cleared(value: str, lang: str | None) -> str:
    """Cells left after a checksum is cleared."""
    want = "true" if lang is None else f"lang = '{lang}'"
    as_source_gone = "true" if lang is None else f"(lang = '{lang}' and lang <> source_language)"
    return f"""{_B}, value as (select {value} as v), marked as (
      select l.*, max(case when lang = source_language and checksum = (select v from value) then 1 else 0 end) over (partition by row_id) as as_source from long l
    ), judged as (
      select *, case when (select max(as_source) from marked) = 1 then as_source = 1 and {as_source_gone}
        else checksum = (select v from value) and lang <> source_language and {want} end as doomed from marked
    )
    select row_id, lang, checksum from judged where not doomed"""


def _sql_changes(kept: str, gone: str) -> str:
    """Counts of a change, from the cells that stay (row_id, lang) and the texts that go (lang, path_hash, checksum)."""
    return f"""{kept}
    select (select count(distinct row_id) from cells where row_id not in (select row_id from staying)) as removed_rows,
      (select count(*) from cells c where row_id in (select row_id from staying) and not exists (select 1 from staying s where s.row_id = c.row_id and s.lang = c.lang)) as cleared_fields,
      ({gone}) as deleted_texts"""


QUERIES = {
    f.__name__: f
    for f in (
        wide_rows, clear_checksum_stats, clear_all_stats, correspondence_long, correspondence_wide, correspondence_add_lang, correspondence_drop_lang, chunk_store, store_any_text, path_registry, lookup_hits,
        lookup_misses, lookup_reverse, find_first_match, index_last_wins, upsert_pairs, clear_missing_rows, clear_missing_stats, orphan_chunks,
        clear_checksum_source, clear_checksum_source_lang, clear_checksum_target, clear_all_lang, clear_all_file, clear_all_keyword, clear_all_keyword_file,
        rebuild_pairs, rebuild_unmatched, corrected_chunks, session_dedupe, stats_by_file, translation_stats, run_summaries, run_labels, carry_over_metadata,
    )
}
_LANGS = ", ".join(COLUMNS)
_STRIP = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
SQL = {
    "correspondence_long": _B + "select row_id, path_hash, lang, checksum from cells",
    "correspondence_wide": f"with {WIDE_SQL} select row_id, path_hash, {_LANGS} from wide where greatest({_LANGS}) <> ''",
    "correspondence_add_lang": f"with {WIDE_SQL} select * exclude (ord), '' as armenian from wide",
    "correspondence_drop_lang": f"with {WIDE_SQL} select * exclude (ord, italian) from wide",
    "chunk_store": _B + "select lang, path_hash, checksum, length(text) as n_chars from store",
    "store_any_text": _B + "select checksum, p.lang as lang, p.path_hash as path_hash from (select checksum, min({'lang': lang, 'path_hash': path_hash}) as p from store group by checksum)",
    "path_registry": """select path_hash, min(rel_path) as rel_path, count(distinct rel_path) as n_paths from (
        select sha256(relative_path) as path_hash, relative_path as rel_path from path_map
        union all select sha256(source_path), source_path from chunk_failure where source_path is not null) group by path_hash""",
    "lookup_hits": _B + "select chunk_id, tgt_lang, tgt_checksum, length(tgt_text) as n_chars from looked where tgt_text is not null",
    "lookup_misses": _B + "select chunk_id, tgt_lang from looked where tgt_text is null",
    "lookup_reverse": _B + "select p.pair_id, i.tgt_checksum as source_checksum from pairs p join mem_index i on i.path_hash = p.path_hash and i.src_lang = p.tgt_lang and i.tgt_lang = p.src_lang and i.src_checksum = p.tgt_checksum",
    "find_first_match": f"""with {WIDE_SQL}, asked as (
        select path_hash, english as src_checksum from wide where english <> '' and path_hash <> '' union select {_TIDY}, checksum from source_chunk where {_TIDY} is not null)
        select a.path_hash, a.src_checksum, nullif(arg_min(w.german, (w.ord, w.row_id)), '') as tgt_checksum from asked a
        join wide w on w.english = a.src_checksum and (w.path_hash = a.path_hash or w.path_hash = '') where w.english <> '' group by 1, 2""",
    "wide_rows": f"with {WIDE_SQL} select row_id from wide where {' or '.join(f"{c} <> ''" for c in COLUMNS)}",
    "clear_checksum_stats": _sql_changes(
        _sql_cleared("(select min(checksum) from long where lang = source_language)", "german").replace("select row_id, lang, checksum from judged where not doomed", ", staying as (select row_id, lang from judged where not doomed)"),
        "select count(*) from store s where exists (select 1 from judged j where j.doomed and j.lang = s.lang and j.path_hash = s.path_hash and j.checksum = s.checksum)",
    ),
    "clear_all_stats": _sql_changes(_B + ", staying as (select row_id, lang from cells where lang <> 'german')", "select count(*) from store where lang = 'german'"),
    "index_last_wins": _B + "select * from mem_index",
    "upsert_pairs": _B + """, known as (
        select s.path_hash, s.lang as src_lang, s.checksum as src_checksum, t.lang as tgt_lang, t.checksum as tgt_checksum, s.ord
        from cells s join cells t on s.row_id = t.row_id and s.lang <> t.lang
      ), takers as (
        select src_lang, src_checksum, arg_min(path_hash, (recovered_at, path_hash)) as taker from pairs p
        where path_hash <> '' and src_lang <> tgt_lang and src_checksum is not null and not exists (select 1 from known k where k.path_hash = p.path_hash and k.src_lang = p.src_lang and k.src_checksum = p.src_checksum)
        group by 1, 2)
      select path_hash, src_lang, src_checksum, tgt_lang, arg_max(tgt_checksum, (is_new, ord, tgt_checksum)) as tgt_checksum from (
        select case when k.path_hash = '' then coalesce(t.taker, '') else k.path_hash end as path_hash, k.src_lang, k.src_checksum, k.tgt_lang, k.tgt_checksum, k.ord, 0 as is_new
        from known k left join takers t on t.src_lang = k.src_lang and t.src_checksum = k.src_checksum
        union all select path_hash, src_lang, src_checksum, tgt_lang, tgt_checksum, recovered_at, 1 from pairs where path_hash <> '' and src_lang <> tgt_lang) group by all""",
    "clear_missing_rows": _B + "select row_id, lang, checksum from kept",
    "clear_missing_stats": _B + "select (select count(*) from row_stays where not stays) as removed_rows, (select count(*) from present join row_stays using (row_id) where stays and not there) as cleared_fields",
    "orphan_chunks": _B + "select s.lang, s.path_hash, s.checksum from store s where not exists (select 1 from kept k where k.lang = s.lang and k.path_hash = s.path_hash and k.checksum = s.checksum)",
    "clear_checksum_source": _sql_cleared("(select min(checksum) from long where lang = source_language)", None),
    "clear_checksum_source_lang": _sql_cleared("(select min(checksum) from long where lang = source_language)", "german"),
    "clear_checksum_target": _sql_cleared("(select min(checksum) from long where lang = 'german' and lang <> source_language)", None),
    "clear_all_lang": _B + "select row_id, lang, checksum from cells where lang <> 'german'",
    "clear_all_file": _B + "select row_id, lang, checksum from cells where path_hash <> (select min(path_hash) from cells where path_hash <> '')",
    "clear_all_keyword": _B + "select lang, path_hash, checksum from store where not contains(text, 'matrix')",
    "clear_all_keyword_file": _B + """select row_id, lang, checksum from cells c where not exists (select 1 from store s where s.lang = c.lang and s.path_hash = c.path_hash
        and s.checksum = c.checksum and contains(s.text, 'e') and s.path_hash = (select min(path_hash) from cells where path_hash <> ''))""",
    "rebuild_pairs": _B + f""", firsts as (select coalesce({_TIDY}, '') as path_hash, checksum, arg_min(content, (scanned_at, chunk_id)) as src from source_chunk group by 1, 2)
        select p.pair_id, p.src_lang, p.tgt_lang, p.src_checksum, p.tgt_checksum, length(f.src) as n_src_chars from pairs p join firsts f on f.path_hash = p.path_hash and f.checksum = p.src_checksum""",
    "rebuild_unmatched": _B + f"select pair_id from pairs p where not exists (select 1 from source_chunk s where coalesce({_TIDY.replace('path_checksum', 's.path_checksum')}, '') = p.path_hash and s.checksum = p.src_checksum)",
    "corrected_chunks": _B + f""", stripped as (select *, sha256(regexp_replace(tgt_text, '^{_STRIP}|{_STRIP}$', '', 'g')) as new_checksum from pairs)
        select p.pair_id, i.tgt_checksum as recorded_checksum, p.new_checksum from stripped p join mem_index i on i.path_hash = p.path_hash and i.src_lang = p.src_lang
        and i.tgt_lang = p.tgt_lang and i.src_checksum = p.src_checksum where i.tgt_checksum <> p.new_checksum""",
    "session_dedupe": _B + "select chunk_id, rel_path, tgt_lang, outcome from outcomes",
    "stats_by_file": _B + "select rel_path, tgt_lang, count_if(outcome <> 'call')::bigint as from_cache, count_if(outcome = 'call')::bigint as translated, count(*) as total from outcomes group by rel_path, tgt_lang",
    "translation_stats": _B + "select tgt_lang, count_if(outcome <> 'call')::bigint as from_cache, count_if(outcome = 'call')::bigint as translated, count(*) as total from outcomes group by tgt_lang",
    "run_summaries": _B + """, n as (select tgt_lang, count_if(outcome <> 'call') as c, count_if(outcome = 'call') as t from outcomes group by tgt_lang)
        select tgt_lang, 'from the memory: ' || c || chr(10) || 'translated: ' || t || case when t > 5 then chr(10) || 'failed: 1' else '' end as summary from n""",
    "run_labels": _B + f"""select o.chunk_id, o.tgt_lang, case when regexp_full_match(c.content, '{_STRIP[:-1]}*') then 'blank' when o.outcome = 'call' and c.chunk_type = 'typst' and length(c.content) > 2000 then 'parts' else o.outcome end as label
        from outcomes o join source_chunk c using (chunk_id)""",
    "carry_over_metadata": _B + """, existing as (select path_hash, src_lang, tgt_lang, src_checksum, arg_min(pair_id, (recovered_at, pair_id)) as first_pair_id, min(recovered_at) as first_recovered_at from pairs group by 1, 2, 3, 4)
        select l.chunk_id, l.tgt_lang, e.first_pair_id, e.first_recovered_at from looked l left join existing e on e.path_hash = l.path_hash and e.src_lang = l.src_lang
        and e.tgt_lang = l.tgt_lang and e.src_checksum = l.src_checksum where l.tgt_text is not null""",
}
