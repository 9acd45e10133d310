"""The translation memory: which checksum in one language corresponds to which in another, per file.

The memory is kept long: one row (path_hash, row_id, ord, lang, checksum) for each filled cell of a correspondence row;
the wide table with a column per language exists only at the edge.  `''` is the null marker of the wide table and is
dropped when the long one is made.  Texts are in a store (lang, path_hash, checksum, text), addressed by content.

Mutations are pure: they return the new tables and counts of what changed, and never write where they read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["path_hash", "row_id", "ord"]


# -- shape ------------------------------------------------------------------------------------------------------------


def wide_to_long(wide: DataFrame, languages: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """One row for each filled language cell."""
    return (
        wide.unpivot([*keys], [*languages], "lang", "checksum")
        .where("checksum is not null and checksum <> ''")
        .select(*keys, "lang", "checksum")
    )


def long_to_wide(long: DataFrame, languages: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """A column for each language, '' where a row has none."""
    wide = long.groupBy(*keys).pivot("lang", [*languages]).agg(F.max("checksum"))
    return wide.select(*keys, *(F.coalesce(lang, F.lit("")).alias(lang) for lang in languages))


def add_language(wide: DataFrame, language: str) -> DataFrame:
    return wide if language in wide.columns else wide.withColumn(language, F.lit(""))


def drop_language(wide: DataFrame, language: str) -> DataFrame:
    return wide.drop(language)


def has_any_language(languages: Sequence[str]) -> Column:
    return F.exists(F.array(*languages), lambda cell: F.coalesce(cell, F.lit("")) != "")


def drop_empty(wide: DataFrame, languages: Sequence[str]) -> DataFrame:
    """The rows with a checksum in some language."""
    return wide.where(has_any_language(languages))


# -- lookup -----------------------------------------------------------------------------------------------------------


def index(long: DataFrame) -> DataFrame:
    """path_hash, src_lang, tgt_lang, src_checksum -> tgt_checksum, in all directions; the last row wins.

    Rows without a path are not in the index."""
    own = long.where("path_hash <> ''")
    source = own.select(*KEY, F.col("lang").alias("src_lang"), F.col("checksum").alias("src_checksum"))
    target = own.select(*KEY, F.col("lang").alias("tgt_lang"), F.col("checksum").alias("tgt_checksum"))
    pairs = source.join(target, KEY).where("src_lang <> tgt_lang")
    return pairs.groupBy("path_hash", "src_lang", "tgt_lang", "src_checksum").agg(
        F.max_by("tgt_checksum", F.struct("ord", "row_id")).alias("tgt_checksum")
    )


def lookup(requests: DataFrame, memory_index: DataFrame, store: DataFrame) -> DataFrame:
    """The requests with tgt_checksum and tgt_text; a hit needs the text to be in the store still."""
    texts = store.select(
        "path_hash", F.col("lang").alias("tgt_lang"), F.col("checksum").alias("tgt_checksum"), F.col("text").alias("tgt_text")
    )
    found = memory_index.join(texts, ["path_hash", "tgt_lang", "tgt_checksum"])
    return requests.join(found, ["path_hash", "src_lang", "tgt_lang", "src_checksum"], "left")


def first_match(wide: DataFrame, src_lang: str, tgt_lang: str, asked: DataFrame) -> DataFrame:
    """path_hash, src_checksum, tgt_checksum of the first row that answers each asked key (path_hash, src_checksum); null
    if that row's target is empty. A row without a path answers for every path."""
    place = F.struct("ord", "row_id")
    first = F.min(F.struct(place.alias("place"), F.nullif(F.col(tgt_lang), F.lit("")).alias("tgt_checksum")))
    rows = wide.where(F.coalesce(src_lang, F.lit("")) != "").withColumn("src_checksum", F.col(src_lang))
    own = rows.where("path_hash <> ''").groupBy("path_hash", "src_checksum").agg(first.alias("own"))
    free = rows.where("path_hash = ''").groupBy("src_checksum").agg(first.alias("free"))
    found = asked.select("path_hash", "src_checksum").distinct().join(own, ["path_hash", "src_checksum"], "left").join(free, "src_checksum", "left")
    best = F.least("own", "free")  # the one that is there, or the earlier of two
    return found.where(best.isNotNull()).select("path_hash", "src_checksum", best["tgt_checksum"].alias("tgt_checksum"))


def corresponds(targets: DataFrame, memory_index: DataFrame) -> DataFrame:
    """Whether each (path_hash, src_lang, tgt_lang, src_checksum, tgt_checksum) is what the memory has."""
    recorded = memory_index.withColumnRenamed("tgt_checksum", "recorded_checksum")
    joined = targets.join(recorded, ["path_hash", "src_lang", "tgt_lang", "src_checksum"], "left")
    return joined.withColumn("corresponds", F.coalesce(F.col("recorded_checksum") == F.col("tgt_checksum"), F.lit(False)))


# -- writing ----------------------------------------------------------------------------------------------------------


def put_texts(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the texts it has not yet; a text that is there is never written again."""
    key = ["lang", "path_hash", "checksum"]
    fresh = new.select(*key, "text").dropDuplicates(key).join(store, key, "left_anti")
    return store.select(*key, "text").unionByName(fresh)


def register_paths(known: DataFrame, paths: DataFrame) -> DataFrame:
    """path_hash, rel_path of all paths; more than one path for a hash shows as n_paths > 1."""
    every = known.select("path_hash", "rel_path").unionByName(paths.select("path_hash", "rel_path"))
    return every.groupBy("path_hash").agg(F.min("rel_path").alias("rel_path"), F.countDistinct("rel_path").alias("n_paths"))


def upsert(pairs_known: DataFrame, pairs_new: DataFrame) -> DataFrame:
    """path_hash, src_lang, src_checksum, tgt_lang -> tgt_checksum after an upsert; the newest pair wins.

    Both: those columns and `ord`; what is new counts as later than all that is known. Pairs of a language with itself
    are ignored. Known pairs without a path answer for every path, so the first new pair of a path that has none of its
    own for their source takes them over, with all their targets."""
    key = ["path_hash", "src_lang", "src_checksum", "tgt_lang"]
    source = ["src_lang", "src_checksum"]
    new = pairs_new.where("src_lang <> tgt_lang")
    own = pairs_known.where("path_hash <> ''").select("path_hash", *source).distinct()
    takers = (
        new.select("path_hash", *source, "ord").join(own, ["path_hash", *source], "left_anti")
        .groupBy(*source).agg(F.min(F.struct("ord", "path_hash"))["path_hash"].alias("taker"))
    )
    free = pairs_known.where("path_hash = ''").join(takers, source, "left").withColumn("path_hash", F.coalesce("taker", F.lit("")))
    known = pairs_known.where("path_hash <> ''").select(*key, "tgt_checksum", "ord").unionByName(free.select(*key, "tgt_checksum", "ord"))
    every = known.withColumn("is_new", F.lit(0)).unionByName(new.select(*key, "tgt_checksum", "ord", F.lit(1).alias("is_new")))
    return every.groupBy(*key).agg(F.max_by("tgt_checksum", F.struct("is_new", "ord", "tgt_checksum")).alias("tgt_checksum"))


# -- clearing ---------------------------------------------------------------------------------------------------------


def _with_presence(long: DataFrame, store: DataFrame) -> DataFrame:
    there = store.select("lang", "path_hash", "checksum").distinct().withColumn("present", F.lit(True))
    return long.join(there, ["lang", "path_hash", "checksum"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def clear_missing(long: DataFrame, store: DataFrame, source_language: Column) -> tuple[DataFrame, DataFrame]:
    """The cells that stay, and the counts (removed_rows, cleared_fields).

    A row stays if its source text and at least one target text are in the store; its other target cells without a
    text are cleared. source_language: the row's source language."""
    cells = _with_presence(long, store).withColumn("is_source", F.col("lang") == source_language)
    rows = cells.groupBy(*KEY).agg(
        (F.bool_or(F.col("is_source") & F.col("present")) & F.bool_or(~F.col("is_source") & F.col("present"))).alias("stays")
    )
    judged = cells.join(rows, KEY)
    kept = judged.where("stays and present").select(*KEY, "lang", "checksum")
    counts = judged.agg(
        F.countDistinct(F.when(~F.col("stays"), F.struct(*KEY))).alias("removed_rows"),
        F.count_if(F.col("stays") & ~F.col("present")).alias("cleared_fields"),
    )
    return kept, counts


def orphans(store: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored texts that no surviving cell refers to."""
    key = ["lang", "path_hash", "checksum"]
    return store.join(kept.select(*key).distinct(), key, "left_anti")


def clear_checksum(long: DataFrame, store: DataFrame, checksum: str, source_language: Column, lang: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and stored texts after everything about a checksum is deleted.

    If some row has it as its source: without a language its rows go, with all their texts; with one only that target's
    cell and text, and the row only if no cell at all is left, its source counted. Otherwise matching target cells, of
    the one or of all languages, go with their texts."""
    cells = long.withColumn("is_source", F.col("lang") == source_language)
    hit = F.col("checksum") == checksum
    marked = cells.withColumn("as_source", F.max(F.when(F.col("is_source") & hit, 1).otherwise(0)).over(Window.partitionBy(*KEY)))
    anywhere = F.broadcast(marked.agg(F.coalesce(F.max("as_source"), F.lit(0)).alias("is_source_checksum")))  # one row
    wanted = F.lit(True) if lang is None else F.col("lang") == lang
    doomed = F.when(
        F.col("is_source_checksum") == 1,
        (F.col("as_source") == 1) & (F.lit(lang is None) | (wanted & ~F.col("is_source"))),
    ).otherwise(hit & ~F.col("is_source") & wanted)
    judged = marked.crossJoin(anywhere).withColumn("doomed", doomed)
    kept = judged.where("not doomed")
    gone = judged.where("doomed").select("lang", "path_hash", "checksum").distinct()
    return kept.select(*KEY, "lang", "checksum"), store.join(gone, ["lang", "path_hash", "checksum"], "left_anti")


def clear_all(long: DataFrame, store: DataFrame, lang: str | None = None, path_hash: str | None = None, keyword: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and stored texts after a language, a file, or what contains a keyword (literally), is deleted."""
    scope = F.lit(True)
    if lang is not None:
        scope = scope & (F.col("lang") == lang)
    if path_hash is not None:
        scope = scope & (F.col("path_hash") == path_hash)
    if keyword is None:
        return long.where(~scope), store.where(~scope)
    doomed = store.where(scope & F.coalesce(F.contains("text", F.lit(keyword)), F.lit(False)))
    key = ["lang", "path_hash", "checksum"]
    gone = doomed.select(*key).distinct()
    return long.join(gone, key, "left_anti"), store.join(gone, key, "left_anti")


def change_counts(before: DataFrame, after: DataFrame, store_before: DataFrame, store_after: DataFrame) -> DataFrame:
    """removed_rows, cleared_fields (of rows that stay) and deleted_texts between two states; one row."""
    rows = before.select(*KEY).distinct().join(after.select(*KEY).distinct().withColumn("stays", F.lit(True)), KEY, "left")
    gone = before.join(after.select(*KEY, "lang").distinct(), [*KEY, "lang"], "left_anti").join(rows, KEY)
    key = ["lang", "path_hash", "checksum"]
    texts = store_before.select(*key).distinct().join(store_after.select(*key).distinct(), key, "left_anti")
    return (
        rows.agg(F.count_if(F.col("stays").isNull()).alias("removed_rows"))
        .join(gone.agg(F.count_if(F.col("stays").isNotNull()).alias("cleared_fields")))  # one row each
        .join(texts.agg(F.count(F.lit(1)).alias("deleted_texts")))
    )


# -- rebuilding -------------------------------------------------------------------------------------------------------


def rebuild_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of target chunks with the first source chunk of the same file and checksum.

    sources: path_hash, src_checksum, src_text, ord; targets: path_hash, src_checksum and anything else."""
    first = sources.groupBy("path_hash", "src_checksum").agg(F.min_by("src_text", "ord").alias("src_text"))
    return targets.join(first, ["path_hash", "src_checksum"])


def unmatched_targets(sources: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(sources.select("path_hash", "src_checksum").distinct(), ["path_hash", "src_checksum"], "left_anti")


def mark_session(requests: DataFrame) -> DataFrame:
    """Requests with `is_first`: whether a chunk is the first with its checksum in a file and target language.

    The first is found by an aggregate, which is combined before it is shuffled, so that a chunk that is repeated a
    million times makes no task large."""
    key = ["path_hash", "tgt_lang", "src_checksum"]
    first = requests.groupBy(*key).agg(F.min(F.struct("chunk_index", "chunk_id")).alias("_first"))
    marked = requests.join(first, key, "left")
    return marked.withColumn("is_first", F.coalesce(F.struct("chunk_index", "chunk_id") == F.col("_first"), F.lit(True))).drop("_first")
