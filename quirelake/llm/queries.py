"""Queries p1, p2, p4 to p8 on the tables of a data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import abuse, alignment, bpe, defects, langid, packing, splitting
from quirelake.tables import load

RANKS = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = load(spark, sf_dir, "size_limit").where(F.col("limit_name") == name).first()
    return row["max_size"], row["overlap"]


def _prose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that are not code; pairs of unknown type count as prose."""
    return load(spark, sf_dir, "recovered_chunk_pair").where("not (chunk_type <=> 'code')")


def _language_model(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    names = ("documents", "recovered_chunk_pair", "lang_dir", "vocabulary")
    return langid.fit_tables(spark, *(load(spark, sf_dir, name) for name in names))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment(spark, sf_dir).select("pair_id", "src_no", "tgt_no")


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _prose_pairs(spark, sf_dir)
    return alignment.align(pairs, _language_model(spark, sf_dir), alignment.fit_tables(pairs).lexicon)


def p1_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many renderings were found on the paths, and how many outside them."""
    return _alignment(spark, sf_dir).groupBy("via").agg(F.count(F.lit(1)).alias("n"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    max_size, overlap = _limit(spark, sf_dir, "chunk_content")
    return splitting.split_oversized(load(spark, sf_dir, "source_chunk"), max_size, overlap)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_id", "cut_kind")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the contents put together again from their pieces, and whether a piece is above the limit."""
    max_size, overlap = _limit(spark, sf_dir, "chunk_content")
    own = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substr("piece", F.lit(overlap + 1)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("part")))), lambda x: x["part"])
    return p2_pieces(spark, sf_dir).groupBy("chunk_id").agg(F.sha2(F.array_join(parts, ""), 256).alias("checksum"), F.bool_or(F.length("piece") > max_size).alias("is_above"))


def _pair_judge(spark: SparkSession, sf_dir: str) -> tuple[langid.LanguageModel, defects.Fitted, dict[int, int]]:
    """Language model, defect classifier, and the language of each target directory."""
    pairs, model = _prose_pairs(spark, sf_dir), _language_model(spark, sf_dir)
    languages = defects.target_languages(pairs, model)
    return model, defects.fit_tables(pairs, model, alignment.fit_tables(pairs), languages), languages


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fitted, languages = _pair_judge(spark, sf_dir)
    return defects.find_defects(_prose_pairs(spark, sf_dir), fitted, languages)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs per directory, defect and error of the failed call for the same chunk (null if there is none), and
    failed calls without a defective pair (defect null), those of unknown files included. Where several calls failed for a
    chunk, the error that comes last in the alphabet stands for them."""
    paths = load(spark, sf_dir, "path_map").select(F.col("relative_path").alias("source_path"), "path_checksum").distinct()
    key = ["lang_dir_id", "path_checksum", "chunk_index"]
    error = F.lower(F.regexp_extract(F.trim("error_type"), r"([^.]*)$", 1))
    failures = load(spark, sf_dir, "chunk_failure").join(paths, "source_path", "left").withColumn("error", F.when(error != "", error))
    per_chunk = failures.where("path_checksum is not null").groupBy(*key).agg(F.max("error").alias("error_type"))
    pairs = load(spark, sf_dir, "recovered_chunk_pair").select("pair_id", "lang_dir_id", F.lower(F.trim("path_checksum")).alias("path_checksum"), "chunk_index")
    defective = p4_found(spark, sf_dir).join(pairs, "pair_id")
    of_pairs = defective.join(per_chunk, key, "left").groupBy("lang_dir_id", "defect", "error_type").agg(F.count(F.lit(1)).alias("n_pairs")).withColumn("n_failures", F.lit(0).cast("bigint"))
    alone = failures.join(defective.select(*key).distinct(), key, "left_anti").groupBy("lang_dir_id", F.col("error").alias("error_type")).agg(F.count(F.lit(1)).alias("n_failures"))
    return of_pairs.unionByName(alone.select("lang_dir_id", F.lit(None).cast("string").alias("defect"), "error_type", F.lit(0).cast("bigint").alias("n_pairs"), "n_failures"))


def _language_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, int]]:
    """Wrong labels (seg_no 0) and paragraphs in another language of documents, sentences in another language of targets,
    with confidences; and the language of each target directory."""
    model, fitted, languages = _pair_judge(spark, sf_dir)
    documents = langid.detect(load(spark, sf_dir, "documents"), "doc_id", "text", model, "paragraph", "lang")
    of_documents = documents.where("seg_no > 0 or not label_fits").select(
        F.lit("documents").alias("table_name"), F.col("id").alias("record_id"), "seg_no", "lang", "confidence"
    )
    judged = defects.judge_pairs(_prose_pairs(spark, sf_dir), fitted, languages, with_sentences=True)
    of_pairs = judged.where("defect is null").select(
        F.lit("recovered_chunk_pair").alias("table_name"), F.col("pair_id").alias("record_id"), "seg_no", "lang", "confidence"
    )
    return of_documents.unionByName(of_pairs), languages


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences in another language, with a confidence each."""
    found, _ = _language_cases(spark, sf_dir)
    return found.where("seg_no > 0").withColumn("confidence", F.round("confidence", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong labels of documents and target directories, paragraphs of documents and sentences of targets in another
    language."""
    found, languages = _language_cases(spark, sf_dir)
    labels = load(spark, sf_dir, "lang_dir").where("role = 'target'").select("lang_dir_id", "language").collect()
    wrong = [
        ("lang_dir", row["lang_dir_id"], 0, langid.LANGUAGES[number])
        for row in labels
        if (number := languages.get(row["lang_dir_id"])) is not None
        and langid.canonical(row["language"]) != langid.LANGUAGES[number]
    ]
    of_dirs = spark.createDataFrame(wrong, "table_name string, record_id bigint, seg_no int, lang string")
    return found.drop("confidence").unionByName(of_dirs)


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document with a confidence."""
    found = langid.detect(load(spark, sf_dir, "documents"), "doc_id", "text", _language_model(spark, sf_dir), "paragraph", "lang")
    return found.where("seg_no = 0").select(F.col("id").alias("doc_id"), "lang", F.round("confidence", 6).alias("confidence"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(load(spark, sf_dir, "documents"), "doc_id", "text", RANKS)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "document_container")
    sizes = bpe.count_column(load(spark, sf_dir, "documents"), "doc_id", "text", RANKS)
    return packing.pack(sizes, "doc_id", "n_tokens", capacity)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "document_container")
    return packing.fill_report(p7_containers(spark, sf_dir), capacity)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return abuse.score(documents, abuse.fit_tables(documents, load(spark, sf_dir, "review_label")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("is_abusive").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and share of abusive documents per source."""
    abusive = F.count_if("is_abusive")
    return p8_scores(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), abusive.alias("n_abusive"), F.round(abusive / F.count(F.lit(1)), 6).alias("rate")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_ways": p1_ways,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_restored": p2_restored,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_languages": p5_languages,
    "p5_segments": p5_segments,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}
SQL = {
    "p2_restored": "select chunk_id, sha256(content) as checksum, false as is_above from source_chunk where length(content) > (select max_size from size_limit where limit_name = 'chunk_content')",
    "p2_found": r"""
        select chunk_id, case when regexp_matches(content, '[^ \t\r\n]{1000}[^ \t\r\n]{1000}[^ \t\r\n]') then 'forced' else 'natural' end as cut_kind
        from source_chunk where length(content) > (select max_size from size_limit where limit_name = 'chunk_content')""",
}
