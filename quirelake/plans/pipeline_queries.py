"""Queries of the parsers, of similarity search and of the translation run."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions.text import WHITE, checksum, is_blank, universal_newlines
from quirelake.operators import memory, similarity, translate
from quirelake.operators.references import tidy_key
from quirelake.parsers import tables as parsers
from quirelake.parsers.code import LANGUAGES
from quirelake.plans.memory_queries import _long, _pairs, _requests, _store
from quirelake.runtime import durable
from quirelake.tables import load


def _chunks(spark, sf_dir):
    return load(spark, sf_dir, "source_chunk")


def _segments(kind):
    def query(spark, sf_dir):
        return parsers.segments(_chunks(spark, sf_dir).where(F.col("chunk_type") == kind), "chunk_id", "chunk_type", "content")

    query.__name__ = f"segments_{kind}"
    return query


def _document_chunks(kind):
    def query(spark, sf_dir):
        documents = load(spark, sf_dir, "documents").where(F.col("doc_type") == kind)
        return parsers.chunks(documents.withColumn("text", universal_newlines(F.col("text"))), "doc_id", "doc_type", "text")

    query.__name__ = f"chunks_{kind}"
    return query


def typst_subchunks(spark, sf_dir):
    """Parts of the Typst chunks that are too long for one call."""
    long = _chunks(spark, sf_dir).where("chunk_type = 'typst' and length(content) > 2000")
    return parsers.subchunks(long, "chunk_id", "chunk_type", "content")


def ph_only_chunks(spark, sf_dir):
    """Chunks without translatable text."""
    found = parsers.segments(_chunks(spark, sf_dir), "chunk_id", "chunk_type", "content")
    texts = found.where("kind = 'text'").select(F.col("id").alias("chunk_id")).distinct()
    return _chunks(spark, sf_dir).select("chunk_id").join(texts, "chunk_id", "left_anti")


def lossless_segments(spark, sf_dir):
    """Checksums of the chunks put together again from their segments."""
    found = parsers.segments(_chunks(spark, sf_dir), "chunk_id", "chunk_type", "content")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "content"))), lambda x: x["content"])
    return found.groupBy(F.col("id").alias("chunk_id")).agg(F.sha2(F.array_join(parts, ""), 256).alias("checksum"))


def best_match(spark, sf_dir):
    """For every fiftieth chunk the most similar other chunk text of its file (queries against all rows of the file)."""
    chunks = _chunks(spark, sf_dir).select("chunk_id", F.coalesce(tidy_key("path_checksum"), F.lit("")).alias("grp"), F.col("content").alias("text"), "checksum")
    queries = chunks.where("chunk_id % 50 = 0").select("grp", F.col("chunk_id").alias("query_id"), "text", F.col("checksum").alias("own"))
    found = similarity.best_matches(queries, chunks)
    return found.select("query_id", "checksum", F.round("score", 6).alias("score"))


def _typed_requests(spark, sf_dir):
    contents = _chunks(spark, sf_dir).select("chunk_id", "content", "chunk_type")
    return _requests(spark, sf_dir).join(contents, "chunk_id")


def example_gate(spark, sf_dir):
    """For every fiftieth request the example that its prompt gets: the most similar stored text of its file, if it scores
    above the threshold and has a translation."""
    asked = _typed_requests(spark, sf_dir).where("chunk_id % 50 = 0")
    found = translate.find_examples(asked, memory.index(_pairs_as_memory(spark, sf_dir)), durable(_store(spark, sf_dir)))
    return found.select("path_hash", "src_lang", "tgt_lang", "src_checksum", F.sha2("old_src", 256).alias("old_src_checksum"), F.round("score", 6).alias("score"))


def _pairs_as_memory(spark, sf_dir):
    """The recovered pairs as rows of the memory: what a sync of the target documents gives."""
    pairs = _pairs(spark, sf_dir).where("src_text is not null")
    row = lambda side: pairs.select("path_hash", F.col("pair_id").alias("row_id"), F.col("recovered_at").alias("ord"), F.col(f"{side}_lang").alias("lang"), checksum(F.col(f"{side}_text")).alias("checksum"))
    return row("src").unionByName(row("tgt"))


def _run(spark, sf_dir):
    """Translation with the default model; every fiftieth request gets an example where there is one."""
    # what several steps read is worked out once
    requests, store, index = durable(_typed_requests(spark, sf_dir)), durable(_store(spark, sf_dir)), durable(memory.index(_long(spark, sf_dir)))
    examples = translate.find_examples(requests.where("chunk_id % 50 = 0"), memory.index(_pairs_as_memory(spark, sf_dir)), store)
    return translate.translate(requests, index, store, translate.Caller(translate.echo), examples)


def translation_run(spark, sf_dir):
    """Outcome of every live chunk and target language with the default model."""
    return _run(spark, sf_dir).where("not is_part").select("chunk_id", "tgt_lang", "outcome", F.sha2("text", 256).alias("text_checksum"))


def translation_run_stats(spark, sf_dir):
    return translate.stats(_run(spark, sf_dir), "tgt_lang")


def memory_growth(spark, sf_dir):
    """What the run would add to the memory, per language."""
    return translate.new_pairs(_run(spark, sf_dir)).groupBy("tgt_lang").agg(F.count(F.lit(1)).alias("n_pairs"))


def boundary_pieces(spark, sf_dir):
    """Oversized plain chunks cut at text boundaries."""
    long = _chunks(spark, sf_dir).where("chunk_type = 'other' and length(content) > 2000")
    return parsers.subchunks(long, "chunk_id", "chunk_type", "content")


def _glued(df, key, order):
    """Checksums of contents put together again from their parts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda x: x["content"])
    return df.groupBy(F.col("id").alias(key)).agg(F.sha2(F.array_join(parts, ""), 256).alias("checksum"))


def typst_subchunks_lossless(spark, sf_dir):
    return _glued(typst_subchunks(spark, sf_dir), "chunk_id", "part")


def boundary_pieces_lossless(spark, sf_dir):
    return _glued(boundary_pieces(spark, sf_dir), "chunk_id", "part")


def boundary_pieces_bounds(spark, sf_dir):
    """Chunks with a piece above the limit; there must be none."""
    return boundary_pieces(spark, sf_dir).where("length(content) > 2000").select(F.col("id").alias("chunk_id")).distinct()


_PLAIN = "doc_type in ('latex', 'markdown', 'typst') and text is not null and not contains(text, '\\\\begin{document}') and not contains(text, '\\\\end{document}') and not startswith(ltrim(text), '---')"


def chunks_lossless(spark, sf_dir):
    """The characters that are no white space of documents put together again from their chunks."""
    documents = load(spark, sf_dir, "documents").where(_PLAIN).withColumn("text", universal_newlines(F.col("text")))
    made = parsers.chunks(documents, "doc_id", "doc_type", "text")
    ink = made.select(F.col("id"), "chunk_index", F.regexp_replace("content", f"[{WHITE}]+", "").alias("content"))
    return _glued(ink, "doc_id", "chunk_index")


def chunks_bounds(spark, sf_dir):
    """Documents with a blank chunk; there must be none."""
    documents = load(spark, sf_dir, "documents").where("text is not null").withColumn("text", universal_newlines(F.col("text")))
    made = parsers.chunks(documents.where("doc_type in ('latex', 'typst')"), "doc_id", "doc_type", "text")
    return made.where(is_blank(F.col("content"))).select(F.col("id").alias("doc_id")).distinct()


def segments_lossless_by_language(spark, sf_dir):
    """Checksums of code chunks put together again from their segments in each language."""
    code = _chunks(spark, sf_dir).where("chunk_type = 'code'")
    out = None
    for language in LANGUAGES:
        found = parsers.segments(code.withColumn("kind", F.lit(f"code:{language}")), "chunk_id", "kind", "content")
        one = _glued(found, "chunk_id", "seg_index").withColumn("language", F.lit(language))
        out = one if out is None else out.unionByName(one)
    return out


_ALL = [*(_segments(k) for k in ("latex", "myst", "typst", "code")), *(_document_chunks(k) for k in ("latex", "markdown", "typst", "jupyter")), typst_subchunks,
        ph_only_chunks, lossless_segments, best_match, example_gate, translation_run, translation_run_stats, memory_growth, boundary_pieces,
        typst_subchunks_lossless, boundary_pieces_lossless, boundary_pieces_bounds, chunks_lossless, chunks_bounds, segments_lossless_by_language]
QUERIES = {f.__name__: f for f in _ALL}
_INK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
SQL = {
    "lossless_segments": "select chunk_id, sha256(content) as checksum from source_chunk",
    "typst_subchunks_lossless": "select chunk_id, sha256(content) as checksum from source_chunk where chunk_type = 'typst' and length(content) > 2000",
    "boundary_pieces_lossless": "select chunk_id, sha256(content) as checksum from source_chunk where chunk_type = 'other' and length(content) > 2000",
    "boundary_pieces_bounds": "select chunk_id from source_chunk where false",
    "chunks_lossless": f"""with inks as (select doc_id, regexp_replace(text, '{_INK}', '', 'g') as ink from documents where doc_type in ('latex', 'markdown', 'typst') and text is not null
        and not contains(text, '\\begin{{document}}') and not contains(text, '\\end{{document}}') and not starts_with(ltrim(text), '---'))
        select doc_id, sha256(ink) as checksum from inks where ink <> ''""",
    "chunks_bounds": "select doc_id from documents where false",
    "segments_lossless_by_language": "select chunk_id, sha256(content) as checksum, language from source_chunk cross join (values ('python'), ('java'), ('rust')) v(language) where chunk_type = 'code' and content <> ''",
}
