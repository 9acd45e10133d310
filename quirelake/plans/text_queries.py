"""Queries of the scalar, tagging and ordered operators on documents, chunks and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import languages, tagging, text
from quirelake.operators import annotated, ordered
from quirelake.operators.references import tidy_key
from quirelake.tables import load


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line breaks as a scan reads them."""
    return load(spark, sf_dir, "documents").select("doc_id", text.universal_newlines(F.col("text")).alias("text"), "rel_path", "lang").where("text is not null")


def chunk_checksums(spark, sf_dir):
    own = text.checksum(F.col("content"))
    return load(spark, sf_dir, "source_chunk").select("chunk_id", own.alias("content_checksum"), (own == tidy_key("checksum")).alias("is_recorded"))


def path_checksums(spark, sf_dir):
    own = text.path_checksum(F.col("relative_path"))
    return load(spark, sf_dir, "path_map").select("relative_path", own.alias("path_hash"), (own == F.col("path_checksum")).alias("is_recorded")).distinct()


def doc_type_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(text.document_type(F.coalesce("rel_path", F.lit(""))).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


def _line_chunks(spark, sf_dir, n):
    chunks = _documents(spark, sf_dir).select("doc_id", F.posexplode(text.line_chunks(F.col("text"), n)).alias("pos", "chunk"))
    return chunks.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("chunk_index"), F.sha2("chunk", 256).alias("checksum"))


def line_chunks_50(spark, sf_dir):
    return _line_chunks(spark, sf_dir, 50)


def line_chunks_3(spark, sf_dir):
    return _line_chunks(spark, sf_dir, 3)


def blank_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(text.is_blank(F.col("text"))).select("doc_id")


def oversized_chunks(spark, sf_dir):
    return load(spark, sf_dir, "source_chunk").where("chunk_type = 'typst' and length(content) > 2000").select("chunk_id")


def content_types(spark, sf_dir):
    kind = F.when(F.col("chunk_type") == "latex", "LaTeX").when(F.col("chunk_type") == "typst", "Typst").when(F.col("chunk_type") == "myst", "MyST").when(F.col("chunk_type") == "code", "code").otherwise("any document")
    return load(spark, sf_dir, "source_chunk").groupBy(kind.alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


def extract_output_tags(spark, sf_dir):
    return load(spark, sf_dir, "recovered_chunk_pair").where("tgt_text is not null").select("pair_id", text.translated_part(F.col("tgt_text")).alias("result"))


def extract_between_tags(spark, sf_dir):
    return load(spark, sf_dir, "recovered_chunk_pair").where("tgt_text is not null").select("pair_id", text.between(F.col("tgt_text"), "<TEXT>", "</TEXT>").alias("result"))


_CUSTOM, _SHORTS = {"Italian": "_it"}, {"fr": "French", "en": "English", "de": "German", "es": "Spanish", "it": "Italian", "ua": "Ukrainian"}


def resolve_languages(spark, sf_dir):
    name = languages.resolve(F.trim("language"), _CUSTOM, _SHORTS)
    return load(spark, sf_dir, "lang_dir").select("lang_dir_id", name.alias("name"), F.concat("project", languages.directory_suffix(name, _CUSTOM)).alias("directory"))


def vocab_pairs(spark, sf_dir):
    terms = load(spark, sf_dir, "vocabulary")
    return terms.where("trim(english) <> '' and trim(french) <> ''").select("term_no", F.trim("english").alias("src"), F.trim("french").alias("tgt"))


def vocab_compile(spark, sf_dir):
    """All terms as lines `source=target`, in order (a fixed, small table)."""
    line = F.concat("src", F.lit("="), "tgt", F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("term_no", line.alias("line")))), lambda x: x["line"])
    return vocab_pairs(spark, sf_dir).agg(F.array_join(lines, "").alias("vocabulary"))


_PROMPT = "Translate [CONTENT_TYPE] from [SOURCE_LANGUAGE] into [TARGET_LANGUAGE].\nTerms:\n[CUSTOM_VOCABULARY]\nText:\n[SRC]"


def _prompts(spark, sf_dir, source):
    chunks = load(spark, sf_dir, "source_chunk").crossJoin(F.broadcast(vocab_compile(spark, sf_dir)))  # one row
    return chunks.select(
        "chunk_id",
        F.sha2(
            text.fill_template(
                F.lit(_PROMPT),
                {"[TARGET_LANGUAGE]": F.lit("French"), "[SOURCE_LANGUAGE]": F.lit("English"), "[CONTENT_TYPE]": F.col("chunk_type"), "[CUSTOM_VOCABULARY]": F.col("vocabulary"), "[SRC]": source},
            ),
            256,
        ).alias("prompt_checksum"),
    )


def prompts_plain(spark, sf_dir):
    return _prompts(spark, sf_dir, F.concat(F.lit("<document>"), F.col("content"), F.lit("</document>")))


def prompts_xml(spark, sf_dir):
    return _prompts(spark, sf_dir, tagging.build_xml(_numbered(F.col("content"))))


def _error_class(error_type):
    name = F.lower(F.regexp_extract(F.trim(error_type), r"([^.]*)$", 1))
    return (
        F.when(name.isin("ratelimited", "serviceunavailable", "readtimeout", "retriesexhausted"), "transient")
        .when(name.isin("authenticationfailed", "modelnotfound"), "fatal")
        .when(error_type.isNull() | (name == ""), "unknown")
        .otherwise("chunk")
    )


def failure_classes(spark, sf_dir):
    """Calls that may succeed when repeated, calls that doom the run, and chunks that fail by themselves."""
    return load(spark, sf_dir, "chunk_failure").groupBy(_error_class(F.col("error_type")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def failure_report(spark, sf_dir):
    report = text.failure_lines(F.col("chunk_index"), F.col("error_type"), F.col("error_message"), F.col("source_path"), F.col("source_line"), F.col("target_path"), F.col("target_line"))
    return load(spark, sf_dir, "chunk_failure").select("failure_id", report.alias("report"))


# -- segments and tagged XML ------------------------------------------------------------------------------------------

_SEGMENT = r"\$[^$]*\$|`[^`]*`|\n|[^$`\n]+|[$`]"


def _segments(content):
    pieces = F.regexp_extract_all(content, F.lit(_SEGMENT), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.when(p.rlike(r"^[$`\n]"), "placeholder").otherwise("text").alias("kind"), p.alias("content")))


def _numbered(content):
    return tagging.number_placeholders(tagging.coalesce_segments(_segments(content)))


def coalesce_placeholders(spark, sf_dir):
    rows = load(spark, sf_dir, "source_chunk").select("chunk_id", F.posexplode(tagging.coalesce_segments(_segments(F.col("content")))).alias("pos", "s"))
    return rows.select("chunk_id", (F.col("pos") + 1).cast("bigint").alias("seg_index"), "s.kind", "s.content")


def placeholder_ids(spark, sf_dir):
    rows = load(spark, sf_dir, "source_chunk").select("chunk_id", F.posexplode(_numbered(F.col("content"))).alias("pos", "s"))
    return rows.where("s.id is not null").select("chunk_id", F.col("s.id").cast("bigint").alias("ph_id"), "s.content")


def build_xml(spark, sf_dir):
    return load(spark, sf_dir, "source_chunk").select("chunk_id", tagging.build_xml(_numbered(F.col("content"))).alias("xml"))


def verify_placeholders(spark, sf_dir):
    """Ids that the wrapped replies lack or have too many, against the placeholders of their sources."""
    pairs = load(spark, sf_dir, "recovered_chunk_pair").where("contains(tgt_text, '<TEXT>') or contains(tgt_text, '<PH')")
    missing, extra = tagging.missing_and_extra(F.col("tgt_text"), tagging.placeholder_map(_numbered(F.col("src_text"))))
    return pairs.select("pair_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


def restore_placeholders(spark, sf_dir):
    """Chunks that do not come back unchanged from tagged XML; there must be none."""
    numbered = _numbered(F.col("content"))
    back = tagging.restore(tagging.build_xml(numbered), tagging.placeholder_map(numbered))
    return load(spark, sf_dir, "source_chunk").select("chunk_id", F.sha2(back, 256).alias("restored_checksum"))


# -- sections, packing, lines -----------------------------------------------------------------------------------------


def _units(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(text.lines_with_ends(F.col("text"))).alias("pos", "line"))
    kind = F.when(F.col("line").rlike(r"^#{1,6} "), "heading").when(F.col("line").rlike(r"^\([^)\n]+\)=\n?$"), "target").otherwise("other")
    return lines.select("doc_id", "pos", kind.alias("kind"), F.length("line").alias("n"))


def section_groups(spark, sf_dir):
    own = ordered.section_numbers(_units(spark, sf_dir), "doc_id", "pos")
    return own.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").cast("bigint").alias("first_line"))


def section_expand(spark, sf_dir):
    return ordered.expanded_sections(ordered.section_numbers(_units(spark, sf_dir), "doc_id", "pos"), "doc_id", "pos", "n", 2000)


def _binned(spark, sf_dir, bins):
    lines = text.lines_with_ends(F.col("text"))
    lengths = F.transform(lines, lambda line: F.length(line))
    alone = F.transform(lines, lambda line: line.rlike(r"^#{1,6} "))
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(bins(lengths, alone)).alias("pos", "bin"))
    return rows.groupBy("doc_id", F.col("bin").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("pos").cast("bigint").alias("first_line"))


def greedy_pack_2000(spark, sf_dir):
    return _binned(spark, sf_dir, lambda lengths, _: ordered.greedy_bins(lengths, 2000))


def inline_flush_600(spark, sf_dir):
    return _binned(spark, sf_dir, lambda lengths, alone: ordered.flush_bins(lengths, alone, 600))


def locate_start_lines(spark, sf_dir):
    """Where the chunks of three lines begin in their documents."""
    chunks = text.line_chunks(F.col("text"), 3)
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(ordered.located_lines(F.col("text"), chunks)).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("chunk_index"), F.col("line").cast("bigint").alias("start_line"))


# -- annotated target documents ---------------------------------------------------------------------------------------


_FILE = ["lang_dir_id", "path_hash", "kind"]


def _annotated(spark, sf_dir):
    pairs = load(spark, sf_dir, "recovered_chunk_pair").where("chunk_type in ('latex', 'myst', 'typst') and tgt_text is not null")
    entries = F.array(
        F.struct(F.lit("src_checksum").alias("key"), F.coalesce(tidy_key("src_checksum"), F.lit("")).alias("value")),
        F.struct(F.lit("needs_review").alias("key"), F.lit("True").alias("value")),
    )
    chunks = pairs.select(
        "lang_dir_id", tidy_key("path_checksum").alias("path_hash"), F.col("chunk_type").alias("kind"), "chunk_index", F.col("pair_id").alias("nr"),
        entries.alias("entries"), text.universal_newlines(F.col("tgt_text")).alias("source"),
    )
    return annotated.blocks(chunks, _FILE)


def annotate_documents(spark, sf_dir):
    """Compiled target documents of all formats, in parts of 200 chunk numbers, so that no file has to fit into one row."""
    return annotated.parts(_annotated(spark, sf_dir), _FILE).select(*_FILE, "part", F.sha2("text", 256).alias("checksum"))


def annotate_sizes(spark, sf_dir):
    """Chunks, characters and lines of each whole compiled document."""
    breaks = F.length("block") - F.length(F.replace("block", F.lit("\n"), F.lit("")))
    return _annotated(spark, sf_dir).groupBy(*_FILE).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("block")).cast("bigint").alias("n_chars"), F.sum(breaks).cast("bigint").alias("n_breaks"))


def target_start_lines(spark, sf_dir):
    """Line at which each chunk's metadata block begins in its compiled target document."""
    return annotated.start_lines(_annotated(spark, sf_dir), _FILE).select(F.col("nr").alias("pair_id"), "start_line")


def parse_annotated_documents(spark, sf_dir):
    """Chunks with their metadata, read back from compiled documents of many blocks; contents are stripped, blank ones
    dropped."""
    documents = annotated.parts(_annotated(spark, sf_dir), _FILE)
    rows = annotated.read(documents, "text", "kind", *_FILE, "part")
    return rows.select(*_FILE, "part", F.col("nth").cast("bigint").alias("nth"), F.col("metadata")["src_checksum"].alias("src_checksum"), F.col("metadata")["needs_review"].alias("needs_review"), F.sha2("body", 256).alias("tgt_checksum"))


def failure_lines(spark, sf_dir):
    """Failed calls with the line at which their chunk begins in its source file, null beyond the file's chunks."""
    paths = load(spark, sf_dir, "path_map").select(F.col("path_checksum").alias("path_hash"), F.col("relative_path").alias("source_path")).distinct()
    starts = load(spark, sf_dir, "source_chunk").groupBy(tidy_key("path_checksum").alias("path_hash"), "chunk_index").agg(F.min("lines.start_line").alias("start_line"))
    own = starts.join(paths, "path_hash").groupBy("source_path", "chunk_index").agg(F.min("start_line").alias("start_line"))
    return load(spark, sf_dir, "chunk_failure").join(own, ["source_path", "chunk_index"], "left").select("failure_id", "start_line")


def fatal_messages(spark, sf_dir):
    message = text.fatal_message(F.trim("error_type"), F.lit("echo"), F.lit("small"))
    return load(spark, sf_dir, "chunk_failure").where("error_type is not null").select("failure_id", message.alias("message"))


# -- files ------------------------------------------------------------------------------------------------------------


def sync_plan(spark, sf_dir):
    """Files that are copied to every target directory of their project: those without translatable chunks."""
    files = load(spark, sf_dir, "path_map").select("relative_path", "path_checksum").distinct()
    chunked = load(spark, sf_dir, "source_chunk").select(tidy_key("path_checksum").alias("path_checksum")).distinct()
    targets = load(spark, sf_dir, "lang_dir").where("role = 'target'").select("project", "path")
    plain = files.join(chunked, "path_checksum", "left_anti").withColumn("project", F.split("relative_path", "/")[0])
    return plain.join(targets, "project").select(
        "relative_path", F.concat("path", F.substr("relative_path", F.length("project") + F.lit(1))).alias("target")
    )


def target_extra_files(spark, sf_dir):
    """Target paths of failures whose source file is not known."""
    failures = load(spark, sf_dir, "chunk_failure").where("target_path is not null").select("target_path", "source_path").distinct()
    known = load(spark, sf_dir, "path_map").select(F.col("relative_path").alias("source_path")).distinct()
    return failures.join(known, "source_path", "left_anti").select("target_path").distinct()


def expand_paths(spark, sf_dir):
    """Documents under the directories of the registered files' projects."""
    directories = load(spark, sf_dir, "path_map").select(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1).alias("directory")).distinct()
    documents = load(spark, sf_dir, "documents").where("rel_path is not null").select("doc_id", "rel_path")
    # every directory above a document, so that the prefix join is an equi-join
    parts = F.split("rel_path", "/")
    above = documents.withColumn("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    return above.join(directories, "directory").select("directory", "doc_id")


def nearest_ancestor(spark, sf_dir):
    """The nearest directory above each document that holds a registered file."""
    return expand_paths(spark, sf_dir).groupBy("doc_id").agg(F.max_by("directory", F.length("directory")).alias("directory"))


def same_named_file(spark, sf_dir):
    """The first registered file with the file name of a failure's target."""
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    files = load(spark, sf_dir, "path_map").groupBy(name("relative_path").alias("name")).agg(F.min("relative_path").alias("file"))
    targets = load(spark, sf_dir, "chunk_failure").where("target_path is not null").select("target_path", name("target_path").alias("name")).distinct()
    return targets.join(files, "name").select("target_path", "file")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_checksums, path_checksums, doc_type_counts, line_chunks_50, line_chunks_3, blank_documents, oversized_chunks, content_types, extract_output_tags,
        extract_between_tags, resolve_languages, vocab_pairs, vocab_compile, prompts_plain, prompts_xml, failure_classes, failure_report, coalesce_placeholders,
        placeholder_ids, build_xml, verify_placeholders, restore_placeholders, section_groups, section_expand, greedy_pack_2000, inline_flush_600,
        locate_start_lines, annotate_documents, target_start_lines, parse_annotated_documents, annotate_sizes, failure_lines, fatal_messages, sync_plan, target_extra_files, expand_paths, nearest_ancestor,
        same_named_file,
    )
}

_DOCS = r"docs as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as text from documents where text is not null)"
_BREAKS = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
_LINES = rf"lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select doc_id, regexp_extract_all(text, '[^{_BREAKS}]*[{_BREAKS}]|[^{_BREAKS}]+') as ls from docs))"
_UNITS = rf"units as (select doc_id, pos, length(line) as n, case when regexp_matches(line, '^#{{1,6}} ') then 'heading' when regexp_full_match(line, '\([^)\n]+\)=\n?') then 'target' else 'other' end as kind from lines)"
_SECTIONS = f"""with {_DOCS}, {_LINES}, {_UNITS}, looked as (
  select *, first_value(case when kind <> 'target' then kind end ignore nulls) over (partition by doc_id order by pos rows between current row and unbounded following) as nxt,
    lag(kind) over (partition by doc_id order by pos) as prv from units
), sections as (
  select *, 1 + sum(case when pos > 0 and kind in ('heading', 'target') and nxt = 'heading' and prv is distinct from 'target' then 1 else 0 end)
    over (partition by doc_id order by pos rows unbounded preceding)::bigint as section from looked
)"""
_CHUNK_SQL = "with {docs}, {lines} select doc_id, pos // {n} + 1 as chunk_index, sha256(string_agg(line, '' order by pos)) as checksum from lines group by doc_id, pos // {n}"
_SEGS = rf"""segs as (
  select {{id}} as id, unnest(ps) as content, unnest(range(len(ps))) as pos from (select {{id}}, regexp_extract_all({{text}}, '\$[^$]*\$|`[^`]*`|\n|[^$`\n]+|[$`]') as ps from {{table}})
), kinds as (select *, case when regexp_matches(content, '^[$`\n]') then 'placeholder' else 'text' end as kind from segs
), islands as (
  select *, sum(case when kind = 'placeholder' and prev_kind = 'placeholder' and content <> chr(10) and prev <> chr(10) then 0 else 1 end)
    over (partition by id order by pos rows unbounded preceding) as island
  from (select *, lag(kind) over (partition by id order by pos) as prev_kind, lag(content) over (partition by id order by pos) as prev from kinds)
), merged as (select id, island, any_value(kind) as kind, string_agg(content, '' order by pos) as content from islands group by id, island
), numbered as (select *, case when kind = 'placeholder' then sum(case when kind = 'placeholder' then 1 else 0 end) over (partition by id order by island rows unbounded preceding) end as ph from merged
), escaped as (select *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as esc from numbered
)"""
_CHUNK_SEGS = "with " + _SEGS.format(id="chunk_id", text="content", table="source_chunk")
_XML = "'<document><TEXT>' || string_agg(case when kind = 'text' then esc else '<PH id=\"' || ph::bigint || '\">' || esc || '</PH>' end, '' order by island) || '</TEXT></document>'"
_VOCAB = "(select string_agg(trim(english) || '=' || trim(french) || chr(10), '' order by term_no) from vocabulary where trim(english) <> '' and trim(french) <> '')"


def _sql_prompt(source: str) -> str:
    out = "'" + _PROMPT.replace("\n", "' || chr(10) || '") + "'"
    for token, value in (("[TARGET_LANGUAGE]", "'French'"), ("[SOURCE_LANGUAGE]", "'English'"), ("[CONTENT_TYPE]", "chunk_type"), ("[CUSTOM_VOCABULARY]", _VOCAB), ("[SRC]", source)):
        out = f"replace({out}, '{token}', {value})"
    return f"sha256({out})"


_KEYED = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_ANNOTATED = rf"""bodies as (
  select pair_id, lang_dir_id, {_KEYED.format('path_checksum')} as path_hash, chunk_type as kind, chunk_index, coalesce({_KEYED.format('src_checksum')}, '') as src_checksum,
    regexp_replace(tgt_text, '\r\n?', chr(10), 'g') as body
  from recovered_chunk_pair where chunk_type in ('latex', 'myst', 'typst') and tgt_text is not null
), marked as (select *, case kind when 'typst' then '// ' else '% ' end as lead, pair_id = last_value(pair_id) over (partition by lang_dir_id, path_hash, kind order by chunk_index, pair_id rows between unbounded preceding and unbounded following) as is_last from bodies
), annotated as (
  select *, case kind when 'myst' then chr(10) || '<!--' || chr(10) else '' end || lead || 'CHUNK_METADATA_START' || chr(10) || lead || 'src_checksum: ' || src_checksum || chr(10) || lead || 'needs_review: True' || chr(10)
      || lead || 'CHUNK_METADATA_END' || chr(10) || case kind when 'myst' then '-->' || chr(10) else '' end || body
      || case when kind = 'typst' and not is_last and not ends_with(body, chr(10)) then chr(10) else '' end as block from marked)"""
_CLASS = "lower(regexp_extract(trim(error_type), '([^.]*)$', 1))"
_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_RESOLVE = "case when lower(trim(language)) in ('french','english','german','spanish','ukrainian','armenian') then upper(left(lower(trim(language)), 1)) || substr(lower(trim(language)), 2) when trim(language) = 'Italian' then 'Italian' " + " ".join(f"when lower(trim(language)) = '{k}' then '{v}'" for k, v in _SHORTS.items()) + " end"
_PACK = """with recursive {docs}, {lines}, {units}, packed as (
  select doc_id, pos, n, {first_used} as used, 0 as bin, {first_next} as next_bin from units where pos = 0
  union all
  select u.doc_id, u.pos, u.n, {used}, {bin}, {next_bin} from packed p join units u on u.doc_id = p.doc_id and u.pos = p.pos + 1
) select doc_id, bin::bigint as bin, count(*) as n_lines, min(pos)::bigint as first_line from packed group by doc_id, bin"""
SQL = {
    "chunk_checksums": f"select chunk_id, sha256(content) as content_checksum, sha256(content) = {_KEYED.format('checksum')} as is_recorded from source_chunk",
    "path_checksums": "select distinct relative_path, sha256(relative_path) as path_hash, sha256(relative_path) = path_checksum as is_recorded from path_map",
    "doc_type_counts": r"select case regexp_extract(coalesce(rel_path, ''), '\.([^./]+)$', 1) when 'tex' then 'latex' when 'ipynb' then 'jupyter' when 'md' then 'markdown' when 'typ' then 'typst' else 'other' end as doc_type, count(*) as n from documents group by 1",
    "line_chunks_50": _CHUNK_SQL.format(docs=_DOCS, lines=_LINES, n=50),
    "line_chunks_3": _CHUNK_SQL.format(docs=_DOCS, lines=_LINES, n=3),
    "blank_documents": f"select doc_id from documents where regexp_full_match(text, '{_WS}*')",
    "oversized_chunks": "select chunk_id from source_chunk where chunk_type = 'typst' and length(content) > 2000",
    "content_types": "select case chunk_type when 'latex' then 'LaTeX' when 'typst' then 'Typst' when 'myst' then 'MyST' when 'code' then 'code' else 'any document' end as content_type, count(*) as n from source_chunk group by 1",
    "extract_output_tags": r"""select pair_id, case when contains(tgt_text, '<output>') then array_to_string(list_transform(regexp_extract_all(tgt_text, '(?s)<output>(.*?)(?:</output>|\z)', 1), lambda b: regexp_replace(b, '^\n', '')), '')
        else array_to_string(regexp_extract_all(tgt_text, '(?s)<document>.*?(?:</document>|\z)'), '') end as result from recovered_chunk_pair where tgt_text is not null""",
    "extract_between_tags": f"""select pair_id, case when not contains(tgt_text, '<TEXT>') then '' when not contains(substr(tgt_text, instr(tgt_text, '<TEXT>') + 6), '</TEXT>') then substr(tgt_text, instr(tgt_text, '<TEXT>') + 6)
        else regexp_replace(split_part(substr(tgt_text, instr(tgt_text, '<TEXT>') + 6), '</TEXT>', 1), '^{_WS}+|{_WS}+$', '', 'g') end as result from recovered_chunk_pair where tgt_text is not null""",
    "resolve_languages": f"select lang_dir_id, name, project || case name when 'French' then '_fr' when 'English' then '_en' when 'German' then '_de' when 'Spanish' then '_es' when 'Ukrainian' then '_ua' when 'Armenian' then '_hy' when 'Italian' then '_it' end as directory from (select *, {_RESOLVE} as name from lang_dir)",
    "vocab_pairs": "select term_no, trim(english) as src, trim(french) as tgt from vocabulary where trim(english) <> '' and trim(french) <> ''",
    "vocab_compile": f"select {_VOCAB} as vocabulary",
    "prompts_plain": f"select chunk_id, {_sql_prompt(chr(39) + '<document>' + chr(39) + ' || content || ' + chr(39) + '</document>' + chr(39))} as prompt_checksum from source_chunk",
    "prompts_xml": f"{_CHUNK_SEGS}, xmls as (select id, {_XML} as xml from escaped group by id) select c.chunk_id, {_sql_prompt('x.xml')} as prompt_checksum from source_chunk c join xmls x on x.id = c.chunk_id",
    "failure_classes": """select case when name in ('ratelimited', 'serviceunavailable', 'readtimeout', 'retriesexhausted') then 'transient' when name in ('authenticationfailed', 'modelnotfound') then 'fatal'
        when name is null or name = '' then 'unknown' else 'chunk' end as error_class, count(*) as n from (select lower(regexp_extract(trim(error_type), '([^.]*)$', 1)) as name from chunk_failure) group by 1""",
    "failure_report": """select failure_id, 'Translation failure on chunk #' || chunk_index || ' (' || coalesce(error_type, 'unknown') || ')' || case when coalesce(error_message, '') = '' then '' else ': ' || substr(error_message, 1, 200) end
        || coalesce(chr(10) || '  source: ' || source_path || coalesce(':' || source_line, ''), '') || coalesce(chr(10) || '  target: ' || target_path || coalesce(':' || target_line, ''), '') as report from chunk_failure""",
    "coalesce_placeholders": f"{_CHUNK_SEGS} select id as chunk_id, row_number() over (partition by id order by island) as seg_index, kind, content from merged",
    "placeholder_ids": f"{_CHUNK_SEGS} select id as chunk_id, ph::bigint as ph_id, content from numbered where ph is not null",
    "build_xml": f"{_CHUNK_SEGS} select id as chunk_id, {_XML} as xml from escaped group by id",
    "verify_placeholders": "with " + _SEGS.format(id="pair_id", text="src_text", table="recovered_chunk_pair") + r""", wanted as (select * from recovered_chunk_pair where contains(tgt_text, '<TEXT>') or contains(tgt_text, '<PH')
        ), expected as (select id, ph::bigint as ph, content from numbered where ph is not null
        ), found as (select distinct pair_id as id, unnest(regexp_extract_all(tgt_text, '<PH[^>]*?id="([0-9]+)"', 1))::bigint as ph from wanted)
        select w.pair_id, coalesce((select string_agg(ph, ',' order by ph) from expected e where e.id = w.pair_id and not regexp_full_match(content, '\s*') and ph not in (select ph from found f where f.id = w.pair_id)), '') as missing,
          coalesce((select string_agg(ph, ',' order by ph) from found f where f.id = w.pair_id and ph not in (select ph from expected e where e.id = w.pair_id)), '') as extra from wanted w""",
    "restore_placeholders": "select chunk_id, sha256(content) as restored_checksum from source_chunk",
    "section_groups": f"{_SECTIONS} select doc_id, section, count(*) as n_lines, min(pos)::bigint as first_line from sections group by doc_id, section",
    "section_expand": f"""{_SECTIONS}, sized as (select *, sum(n) over (partition by doc_id, section) as size, row_number() over (partition by doc_id, section order by pos) as nth from sections)
        select doc_id, section, case when size > 2000 then nth else 0 end as element, sum(n)::bigint as n_chars from sized group by 1, 2, 3""",
    "greedy_pack_2000": _PACK.format(docs=_DOCS, lines=_LINES, units=_UNITS, first_used="n", first_next="0", used="case when p.used + u.n > 2000 then u.n else p.used + u.n end", bin="case when p.used + u.n > 2000 then p.bin + 1 else p.bin end", next_bin="0"),
    "inline_flush_600": _PACK.format(
        docs=_DOCS, lines=_LINES, units=_UNITS,
        first_used="case when kind = 'heading' or n >= 600 then 0 else n end", first_next="case when kind = 'heading' or n >= 600 then 1 else 0 end",
        used="case when u.kind = 'heading' or p.used + u.n >= 600 then 0 else p.used + u.n end",
        bin="case when u.kind = 'heading' and p.used > 0 then p.next_bin + 1 else p.next_bin end",
        next_bin="case when u.kind = 'heading' and p.used > 0 then p.next_bin + 2 when u.kind = 'heading' or p.used + u.n >= 600 then p.next_bin + 1 else p.next_bin end",
    ),
    "locate_start_lines": f"with {_DOCS}, {_LINES}, before as (select doc_id, pos, coalesce(sum(length(line) - length(replace(line, chr(10), ''))) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as breaks from lines) select doc_id, pos // 3 + 1 as chunk_index, (breaks + 1)::bigint as start_line from before where pos % 3 = 0",
    "annotate_documents": f"with {_ANNOTATED} select lang_dir_id, path_hash, kind, (chunk_index // 200)::bigint as part, sha256(string_agg(block, '' order by chunk_index, pair_id)) as checksum from annotated group by 1, 2, 3, 4",
    "annotate_sizes": f"with {_ANNOTATED} select lang_dir_id, path_hash, kind, count(*) as n_chunks, sum(length(block))::bigint as n_chars, sum(length(block) - length(replace(block, chr(10), '')))::bigint as n_breaks from annotated group by 1, 2, 3",
    "target_start_lines": f"with {_ANNOTATED} select pair_id, (1 + coalesce(sum(length(block) - length(replace(block, chr(10), ''))) over (partition by lang_dir_id, path_hash, kind order by chunk_index, pair_id rows between unbounded preceding and 1 preceding), 0))::bigint as start_line from annotated",
    "parse_annotated_documents": f"with {_ANNOTATED}, stripped as (select *, regexp_replace(body, '^{_WS}+|{_WS}+$', '', 'g') as s from annotated) select lang_dir_id, path_hash, kind, (chunk_index // 200)::bigint as part, row_number() over (partition by lang_dir_id, path_hash, kind, chunk_index // 200 order by chunk_index, pair_id) as nth, src_checksum, 'True' as needs_review, sha256(s) as tgt_checksum from stripped where s <> ''",
    "failure_lines": f"""with starts as (select p.relative_path as source_path, c.chunk_index, min(c.lines.start_line) as start_line
        from source_chunk c join (select distinct path_checksum, relative_path from path_map) p on p.path_checksum = {_KEYED.format('c.path_checksum')} group by 1, 2)
        select failure_id, start_line from chunk_failure f left join starts s on s.source_path = f.source_path and s.chunk_index = f.chunk_index""",
    "fatal_messages": f"""select failure_id, case when {_CLASS} = 'authenticationfailed' then 'The key for echo was not accepted.' when {_CLASS} = 'modelnotfound' then 'echo has no model small.'
        when {_CLASS} in ('ratelimited', 'serviceunavailable', 'readtimeout', 'retriesexhausted') then 'echo did not answer, however often it was asked.'
        else 'A call of small failed: ' || trim(error_type) || '.' end as message from chunk_failure where error_type is not null""",
    "sync_plan": f"""select p.relative_path, d.path || substr(p.relative_path, length(d.project) + 1) as target from (select distinct relative_path, path_checksum from path_map) p
        join lang_dir d on d.role = 'target' and d.project = split_part(p.relative_path, '/', 1) where not exists (select 1 from source_chunk s where {_KEYED.format('s.path_checksum')} = p.path_checksum)""",
    "target_extra_files": "select distinct target_path from chunk_failure f where target_path is not null and not exists (select 1 from path_map p where p.relative_path = f.source_path)",
    "expand_paths": "select distinct p.directory, d.doc_id from documents d join (select distinct regexp_extract(relative_path, '^(.*)/[^/]*$', 1) as directory from path_map) p on starts_with(d.rel_path, p.directory || '/')",
    "nearest_ancestor": "select d.doc_id, arg_max(p.directory, length(p.directory)) as directory from documents d join (select distinct regexp_extract(relative_path, '^(.*)/[^/]*$', 1) as directory from path_map) p on starts_with(d.rel_path, p.directory || '/') group by d.doc_id",
    "same_named_file": "select t.target_path, f.file from (select distinct target_path, regexp_extract(target_path, '([^/]+)$', 1) as name from chunk_failure where target_path is not null) t join (select regexp_extract(relative_path, '([^/]+)$', 1) as name, min(relative_path) as file from path_map group by 1) f using (name)",
}
