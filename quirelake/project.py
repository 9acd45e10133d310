"""A project on disk: its files scanned, chunked, translated, written, synchronised and corrected, with one memory.

The driver decides which files and languages take part; everything else is one job over all of them, whose rows carry
their file.  A file's target is written by one task that appends its rows in order; no file is held whole but by the
reader of the file source, for which a file is a row.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.engine import Engine
from quirelake.functions import text
from quirelake.operators import annotated, translate
from quirelake.parsers import latex, myst, notebook, tables, typst
from quirelake.runtime import durable
from quirelake.sources import config as settings
from quirelake.sources import files

SERVICES, MEMORY, RUNS = ".quirelake/services", ".quirelake/memory", ".quirelake/runs"
#: chunk type of a document type's prose, and the form of its metadata blocks
CHUNK_TYPES = {"latex": "latex", "markdown": "myst", "typst": "typst", "jupyter": "myst", "other": "other"}
PLAIN_LINES = 50


def chunks_of(kind: str, content: str) -> list[tuple[str, str]]:
    """(chunk type, content) of a document's chunks, by its type; Markdown with a Jupytext header is a notebook."""
    if kind == "latex":
        return [("latex", c) for c in latex.chunks(content)]
    if kind == "typst":
        return [("typst", c) for _, c in typst.chunks(content)]
    cells = notebook.cells_of(content) if kind in ("jupyter", "markdown") else []
    if cells:
        return [("code" if c["cell_type"] == "code" else "myst", c["source"]) for c in cells]
    if kind in ("markdown", "jupyter"):
        return [("myst", c) for *_, c in myst.chunks(content)]
    lines = content.splitlines(keepends=True)
    return [("other", "".join(lines[i : i + PLAIN_LINES])) for i in range(0, len(lines), PLAIN_LINES)]


class Project:
    """A project, found by its configuration file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.config = settings.load(os.path.join(self.root, settings.FILE_NAME))
        self.engine = Engine(spark, os.path.join(self.root, MEMORY))
        self.services = translate.load_services(os.path.join(self.root, SERVICES))

    # -- what the configuration says

    def settings(self) -> tables.Settings:
        c = self.config
        own = latex.Settings(frozenset(c.latex_placeholder_envs), frozenset(c.latex_math_envs), frozenset(c.latex_placeholder_commands), c.latex_command_args, c.latex_command_specs)
        return tables.Settings(own, c.typst or None)

    def source(self) -> settings.LangDir:
        if self.config.src_dir is None:
            raise settings.ConfigError("the project has no source directory")
        return self.config.src_dir

    def targets(self, language: str | None = None) -> list[settings.LangDir]:
        """The target directories, or that of one language."""
        found = [self.config.target(language)] if language else self.config.lang_dirs
        if not found:
            raise settings.ConfigError("the project has no target directory")
        return found

    def relative(self, path: str) -> str:
        """A listed file as it stands under the source directory."""
        return os.path.relpath(settings.normal(path), settings.normal(self.source().path)).replace(os.sep, "/")

    def cache_path(self, path: str) -> str:
        """The path under its directory of a file given absolutely, from here, from the root or from the source; it must
        exist in the source or a target directory."""
        directories = [os.path.join(self.root, d.path) for d in (self.source(), *self.config.lang_dirs)]
        for base in (os.getcwd(), self.root, directories[0]):
            full = os.path.normpath(os.path.join(base, path))
            for directory in directories:
                if full.startswith(directory + os.sep) and os.path.exists(full):
                    return os.path.relpath(full, directory).replace(os.sep, "/")
        raise settings.ConfigError(f"{path} is in no directory of the project")

    def caller(self, use_reasoning: bool = False, vocabulary: str | None = None) -> translate.Caller:
        """How chunks are put to the configured models; a vocabulary given goes before the configured file's."""
        main, reasoning = self.config.routed(use_reasoning)
        keys = {}
        if self.config.env_file and os.path.exists(os.path.join(self.root, self.config.env_file)):
            with open(os.path.join(self.root, self.config.env_file), encoding="utf-8") as file:
                keys = settings.parse_env(file.read())
        for name, key in zip(("LLM_API_KEY", "LLM_REASONING_API_KEY"), settings.resolve_keys(dict(os.environ), keys)):
            if key:
                os.environ[name] = key
        known = lambda service: translate.model_named(service)
        try:
            return translate.Caller(known(main[0]), known(reasoning[0]) if reasoning else None, self.config.xml_retries_before_reasoning, vocabulary=vocabulary or "", settings=self.settings())
        except KeyError as error:
            raise settings.ConfigError(f"no service {error}") from error

    # -- scans

    def texts(self, directory: str, relative: Iterable[str]) -> DataFrame:
        """doc, rel_path, path_hash, doc_type, text of the named files that are there."""
        root = os.path.join(self.root, directory)
        paths = [path for r in relative if os.path.isfile(path := os.path.join(root, r))]
        schema = "doc bigint, rel_path string, path_hash string, doc_type string, text string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = files.scan_texts(self.spark, paths, base=root)
        numbered = found.select(F.monotonically_increasing_id().alias("doc"), "rel_path", text.path_checksum(F.col("rel_path")).alias("path_hash"), "doc_type", "text")
        return durable(numbered)

    def chunks(self, texts: DataFrame) -> DataFrame:
        """rel_path, path_hash, doc_type, chunk_index, chunk_type, content, src_checksum of the chunks of texts."""
        cut = tables._rows(texts, "doc", "doc_type", "text", chunks_of, "id bigint, chunk_index int, chunk_type string, content string")
        joined = cut.join(texts.select(F.col("doc").alias("id"), "rel_path", "path_hash", "doc_type"), "id")
        return joined.select("rel_path", "path_hash", "doc_type", "chunk_index", "chunk_type", "content", text.checksum(F.col("content")).alias("src_checksum"))

    def source_chunks(self, relative: Iterable[str]) -> DataFrame:
        return self.chunks(self.texts(self.source().path, relative))

    def target_chunks(self, target: settings.LangDir, relative: Iterable[str]) -> DataFrame:
        """rel_path, path_hash, nth, metadata, body of the chunks in the target files that are there."""
        texts = self.texts(target.path, relative)
        kind = F.col("doc_type")
        own = F.when(kind == "markdown", "myst").otherwise(kind)
        documents = texts.where("doc_type in ('latex', 'markdown', 'typst')").withColumn("kind", own)
        read = annotated.read(documents, "text", "kind", "rel_path", "path_hash")
        cells = notebook.explode_cells(texts.where("doc_type = 'jupyter'"), "text", "rel_path", "path_hash", "doc_type")
        of_cells = cells.where("src_checksum is not null").select(
            "rel_path", "path_hash", F.col("cell_index").alias("nth"), "metadata", text.strip(F.col("source")).alias("body")
        )
        return read.unionByName(of_cells.where("body <> ''"))

    # -- translation

    def translate(self, to: str | None = None, paths: list[str] | None = None, use_reasoning: bool = False, vocabulary: str | None = None, on_file: Callable[[dict], None] | None = None) -> list[dict]:
        """Translates files (all, or those named) into one language or all, writes the targets, and returns a row of counts
        for each file and language, which `on_file` gets as well.

        Chunks that failed keep their source. A failure that dooms the run is raised after what was made is written."""
        listed = self.config.expand(paths) if paths else self.config.translatable_files
        relative = [self.relative(p) for p in listed]
        caller, source = self.caller(use_reasoning, vocabulary), self.source()
        names = [d.language for d in self.targets(to)]
        chunks = durable(self.source_chunks(relative).withColumn("chunk", F.monotonically_increasing_id()))
        wanted = chunks.withColumn("src_lang", F.lit(source.language)).withColumn("tgt_lang", F.explode(F.array(*map(F.lit, names))))
        requests = wanted.select(F.col("chunk").alias("chunk_id"), "path_hash", "chunk_index", "content", "chunk_type", "src_lang", "tgt_lang")
        aborted: translate.RunAborted | None = None
        out = os.path.join(self.root, RUNS, f"v={self.engine.version() + 1}")
        try:
            results = self.engine.translate(requests, caller, out)
        except translate.RunAborted as error:
            aborted, results = error, self.spark.read.parquet(out)
        main, _ = self.config.routed(use_reasoning)
        whole = results.where("not is_part").join(chunks.select(F.col("chunk").alias("chunk_id"), "rel_path", "doc_type", "chunk_type"), "chunk_id")
        for target in self.targets(to):
            existing = self.target_chunks(target, relative).select("path_hash", F.lit(target.language).alias("tgt_lang"), F.col("metadata")["src_checksum"].alias("src_checksum"), "nth", "metadata").where("src_checksum is not null")
            own = durable(translate.provenance(whole.where(F.col("tgt_lang") == target.language), *main, existing))
            self.write(own, os.path.join(self.root, target.path))
        counts = translate.stats(whole, "rel_path", "tgt_lang").orderBy("rel_path", "tgt_lang")
        rows = [row.asDict() for row in counts.collect()]  # a row a file and language
        for row in rows if on_file else ():
            on_file(row)
        if aborted:
            raise aborted
        return rows

    def compiled(self, results: DataFrame) -> DataFrame:
        """rel_path, part, text: the rows of target files in order, of results with their metadata."""
        kind = F.when(F.col("doc_type") == "markdown", "myst").otherwise(F.col("doc_type"))
        keys = F.array(F.lit("src_checksum"), *(F.lit(k) for k in (*translate.CARRIED, "not-translated-due-to-exception")))
        entries = F.transform(F.filter(keys, lambda k: F.map_contains_key("metadata", k)), lambda k: F.struct(k.alias("key"), F.col("metadata")[k].alias("value")))
        marked = results.where("doc_type in ('latex', 'markdown', 'typst')").select("rel_path", kind.alias("kind"), "chunk_index", F.col("chunk_id").alias("nr"), entries.alias("entries"), F.col("text").alias("source"))
        out = annotated.blocks(marked, ["rel_path", "kind"]).select("rel_path", F.col("chunk_index").alias("part"), F.col("block").alias("text"))
        out = out.unionByName(results.where("doc_type = 'other'").select("rel_path", F.col("chunk_index").alias("part"), "text"))
        cells = results.where("doc_type = 'jupyter'")
        last = cells.groupBy("rel_path").agg(F.max("chunk_index").alias("last"))
        cell_type = F.when(F.col("chunk_type") == "code", "code").otherwise("markdown")
        code = F.when(F.col("chunk_type") == "code", F.lit(', "outputs": [], "execution_count": null')).otherwise("")
        body = F.concat(
            F.when(F.col("chunk_index") == 1, '{"cells": [').otherwise(","), F.lit('{"cell_type": "'), cell_type, F.lit('", "metadata": '), F.to_json("metadata"),
            F.lit(', "source": '), F.expr("substring(to_json(named_struct('s', text)), 6, length(to_json(named_struct('s', text))) - 6)"), code, F.lit("}"),
            F.when(F.col("chunk_index") == F.col("last"), '], "metadata": {}, "nbformat": 4, "nbformat_minor": 5}').otherwise(""),
        )
        return out.unionByName(cells.join(last, "rel_path").select("rel_path", F.col("chunk_index").alias("part"), body.alias("text")))

    def write(self, results: DataFrame, directory: str) -> int:
        """Writes the targets of results (of one language); notebooks keep the metadata that their source has."""
        n = files.write_documents(self.compiled(results), directory)
        for path in self.config.translatable_files:
            made = os.path.join(directory, self.relative(path))
            if path.endswith(".ipynb") and os.path.exists(made):
                with open(os.path.join(self.root, path), encoding="utf-8") as file:
                    kept = json.load(file).get("metadata", {})
                with open(made, encoding="utf-8") as file:
                    cells = json.load(file)["cells"]
                with open(made, "w", encoding="utf-8") as file:
                    file.write(notebook.written(cells, kept))
        return n

    # -- files that are not translated

    def sync(self, to: str | None = None) -> int:
        """Copies what is not translated into the targets; returns the number of files copied."""
        listed = files.list_files(self.spark, os.path.join(self.root, self.source().path))
        ignored = self.spark.createDataFrame([(self.relative(p),) for p in self.config.translatable_files], "path string")
        plan = durable(files.copy_plan(listed, ignored))
        return sum(files.copy_files(plan, os.path.join(self.root, self.source().path), os.path.join(self.root, d.path)) for d in self.targets(to))

    def extra_files(self, to: str) -> DataFrame:
        """Files of a target that the source does not have."""
        return files.extra_files(*(files.list_files(self.spark, os.path.join(self.root, d.path)) for d in (self.config.target(to), self.source())))

    # -- the memory

    def _edited(self, target: settings.LangDir) -> tuple[DataFrame, DataFrame]:
        relative = [self.relative(p) for p in self.config.translatable_files]
        for r in relative:
            if not os.path.exists(os.path.join(self.root, target.path, r)):
                warnings.warn(f"{r} has no {target.language} target", stacklevel=3)
        sources = self.source_chunks(relative).select("path_hash", "src_checksum", F.col("content").alias("src_text"), F.lit(self.source().language).alias("src_lang"), F.col("chunk_index").alias("ord"))
        targets = self.target_chunks(target, relative).select(
            "path_hash", F.col("metadata")["src_checksum"].alias("src_checksum"), F.col("body").alias("tgt_text"), F.lit(target.language).alias("tgt_lang"),
            F.coalesce(F.col("metadata")["not-translated-due-to-exception"], F.lit("")).alias("failed"),
        )
        return sources, targets.where("src_checksum is not null and failed = ''").drop("failed")

    def cache_sync(self, to: str | None = None) -> int:
        """Records what the target files say, for one language or all; files without a target are passed over."""
        for target in self.targets(to):
            self.engine.sync(*self._edited(target))
        return self.engine.version()

    def correct(self, to: str) -> int:
        """Records the chunks of a target that were edited; returns their number. For LaTeX, MyST and notebooks."""
        if any(p.endswith(".typ") for p in self.config.translatable_files):
            warnings.warn("Typst files are not corrected", stacklevel=2)
        target = self.config.target(to)
        _, targets = self._edited(target)
        return self.engine.record(targets.withColumn("src_lang", F.lit(self.source().language)))

    def status(self) -> DataFrame:
        """lang, rel_path, total, translated, needs_review of every translatable file and target language."""
        relative = [self.relative(p) for p in self.config.translatable_files]
        chunks, index = self.source_chunks(relative), self.engine.index()
        out = None
        for target in self.targets():
            wanted = chunks.where("chunk_type <> 'code'").withColumns({"src_lang": F.lit(self.source().language), "tgt_lang": F.lit(target.language)})
            marks = self.target_chunks(target, relative).where(F.col("metadata")["needs_review"] == "True").select("path_hash", F.col("metadata")["src_checksum"].alias("src_checksum")).distinct().withColumn("review", F.lit(1))
            joined = wanted.join(index, ["path_hash", "src_lang", "tgt_lang", "src_checksum"], "left").join(marks, ["path_hash", "src_checksum"], "left")
            one = joined.groupBy(F.col("tgt_lang").alias("lang"), "rel_path").agg(
                F.count(F.lit(1)).alias("total"), F.count("tgt_checksum").alias("translated"), F.count(F.when(F.col("tgt_checksum").isNotNull(), F.col("review"))).alias("needs_review")
            )
            out = one if out is None else out.unionByName(one)
        return out.orderBy("lang", "rel_path")
