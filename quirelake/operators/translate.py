"""Translation of chunks: what the memory has is taken from it, what is left goes once through a pluggable model.

Each request gets one outcome, decided in this order: `blank` (returned as it is), `hit` (in the memory), `repeated` (a
chunk that another request of the same file and language translates), `ph_only` (nothing to translate; recorded as its
own translation), `translated` or `failed` by the model.  Everything up to the model is joins and expressions; the model
is the only Python stage, it sees each distinct chunk of a file once, and its calls can be repeated safely.

A model is a function of a `Request` that returns the raw reply; it raises `Transient` for what may go away (retried
with growing delays, then fatal), `Fatal` for what dooms the run, and anything else for what fails this chunk only.
A reply whose XML is broken or whose placeholders do not match is asked for again; the last attempt goes to the
reasoning model, if there is one.
"""

from __future__ import annotations

import os
import re
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree.ElementTree import ParseError
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import tagging, text
from quirelake.operators import memory, similarity
from quirelake.parsers import tables, typst
from quirelake.parsers.tables import segments_of
from quirelake.runtime import durable

TRIES, FIRST_DELAY, LONGEST_DELAY = 5, 1.0, 16.0
OVERSIZED = 2000
TEMPLATE = "Translate [CONTENT_TYPE] from [SOURCE_LANGUAGE] into [TARGET_LANGUAGE]. Keep every PH element.\nTerms:\n[CUSTOM_VOCABULARY]\n[EXAMPLE]Text:\n[SRC]"
EXAMPLE = "A similar text:\n[OLD_SRC]\nand its translation:\n[OLD_TGT]\n"


class ModelError(Exception):
    """Any failure of a model call."""


class Transient(ModelError):
    """Overload, rate limit, unavailable service or lost connection."""


class Fatal(ModelError):
    """Authentication or unknown model: every further call fails alike."""


class PlaceholderError(ModelError):
    """Missing or extra placeholders in a reply."""


class RunAborted(Exception):
    """The run was given up after a fatal failure; what was translated before is kept."""


@dataclass(frozen=True)
class Request:
    prompt: str
    tagged: str
    src_lang: str
    tgt_lang: str
    chunk_type: str


Model = Callable[[Request], str]
_MODELS: dict[str, Model] = {}


def register_model(name: str, model: Model) -> None:
    """Makes a model known by name; a name can be given once."""
    if name in _MODELS:
        raise ValueError(f"a model named {name!r} is registered already")
    _MODELS[name] = model


def model_named(name: str) -> Model:
    return _MODELS[name]


def echo(request: Request) -> str:
    """The default model: deterministic, marks every text with the target language and keeps the placeholders."""
    return "<output>" + request.tagged.replace("<TEXT>", f"<TEXT>[{request.tgt_lang}] ", 1) + "</output>"


register_model("echo", echo)
BUILT_IN = ("echo",)


def tag(segments: list[tuple[str, str]]) -> tuple[str, dict[str, str], bool]:
    """Tagged XML, placeholders by id, and whether there is nothing but placeholders."""
    merged: list[list[str]] = []
    for kind, content in segments:
        kind = "text" if kind == "text" else "placeholder"
        if not content:
            continue
        if kind == "placeholder" and merged and merged[-1][0] == kind and content != "\n" and merged[-1][1] != "\n":
            merged[-1][1] += content
        else:
            merged.append([kind, content])
    placeholders: dict[str, str] = {}
    parts = []
    for kind, content in merged:
        if kind == "text":
            parts.append(escape(content))
        else:
            number = str(len(placeholders) + 1)
            placeholders[number] = content
            parts.append(f'<PH id="{number}">{escape(content)}</PH>')
    return f"<document><TEXT>{''.join(parts)}</TEXT></document>", placeholders, not any(k == "text" for k, _ in merged)


def extract(reply: str) -> str:
    """The result in a reply (see `functions.text.translated_part`)."""
    if "<output>" in reply:
        bodies = re.findall(r"(?s)<output>(.*?)(?:</output>|\Z)", reply)
        return "".join(b[1:] if b.startswith("\n") else b for b in bodies)
    return "".join(re.findall(r"(?s)<document>.*?(?:</document>|\Z)", reply))


def verify(xml: str, placeholders: dict[str, str]) -> tuple[list[str], list[str]]:
    """Ids that are missing and ids that are not known, by number; placeholders of white space may be missing."""
    found = set(re.findall(r'<PH[^>]*?id="([0-9]+)"', xml))
    missing = {i for i, content in placeholders.items() if content.strip()} - found
    return sorted(missing, key=int), sorted(found - set(placeholders), key=int)


@dataclass
class Caller:
    """How chunks are put to the models."""

    model: Model
    reasoning: Model | None = None
    xml_retries: int = 2
    tries: int = TRIES
    vocabulary: str = ""
    settings: tables.Settings = tables.DEFAULT
    sleep: Callable[[float], None] = time.sleep
    #: the chunk that was parsed last, which often comes again for the next language, and what `tag` made of it
    _last: tuple = field(default=(None, None), init=False, repr=False, compare=False)

    def _tagged(self, chunk_type: str, chunk: str) -> tuple[str, dict[str, str], bool]:
        if self._last[0] != (chunk_type, chunk):
            self._last = (chunk_type, chunk), tag(segments_of(chunk_type, chunk, self.settings))
        return self._last[1]

    def _call(self, model: Model, request: Request) -> str:
        delay = FIRST_DELAY
        for attempt in range(1, self.tries + 1):
            try:
                reply = model(request)
                if reply is None:
                    raise TypeError("the model gave no reply")
                return reply
            except Transient:
                if attempt == self.tries:
                    raise
                self.sleep(delay)
                delay = min(2 * delay, LONGEST_DELAY)
        raise AssertionError

    def translate(self, chunk: str, chunk_type: str, src_lang: str, tgt_lang: str, example: tuple[str, str] | None = None) -> tuple[str, str, bool]:
        """Outcome, text and whether the reasoning model was asked."""
        xml, placeholders, only = self._tagged(chunk_type, chunk)
        if only or chunk_type == "code":
            return "ph_only", chunk, False
        if chunk_type == "typst" and len(chunk) > OVERSIZED:
            parts = typst.subchunks(chunk, OVERSIZED, self.settings.typst)
            if len(parts) > 1:
                done = [self.translate(p, chunk_type, src_lang, tgt_lang) if p.strip() else ("blank", p, False) for p in parts]
                return "translated", "".join(t for _, t, _ in done), any(r for *_, r in done)
        prompt = TEMPLATE.replace("[EXAMPLE]", EXAMPLE.replace("[OLD_SRC]", example[0]).replace("[OLD_TGT]", example[1]) if example else "")
        for token, value in (("[TARGET_LANGUAGE]", tgt_lang), ("[SOURCE_LANGUAGE]", src_lang), ("[CONTENT_TYPE]", chunk_type), ("[CUSTOM_VOCABULARY]", self.vocabulary), ("[SRC]", xml)):
            prompt = prompt.replace(token, value)
        request = Request(prompt, xml, src_lang, tgt_lang, chunk_type)
        for attempt in range(self.xml_retries + 1):
            last = attempt == self.xml_retries
            asked_reasoning = last and self.reasoning is not None
            try:
                result = extract(self._call(self.reasoning if asked_reasoning else self.model, request))
                missing, extra = verify(result, placeholders)
                back = tagging.rebuild(result, placeholders)
                if missing or extra:
                    raise PlaceholderError(f"missing {missing}, extra {extra}")
                return "translated", back, asked_reasoning
            except (ParseError, PlaceholderError) as error:
                error.asked_reasoning = asked_reasoning
                if last:
                    raise
            except Exception as error:
                error.asked_reasoning = asked_reasoning
                raise
        raise AssertionError


KEY = ["path_hash", "tgt_lang", "src_checksum"]
RESULT = "path_hash string, tgt_lang string, src_checksum string, outcome string, text string, error_type string, error_message string, fatal boolean, reasoning boolean"


def call_model(requests: DataFrame, caller: Caller) -> DataFrame:
    """The result of each request (KEY, content, chunk_type, src_lang, old_src, old_tgt).

    After a failure that dooms the run a task makes no more calls: the rest of its requests are `untried`. The languages of
    a chunk follow each other, so that it is parsed once."""
    names = [part.split()[0] for part in RESULT.split(", ")]
    types = [*[pa.string()] * 7, pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doomed = False
        for batch in batches:
            rows = []
            for path, tgt, checksum, content, kind, src, old_src, old_tgt in zip(*(batch.column(i).to_pylist() for i in range(8))):
                key = (path, tgt, checksum)
                example = (old_src, old_tgt) if old_src is not None and old_tgt is not None else None
                if doomed:
                    rows.append((*key, "untried", content, None, None, False, False))
                    continue
                try:
                    outcome, result, reasoning = caller.translate(content, kind, src, tgt, example)
                    rows.append((*key, outcome, result, None, None, False, reasoning))
                except Exception as error:  # noqa: BLE001 - every failure is a row
                    doomed = isinstance(error, (Fatal, Transient))
                    rows.append((*key, "failed", content, type(error).__name__, str(error), doomed, getattr(error, "asked_reasoning", False)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    asked = requests.select(*KEY, "content", "chunk_type", "src_lang", "old_src", "old_tgt")
    return asked.repartition("path_hash", "src_checksum").sortWithinPartitions("path_hash", "src_checksum", "chunk_type").mapInArrow(run, RESULT)


def find_examples(requests: DataFrame, memory_index: DataFrame, store: DataFrame, threshold: float = similarity.EXAMPLE_THRESHOLD) -> DataFrame:
    """path_hash, src_lang, tgt_lang, src_checksum, old_src, old_tgt, score: for each request the most similar stored text
    of its file and language, if it scores above the threshold and has a translation; there is no second best."""
    group = lambda lang: F.concat_ws(" ", lang, "path_hash")
    asked = requests.select("path_hash", "src_lang", "src_checksum", F.col("content").alias("text")).dropDuplicates(["path_hash", "src_lang", "src_checksum"])
    asked = asked.select(group("src_lang").alias("grp"), F.concat_ws(" ", "src_lang", "path_hash", "src_checksum").alias("query_id"), "text", F.lit(None).cast("string").alias("own"), "path_hash", "src_lang", "src_checksum")
    stored = store.select(group("lang").alias("grp"), "checksum", "text")
    best = similarity.best_matches(asked, stored, threshold)
    won = asked.select("query_id", "path_hash", "src_lang", "src_checksum").join(best, "query_id").drop("query_id").withColumnRenamed("checksum", "old_checksum")
    texts = lambda lang, checksum, name: store.select("path_hash", F.col("lang").alias(lang), F.col("checksum").alias(checksum), F.col("text").alias(name))
    known = memory_index.withColumnRenamed("src_checksum", "old_checksum").withColumnRenamed("tgt_checksum", "old_tgt_checksum")
    return (
        won.join(known, ["path_hash", "src_lang", "old_checksum"])
        .join(texts("src_lang", "old_checksum", "old_src"), ["path_hash", "src_lang", "old_checksum"])
        .join(texts("tgt_lang", "old_tgt_checksum", "old_tgt"), ["path_hash", "tgt_lang", "old_tgt_checksum"])
        .select("path_hash", "src_lang", "tgt_lang", "src_checksum", "old_src", "old_tgt", "score")
    )


def translate(requests: DataFrame, memory_index: DataFrame, store: DataFrame, caller: Caller, examples: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """chunk_id, path_hash, chunk_index, tgt_lang, src_lang, src_checksum, content, outcome, text, error_type,
    error_message, fatal, reasoning, is_part of every request.

    requests: chunk_id, path_hash, chunk_index, content, chunk_type, src_lang, tgt_lang, src_checksum. examples: see
    `find_examples`. Typst chunks beyond the limit of a call are divided; their parts are requests of their own, looked up
    and recorded like any other, and rows of their own here (is_part). whole: chunks are not divided.

    The lookup is made once and kept, and so are the model's replies, so that the loss of a task repeats no call."""
    looked = memory.mark_session(memory.lookup(requests, memory_index, store))
    oversized = (F.col("chunk_type") == "typst") & (F.length("content") > OVERSIZED) & F.lit(not whole)
    first = F.when(text.is_blank(F.col("content")), "blank").when(F.col("tgt_text").isNotNull(), "hit").when(~F.col("is_first"), "repeated").when(oversized, "parts").otherwise("call")
    labelled = durable(looked.select(*requests.columns, "tgt_text", first.alias("label")))
    calls = labelled.where("label = 'call'")
    if examples is not None:
        calls = calls.join(examples.select(*KEY, "src_lang", "old_src", "old_tgt"), [*KEY, "src_lang"], "left")
    else:
        calls = calls.withColumns({"old_src": F.lit(None).cast("string"), "old_tgt": F.lit(None).cast("string")})
    # one call for each distinct chunk of a file and language
    made = durable(call_model(calls, caller))
    parts = None
    if not whole:
        done, parts = _in_parts(labelled.where("label = 'parts'"), memory_index, store, caller)
        made = made.unionByName(done)
    joined = labelled.join(made.withColumnRenamed("text", "made_text"), KEY, "left")
    is_made, is_called = F.col("label").isin("call", "parts", "repeated"), F.col("label").isin("call", "parts")
    outcome = F.when(is_called, F.col("outcome")).otherwise(F.col("label"))
    result = F.when(F.col("label") == "blank", F.col("content")).when(F.col("label") == "hit", F.col("tgt_text")).otherwise(F.col("made_text"))
    rows = joined.select(
        "chunk_id", "path_hash", "chunk_index", "tgt_lang", "src_lang", "src_checksum", "content", outcome.alias("outcome"), result.alias("text"),
        F.when(is_made, F.col("error_type")).alias("error_type"), F.when(is_made, F.col("error_message")).alias("error_message"),
        F.coalesce(is_made & F.col("fatal"), F.lit(False)).alias("fatal"), F.coalesce(is_called & F.col("reasoning"), F.lit(False)).alias("reasoning"),
        F.lit(False).alias("is_part"),
    )
    return rows if parts is None else rows.unionByName(parts.withColumn("is_part", F.lit(True)))


def _in_parts(oversized: DataFrame, memory_index: DataFrame, store: DataFrame, caller: Caller) -> tuple[DataFrame, DataFrame]:
    """Results of oversized chunks, and those of their parts. A whole is from the memory if all its parts are, and fails if
    one of them does."""
    functions = caller.settings.typst

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*row[:-1], number, part) for row in zip(*(c.to_pylist() for c in batch.columns)) for number, part in enumerate(typst.subchunks(row[-1], OVERSIZED, functions), 1)]
            if rows:
                types = [pa.string()] * 4 + [pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*KEY, "src_lang", "part", "content"])

    cut = oversized.select(*KEY, "src_lang", "content").mapInArrow(divide, "path_hash string, tgt_lang string, src_checksum string, src_lang string, part int, content string")
    cut = cut.withColumnRenamed("src_checksum", "whole_checksum").withColumn("src_checksum", text.checksum(F.col("content")))
    asked = cut.select(F.lit(None).cast("bigint").alias("chunk_id"), "path_hash", F.col("part").alias("chunk_index"), "content", F.lit("typst").alias("chunk_type"), "src_lang", "tgt_lang", "src_checksum")
    # parts that are alike are asked for once
    results = translate(asked.dropDuplicates(KEY), memory_index, store, caller, whole=True)
    each = cut.select(*KEY, "whole_checksum", "part").join(results.select(*KEY, "outcome", "text", "error_type", "error_message", "fatal", "reasoning"), KEY)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "")
    bad = F.max(F.when(F.col("outcome").isin("failed", "untried"), F.struct(F.lit(1).alias("n"), "outcome", "error_type", "error_message")))
    done = each.groupBy("path_hash", "tgt_lang", "whole_checksum").agg(
        F.bool_and(F.col("outcome").isin("hit", "blank")).alias("all_cached"), bad.alias("bad"), texts.alias("text"), F.bool_or("fatal").alias("fatal"), F.bool_or("reasoning").alias("reasoning")
    )
    outcome = F.when(F.col("bad").isNotNull(), F.col("bad.outcome")).when(F.col("all_cached"), "hit").otherwise("translated")
    sources = oversized.select(*KEY, "content").withColumnRenamed("src_checksum", "whole_checksum").dropDuplicates(["path_hash", "tgt_lang", "whole_checksum"])
    whole = done.join(sources, ["path_hash", "tgt_lang", "whole_checksum"]).select(
        "path_hash", "tgt_lang", F.col("whole_checksum").alias("src_checksum"), outcome.alias("outcome"),
        F.when(F.col("bad").isNotNull(), F.col("content")).otherwise(F.col("text")).alias("text"), "bad.error_type", "bad.error_message", "fatal", "reasoning",
    )
    return whole, results.drop("is_part")


def stats(results: DataFrame, *by: str) -> DataFrame:
    """from_cache, translated, passed_to_reasoning, failed and their total; blank and placeholder-only chunks and parts
    count nowhere, repeated ones as from the cache."""
    cached = F.count_if(F.col("outcome").isin("hit", "repeated"))
    translated, failed = F.count_if(F.col("outcome") == "translated"), F.count_if(F.col("outcome") == "failed")
    return results.where("not is_part").groupBy(*by).agg(
        cached.alias("from_cache"), translated.alias("translated"), F.count_if("reasoning").alias("passed_to_reasoning"), failed.alias("failed"),
        (cached + translated + failed).alias("total"),
    )


def new_pairs(results: DataFrame) -> DataFrame:
    """What a run adds to the memory: pairs of checksums and texts of translated and placeholder-only chunks and parts."""
    return results.where("outcome in ('translated', 'ph_only')").select(
        "path_hash", "src_lang", "src_checksum", "tgt_lang", text.checksum(F.col("text")).alias("tgt_checksum"), "text"
    ).distinct()


CARRIED = ("needs_review", "translation_service", "translation_model")


def provenance(results: DataFrame, service: str, model: str, existing: DataFrame | None = None) -> DataFrame:
    """The results with `metadata`, of each chunk in its target: a new translation is to be reviewed and names its service
    and model; one from the memory keeps what its existing target says of that; a failed one says that it is the source.

    existing: path_hash, tgt_lang, src_checksum, nth, metadata of the target as it is; the first of a checksum counts."""
    if existing is None:
        carried = results.withColumn("_old", F.lit(None).cast("map<string,string>"))
    else:
        first = existing.groupBy(*KEY).agg(F.min_by("metadata", "nth").alias("_old"))
        carried = results.join(first, KEY, "left")
    own = lambda names, values: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))
    source = F.coalesce("src_checksum", F.lit(""))
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*CARRIED))
    entries = (
        F.when(F.col("outcome").isin("translated", "repeated"), own(["src_checksum", *CARRIED], [source, F.lit("True"), F.lit(service), F.lit(model)]))
        .when(F.col("outcome").isin("failed", "untried"), own(["src_checksum", "not-translated-due-to-exception"], [source, F.lit("True")]))
        .otherwise(F.map_concat(own(["src_checksum"], [source]), kept))
    )
    return carried.withColumn("metadata", entries).drop("_old")


def chunk_failures(results: DataFrame, lines: DataFrame) -> DataFrame:
    """path_hash, tgt_lang, chunk_index, error_type, error_message, source_line, target_line of every chunk that failed.

    lines: path_hash, tgt_lang, chunk_index, source_line, target_line, where the chunks begin; null beyond their number."""
    failed = results.where("outcome = 'failed' and not is_part").select("path_hash", "tgt_lang", "chunk_index", "error_type", "error_message")
    return failed.join(lines, ["path_hash", "tgt_lang", "chunk_index"], "left")


def check_fatal(results: DataFrame) -> None:
    """Raises RunAborted if some call was fatal; to be called after the results are stored."""
    row = results.where("fatal").select("error_type", "error_message").first()
    if row:
        raise RunAborted(f"{row['error_type']}: {row['error_message']}")


# -- services and strategies --------------------------------------------------------------------------------------------

SERVICE_TEMPLATE = "template.py"


def load_services(folder: str) -> list[str]:
    """Registers the `model` of every Python file of a folder, in the order of their names, under the file's name; the
    template is left out, a file that cannot be read or has the name of a built-in model is skipped with a warning."""
    found = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith(".py") or name == SERVICE_TEMPLATE:
            continue
        service, space = name[:-3], {}
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as file:
                exec(compile(file.read(), name, "exec"), space)  # noqa: S102 - the user's own code
            model = space["model"]
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"{name} gives no service: {error!r}", stacklevel=2)
            continue
        if service in BUILT_IN:
            warnings.warn(f"{service} is built in; {name} is not used", stacklevel=2)
            continue
        _MODELS.pop(service, None)
        register_model(service, model)
        found.append(service)
    return found


def custom_services() -> list[str]:
    """The registered services that are not built in."""
    return sorted(set(_MODELS) - set(BUILT_IN))


#: how chunks are put to a model, by type of document and of chunk
STRATEGIES = {
    **{(kind, chunk): "tagged" for kind, chunk in (("latex", "latex"), ("markdown", "myst"), ("typst", "typst"), ("jupyter", "myst"))},
    ("jupyter", "code"): "unchanged", ("other", "other"): "plain",
}


def strategy(doc_type: str, chunk_type: str) -> str:
    """The strategy of a pair of types; KeyError for one that is not known."""
    return STRATEGIES[doc_type, chunk_type]
