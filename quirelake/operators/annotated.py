"""Target documents: chunks with a metadata block in front of each, compiled and read back, for LaTeX, MyST and Typst.

A document is compiled as a sequence of blocks in order; nothing here holds a whole file: blocks are rows, `parts` puts
some two hundred of them together, and the sink appends rows to a file.  Reading splits a text, or a part of one, at its
blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import ordered

KINDS = tuple(text.BLOCKS)
ORDER = ["chunk_index", "nr"]


def blocks(chunks: DataFrame, file: Sequence[str]) -> DataFrame:
    """The chunks with `block`: metadata and source as they stand in the file.

    chunks: the file's columns, kind (latex, myst, typst), chunk_index and nr (its order), entries (key, value structs),
    source. LaTeX puts nothing between a source and the next block, MyST begins its block with a line break, Typst adds
    one to a source that does not end in one, unless it is the last of its file."""
    last = chunks.groupBy(*file).agg(F.max(F.struct(*ORDER)).alias("_last"))
    own = ordered.join_null_safe(chunks, last, file).withColumn("_is_last", F.struct(*ORDER) == F.col("_last")).drop("_last")
    head = F.when(F.lit(False), F.lit(""))
    for kind in KINDS:
        head = head.when(F.col("kind") == kind, text.metadata_block(F.col("entries"), kind))
    missing = (F.col("kind") == "typst") & ~F.col("_is_last") & ~F.endswith("source", F.lit("\n"))
    block = F.concat(head, F.col("source"), F.when(missing, "\n").otherwise(""))
    return own.withColumn("block", block).drop("_is_last")


def start_lines(compiled: DataFrame, file: Sequence[str], block: int = 200) -> DataFrame:
    """The blocks with `start_line`, the line (from 1) at which each begins in its file."""
    breaks = F.length("block") - F.length(F.replace("block", F.lit("\n"), F.lit("")))
    total = ordered.running_total(compiled.withColumn("n_breaks", breaks), file, ORDER, "n_breaks", "before", block)
    return total.withColumn("start_line", (F.col("before") + 1).cast("bigint")).drop("before", "n_breaks")


def parts(compiled: DataFrame, file: Sequence[str], size: int = 200) -> DataFrame:
    """The file's columns, part, text: the text of the blocks of each `size` chunk numbers."""
    own = F.array_sort(F.collect_list(F.struct(*ORDER, "block")))
    grouped = compiled.groupBy(*file, F.floor(F.col("chunk_index") / size).cast("bigint").alias("part"))
    return grouped.agg(F.array_join(F.transform(own, lambda x: x["block"]), "").alias("text"))


def chunks_of(document: Column, kind: Column) -> Column:
    """inside (of the metadata block, null before the first), content (stripped) of the chunks of a text, in order,
    without blank ones."""
    out = F.when(F.lit(False), F.array().cast("array<struct<inside:string,content:string>>"))
    for each in KINDS:
        out = out.when(kind == each, _chunks_of(document, each))
    return out


def _chunks_of(document: Column, kind: str) -> Column:
    begin, whole = text.block_start(kind), text.block_pattern(kind)
    head = F.regexp_extract(document, rf"(?s)\A(.*?)(?={begin}|\z)", 1)
    each = whole + rf"(.*?)(?={begin}|\z)"
    inside, content = (F.regexp_extract_all(document, F.lit(each), F.lit(k)) for k in (1, 2))
    read = F.zip_with(inside, content, lambda i, c: F.struct(i.alias("inside"), text.strip(c).alias("content")))
    first = F.array(F.struct(F.lit(None).cast("string").alias("inside"), text.strip(head).alias("content")))
    return F.filter(F.concat(first, read), lambda c: c["content"] != "")


def read(documents: DataFrame, document: str, kind: str, *keep: str) -> DataFrame:
    """A row for each chunk of annotated texts: nth (from 1), metadata (key -> value, empty before the first block), body."""
    rows = documents.select(*keep, F.posexplode(chunks_of(F.col(document), F.col(kind))).alias("pos", "chunk"))
    # a key that is given twice has its last value
    pairs = text.parse_metadata(F.coalesce(F.col("chunk.inside"), F.lit("")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda done, p: F.map_concat(F.map_filter(done, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    return rows.select(*keep, (F.col("pos") + 1).alias("nth"), last.alias("metadata"), F.col("chunk.content").alias("body"))
