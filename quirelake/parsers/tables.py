"""The parsers as table functions: a column of texts in, ordered rows out. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators.ordered import split_at_boundary
from quirelake.parsers import code, latex, myst, notebook, typst


@dataclass(frozen=True)
class Settings:
    """What a project says about its formats; sent to the workers with the parser."""

    latex: latex.Settings = latex.DEFAULT
    #: names of the arguments that are text, by function, in place of the default names
    typst: dict[str, list[str]] | None = None
    code_language: str = "python"


DEFAULT = Settings()


def segments_of(kind: str, text: str, settings: Settings = DEFAULT) -> list[tuple[str, str]]:
    """Segments by chunk type; a type without a parser is one text segment. Code may name its language: `code:rust`."""
    if kind == "latex":
        return latex.segments(text, settings.latex)
    if kind == "myst":
        return myst.segments(text)
    if kind == "typst":
        return typst.segments(text, settings.typst)
    if kind and kind.split(":")[0] == "code":
        return code.segments(text, kind.split(":")[1] if ":" in kind else settings.code_language)
    return [("text", text)] if text else []


def chunks_of(kind: str, text: str) -> list[tuple[str | None, str]]:
    """(chunk id, content) by document type; a type without a chunker is handled whole."""
    if kind == "latex":
        return [(name, content) for name, content in latex.named_chunks(text)]
    if kind == "jupyter" and text.lstrip().startswith("{"):
        return [(f"cell_{i}", cell["source"]) for i, cell in enumerate(notebook.cells_of(text), 1) if cell["source"]]
    if kind in ("markdown", "jupyter") and notebook.has_jupytext_header(text):
        return [(f"cell_{i}", cell["source"]) for i, cell in enumerate(notebook.cells_of(text), 1) if cell["source"]]
    if kind in ("markdown", "myst", "jupyter"):
        return [(None, content) for *_, content in myst.chunks(text)]
    if kind == "typst":
        return typst.chunks(text)
    return [(None, text)] if text else []


def _rows(df: DataFrame, id_column: str, kind_column: str, text_column: str, make, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, number, *row)
                for key, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)))
                if text is not None
                for number, row in enumerate(make(kind, text), 1)
            ]
            if rows:
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), *[pa.string()] * (len(names) - 2)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    source = df.select(F.col(id_column).cast("bigint"), F.col(kind_column).cast("string"), F.col(text_column).cast("string"))
    return source.mapInArrow(run, schema)


def segments(df: DataFrame, id_column: str, kind_column: str, text_column: str, settings: Settings = DEFAULT) -> DataFrame:
    return _rows(df, id_column, kind_column, text_column, lambda k, t: segments_of(k, t, settings), "id bigint, seg_index int, kind string, content string")


def chunks(df: DataFrame, id_column: str, kind_column: str, text_column: str) -> DataFrame:
    return _rows(df, id_column, kind_column, text_column, chunks_of, "id bigint, chunk_index int, chunk_name string, content string")


def subchunks(df: DataFrame, id_column: str, kind_column: str, text_column: str, limit: int = 2000, settings: Settings = DEFAULT) -> DataFrame:
    """Parts of oversized chunks: by segments for Typst, at text boundaries for the rest."""

    def make(kind: str, text: str) -> list[tuple[str]]:
        return [(p,) for p in (typst.subchunks(text, limit, settings.typst) if kind == "typst" else split_at_boundary(text, limit))]

    return _rows(df, id_column, kind_column, text_column, make, "id bigint, part int, content string")
