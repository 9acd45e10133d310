"""Notebooks: nbformat JSON, and Markdown with a Jupytext header."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_LINES = 30
_CELLS = "struct<cells:array<struct<cell_type:string,source:string,metadata:string>>>"


def has_jupytext_header(text: str) -> bool:
    """Whether a text begins with a YAML header that names a Jupytext text representation."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return False
    end = next((i for i, line in enumerate(lines[1 : HEADER_LINES + 1], 1) if line.strip() == "---"), None)
    if end is None:
        return False
    try:
        header = yaml.safe_load("\n".join(lines[1:end]))
    except yaml.YAMLError:
        return False
    kind = ((header or {}).get("jupytext") or {}).get("text_representation") if isinstance(header, dict) else None
    return isinstance(kind, dict) and "extension" in kind and "format_name" in kind


def cells_of(text: str) -> list[dict]:
    """cell_type, source and metadata of the cells of an nbformat-4 text, or of Markdown with a Jupytext header: there,
    `+++` divides cells and fences of `code-cell` are code; the header is no cell. [] for a text that is neither."""
    if text.lstrip().startswith("{"):
        try:
            found = json.loads(text).get("cells", [])
        except (json.JSONDecodeError, AttributeError):
            return []
        source = lambda s: "".join(s) if isinstance(s, list) else s or ""
        return [{"cell_type": c.get("cell_type"), "source": source(c.get("source")), "metadata": c.get("metadata", {})} for c in found]
    if not has_jupytext_header(text):
        return []
    lines = text.split("\n")
    body = lines[next(i for i, line in enumerate(lines[1:], 1) if line.strip() == "---") + 1 :]
    out: list[dict] = []
    gathered: list[str] = []

    def close() -> None:
        source = "\n".join(gathered).strip("\n")
        if source:
            out.append({"cell_type": "markdown", "source": source, "metadata": {}})
        gathered.clear()

    i = 0
    while i < len(body):
        fence = re.match(r"^(`{3,})\s*\{?(?:code-cell|code)\b[^\n]*$|^(`{3,})(?:python|r|julia|java|rust)\s*$", body[i])
        if fence:
            close()
            mark = fence.group(1) or fence.group(2)
            end = next((k for k in range(i + 1, len(body)) if body[k].strip() == mark), len(body))
            code = body[i + 1 : end]
            while code and re.match(r"^:[\w-]+:", code[0]):
                code = code[1:]
            out.append({"cell_type": "code", "source": "\n".join(code).strip("\n"), "metadata": {}})
            i = end + 1
        elif body[i].startswith("+++"):
            close()
            i += 1
        else:
            gathered.append(body[i])
            i += 1
    close()
    return out


def cells(notebook: Column) -> Column:
    """cell_type, source, src_checksum, tags of the cells of an nbformat-4 text; a source may be a list of lines."""
    parsed = F.from_json(notebook, _CELLS)["cells"]
    lines = lambda s: F.when(F.startswith(F.trim(s), F.lit("[")), F.array_join(F.from_json(s, "array<string>"), "")).otherwise(s)
    return F.transform(
        parsed,
        lambda c: F.struct(
            c["cell_type"].alias("cell_type"), lines(c["source"]).alias("source"),
            F.get_json_object(c["metadata"], "$.src_checksum").alias("src_checksum"), F.from_json(F.get_json_object(c["metadata"], "$.tags"), "array<string>").alias("tags"),
            F.from_json(c["metadata"], "map<string,string>").alias("metadata"),
        ),
    )


def explode_cells(df: DataFrame, text_column: str, *keep: str) -> DataFrame:
    """A row for each cell: cell_index (from 1), cell_type, source, src_checksum, tags and its plain metadata as a map."""
    rows = df.select(*keep, F.posexplode(cells(F.col(text_column))).alias("pos", "cell"))
    return rows.select(*keep, (F.col("pos") + 1).alias("cell_index"), "cell.*")


def written(cells_: list[dict], metadata: dict | None = None) -> str:
    """An nbformat-4 text of cells, with the notebook's own metadata kept."""
    made = [{"cell_type": c["cell_type"], "metadata": c.get("metadata", {}), "source": c["source"]} | ({"outputs": [], "execution_count": None} if c["cell_type"] == "code" else {}) for c in cells_]
    return json.dumps({"cells": made, "metadata": metadata or {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False)
