"""Scans and sinks of directories: whole texts, listings, copy plans and target documents."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import document_type, is_under, universal_newlines

SKIPPED_PARTS = ("/.", "/__pycache__/")


def scan_texts(spark: SparkSession, root: str | list[str], pattern: str = "*", base: str | None = None) -> DataFrame:
    """rel_path, doc_type, text of every file under root, or of the files named, with line breaks as in a text-mode read;
    paths are relative to root, or to `base`.

    Files of no bytes have no row (the file source skips them); they would have no chunk either."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    root = os.path.abspath(base or root).rstrip("/")
    path = F.regexp_replace("path", "^file:/*", "/")
    relative = F.when(is_under(path, F.lit(root)), F.substr(path, F.lit(len(root) + 2))).otherwise(path)
    return files.select(relative.alias("rel_path"), document_type(path).alias("doc_type"), universal_newlines(F.decode("content", "utf-8")).alias("text"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path and size of every file under root, without reading any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    root = os.path.abspath(root).rstrip("/")
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.substr(path, F.lit(len(root) + 2)).alias("rel_path"), "length")


def copy_plan(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """The files that are neither ignored themselves nor under an ignored directory (ignored: path).

    Every directory above a file is an equi-join key, so no pairs of files and prefixes are compared."""
    parts = F.split("rel_path", "/")
    above = files.select("rel_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    covered = above.join(ignored.select("path").distinct(), "path", "left_semi").select("rel_path").distinct()
    return files.join(covered, "rel_path", "left_anti")


def extra_files(target: DataFrame, source: DataFrame) -> DataFrame:
    """Files of a target directory that its source does not have."""
    return target.join(source.select("rel_path"), "rel_path", "left_anti")


def copy_files(plan: DataFrame, source: str, target: str) -> int:
    """Copies the planned files, each by the task that has its row (both roots on storage that all executors share)."""

    def copy(batches):
        import pyarrow as pa

        for batch in batches:
            for rel in batch.column(0).to_pylist():
                to = os.path.join(target, rel)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                shutil.copyfile(os.path.join(source, rel), to)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["rel_path"])

    return plan.select("rel_path").mapInArrow(copy, "rel_path string").count()


def write_documents(parts: DataFrame, target: str) -> int:
    """Writes documents from rows (rel_path, part, text): the parts of a file are appended in order by one task."""
    ordered = parts.repartition("rel_path").sortWithinPartitions("rel_path", "part").select("rel_path", "text")

    def write(batches):
        import pyarrow as pa

        seen: set[str] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for rel, text in zip(names, batch.column(1).to_pylist()):
                to = os.path.join(target, rel)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "a" if rel in seen else "w", encoding="utf-8", newline="") as file:
                    file.write(text)
                seen.add(rel)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["rel_path"])

    return ordered.mapInArrow(write, "rel_path string").distinct().count()


def nearest_upwards(start: str, name: str, is_directory: bool = False) -> str | None:
    """The nearest ancestor (or start itself) that holds a file or directory of that name."""
    at = os.path.abspath(start)
    while True:
        found = os.path.join(at, name)
        if os.path.isdir(found) if is_directory else os.path.isfile(found):
            return found
        parent = os.path.dirname(at)
        if parent == at:
            return None
        at = parent
