"""The wide CSV form of the memory, a column per language, at the edge of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "path_checksum"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a correspondence CSV with `ord`, their place in it; empty cells are '', a missing key column too."""
    rows = spark.read.csv(path, header=True)
    names = rows.columns
    # the file's name first, then the place in the file: parts of one file are numbered in order, whatever is read beside
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(place.alias("ord"), *names)
    rows = rows if KEY in names else rows.withColumn(KEY, F.lit(""))
    return rows.select("ord", *(F.coalesce(c, F.lit("")).alias(c) for c in rows.columns if c != "ord"))


def write_csv(wide: DataFrame, path: str, languages: Sequence[str]) -> None:
    """Writes a new directory; never the one that is being read."""
    there = [F.coalesce(c, F.lit("")).alias(c) if c in wide.columns else F.lit("").alias(c) for c in (KEY, *languages)]
    wide.select(*there).write.mode("errorifexists").csv(path, header=True, emptyValue="")


def read_vocabulary(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """term_no, src, tgt of a vocabulary CSV; no rows if it lacks one of the languages."""
    rows = spark.read.csv(path, header=True)
    if source not in rows.columns or target not in rows.columns:
        return spark.createDataFrame([], "term_no bigint, src string, tgt string")
    return rows.select(F.monotonically_increasing_id().alias("term_no"), F.col(source).alias("src"), F.col(target).alias("tgt"))
