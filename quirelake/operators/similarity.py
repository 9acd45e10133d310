"""Best match of a text among stored texts, by the ratio of difflib's SequenceMatcher (stored text first).

A stated set of queries is compared with all candidates of its group (a file), in cells of bounded size: the candidates
of a group are divided into parts and its queries into blocks, as many as their counted numbers need, and every block
meets every part.  So a group of any size is spread over many tasks, none of which holds more than a part and a block; of
each query only the best of every part is kept and the best of those is taken.

Within a cell, pairs are compared by length and by character counts first, and matched, those that may be the most alike
first, only as far as they can still win; this drops no pair that could.  Cells are worked out in Java (`BestOf.java`),
with difflib's own steps, since difflib itself takes more than a millisecond a pair.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.runtime import java_object

#: An example is used only if its score is above this.
EXAMPLE_THRESHOLD = 0.7


def ratio(stored: str, query: str) -> float:
    return SequenceMatcher(None, stored, query).ratio()


#: texts of a part of the candidates and of a block of the queries, about
PART, BLOCK = 512, 128


def _best_of(spark, *args: Column | str) -> Column:
    """The numbers of queries and their best candidates, with scores, in a cell (see `BestOf.java`)."""
    kind = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("array<struct<query: int, candidate: int, score: double>>")
    function = spark._jvm.org.apache.spark.sql.functions.udf(java_object(spark, "quirelake.BestOf", os.path.join(os.path.dirname(__file__), "BestOf.java")), kind)
    columns = [(F.col(a) if isinstance(a, str) else a)._jc for a in args]
    return Column(function.apply(spark.sparkContext._jvm.PythonUtils.toSeq(columns)))


def best_matches(queries: DataFrame, candidates: DataFrame, threshold: float = 0.0, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, checksum, score of the best candidate of the same group above the threshold.

    queries: grp, query_id, text, own (a checksum that does not count, or null); candidates: grp, checksum, text (a checksum once a group)."""
    # new names on one side, as both sides may come from one table
    own = candidates.where("text is not null").select(F.col("grp").alias("c_grp"), F.col("checksum").alias("c_checksum"), F.col("text").alias("c_text"))
    own = own.dropDuplicates(["c_grp", "c_checksum"])
    asked = queries.where("text is not null").select("grp", "query_id", "text", "own")
    sizes = (
        asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"))
        .join(own.groupBy(F.col("c_grp").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / part).alias("n_parts")), "grp")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asked = asked.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("n_blocks"))).withColumn("part", every("n_parts"))
    c_sizes = sizes.select(F.col("grp").alias("c_grp"), "n_blocks", "n_parts")
    own = own.join(c_sizes, "c_grp").withColumn("c_part", F.pmod(F.xxhash64("c_checksum"), F.col("n_parts"))).withColumn("c_block", every("n_blocks"))
    asked, own = asked.select("grp", "part", "block", "query_id", "text", "own"), own.select("c_grp", "c_part", "c_block", "c_checksum", "c_text")

    asked = asked.groupBy("grp", "part", "block").agg(F.collect_list(F.struct("query_id", "text", "own")).alias("queries"))
    own = own.groupBy("c_grp", "c_part", "c_block").agg(F.collect_list(F.struct(F.col("c_text").alias("text"), F.col("c_checksum").alias("checksum"))).alias("candidates"))
    same = (F.col("grp") == F.col("c_grp")) & (F.col("part") == F.col("c_part")) & (F.col("block") == F.col("c_block"))
    cells = asked.join(own, same)
    found = _best_of(cells.sparkSession, "queries.text", "queries.own", "candidates.text", "candidates.checksum", F.lit(float(threshold)))
    cells = cells.select("queries", "candidates", F.explode(found).alias("hit"))
    cells = cells.select(F.get("queries", "hit.query")["query_id"].alias("query_id"), F.get("candidates", "hit.candidate")["checksum"].alias("checksum"), "hit.score")
    # the best score; among equals the smallest checksum
    best = cells.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "checksum")).alias("best"))
    return best.select("query_id", "best.checksum", (-F.col("best.minus")).alias("score"))


def differences(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs with `score`, the ratio of two text columns."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn("score", scored(F.col(left), F.col(right)))
