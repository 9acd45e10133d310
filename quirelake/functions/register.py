"""The parsers and scalar tools under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirelake.operators.similarity import ratio
from quirelake.operators.translate import extract, tag
from quirelake.parsers.tables import chunks_of, segments_of


class Segments:
    def eval(self, kind: str, text: str):
        for number, (segment, content) in enumerate(segments_of(kind, text) if text else [], 1):
            yield number, segment, content


class Chunks:
    def eval(self, kind: str, text: str):
        for number, (_, content) in enumerate(chunks_of(kind, text) if text else [], 1):
            yield number, content


def register(spark: SparkSession) -> None:
    """Table functions `segments` and `chunks`, scalar functions `tagged_xml`, `translated_part`, `similarity`."""
    spark.udtf.register("segments", F.udtf(Segments, returnType="seg_index int, kind string, content string"))
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk_index int, content string"))

    @F.pandas_udf("string")
    def tagged_xml(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tag(segments_of(k, t))[0] for k, t in zip(kind, text)], dtype="object")

    @F.pandas_udf("string")
    def translated_part(reply: pd.Series) -> pd.Series:
        return reply.map(lambda r: None if r is None else extract(r))

    @F.pandas_udf("double")
    def similarity(stored: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(stored, query)], dtype="float64")

    for name, function in (("tagged_xml", tagged_xml), ("translated_part", translated_part), ("similarity", similarity)):
        spark.udf.register(name, function)
