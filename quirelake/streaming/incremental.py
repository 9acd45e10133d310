"""Incremental mode: chunks that arrive as files are translated batch by batch, with the memory tables as the state.

Each micro-batch looks its chunks up in the memory as it is, sends what is left to the model once per distinct chunk,
and writes results and new pairs as a version named after the batch.  A batch that is run again after a failure replaces
its own version and nothing else, so every chunk has one result (exactly once per batch).  After every `COMPACT` batches
their pairs are written once more as one table with the newest pair of each key, so that a batch reads that table and a few
batches, however many there were before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators import translate

REQUEST = "chunk_id bigint, path_hash string, chunk_index int, content string, chunk_type string, src_lang string, tgt_lang string"
PAIR = "path_hash string, src_lang string, src_checksum string, tgt_lang string, tgt_checksum string, text string, batch bigint"


#: batches whose pairs are put together
COMPACT = 32
KEY = ["path_hash", "src_lang", "tgt_lang", "src_checksum"]


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    """Numbers of the complete tables `...=number`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def memory_of(spark: SparkSession, memory_dir: str, before: int = 1 << 62) -> DataFrame:
    """The pairs of all batches before one."""
    bases = [n for n in _numbers(spark, f"{memory_dir}/base/upto=*") if n < before]
    upto = bases[-1] if bases else -1
    paths = [f"{memory_dir}/base/upto={upto}"] * bool(bases)
    paths += [f"{memory_dir}/pairs/batch_no={n}" for n in _numbers(spark, f"{memory_dir}/pairs/batch_no=*") if upto < n < before]
    return spark.read.schema(PAIR).parquet(*paths) if paths else spark.createDataFrame([], PAIR)


def newest(pairs: DataFrame) -> DataFrame:
    """One row a key, that of the last batch."""
    last = F.max_by(F.struct("tgt_checksum", "text", "batch"), F.struct("batch", "tgt_checksum")).alias("last")
    return pairs.groupBy(*KEY).agg(last).select(*KEY, "last.*")


def run_batch(batch: DataFrame, number: int, memory_dir: str, caller: translate.Caller) -> None:
    spark = batch.sparkSession
    index = newest(memory_of(spark, memory_dir, number))
    store = index.select("path_hash", F.col("tgt_lang").alias("lang"), F.col("tgt_checksum").alias("checksum"), "text").dropDuplicates(["path_hash", "lang", "checksum"])
    requests = batch.withColumn("src_checksum", F.sha2("content", 256))
    results = translate.translate(requests, index.select(*KEY, "tgt_checksum"), store, caller)
    path = f"{memory_dir}/results/batch_no={number}"
    results.write.mode("overwrite").parquet(path)
    done = spark.read.parquet(path)
    translate.new_pairs(done).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{memory_dir}/pairs/batch_no={number}")
    if (number + 1) % COMPACT == 0:
        newest(memory_of(spark, memory_dir, number + 1)).select(*(p.split()[0] for p in PAIR.split(", "))).write.mode("overwrite").parquet(f"{memory_dir}/base/upto={number}")
    translate.check_fatal(done)


def start(spark: SparkSession, in_dir: str, memory_dir: str, checkpoint_dir: str, caller: translate.Caller, available_now: bool = True) -> StreamingQuery:
    """Translates the parquet files of requests in a directory as they arrive; with available_now, those that are there."""
    stream = spark.readStream.schema(REQUEST).parquet(in_dir)
    writer = stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda df, n: run_batch(df, n, memory_dir, caller))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
