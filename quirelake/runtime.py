"""Cutting of lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all machines share.

    Where it is unset, a local master gets a temporary folder, as in tests, removed at the end; on a cluster that is an
    error, since a folder of one machine would be lost with it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="quirelake-")
    atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept as a table of their own in the shared folder.

    A table of columns is smaller than a checkpoint of rows, and what reads it reads only the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_JARS: dict[str, object] = {}


def java_object(spark: SparkSession, name: str, source: str):
    """An instance of the Java class `name`, once for each application.

    The file `source` is compiled by Janino, which Spark brings along for its own generated code; the classes go to the
    executors as a jar of the application."""
    context = spark.sparkContext
    key = f"{context.applicationId} {name}"
    if key not in _JARS:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(context._jsc.sc().getClass().getClassLoader())
        with open(source, encoding="utf-8") as file:
            compiler.cook(file.read())
        folder = tempfile.mkdtemp(prefix="quirelake-")
        atexit.register(shutil.rmtree, folder, True)
        jar = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for entry in compiler.getBytecodes().entrySet():
                out.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        context._jsc.sc().addJar(jar)
        _JARS[key] = compiler.getClassLoader().loadClass(name).newInstance()
    return _JARS[key]
