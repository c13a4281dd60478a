"""Shared tables that cut lineage: Parquet in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or of SparkContext.setCheckpointDir(); on one machine, where neither is set, one of our own."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='stemma-')}"
        path = _own[context.applicationId]
    return path.rstrip("/")


#: Bytes of text that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes, not by rows alone, so that long texts need no more memory.

    Results are lazy, so the setting has to stay on the session; a bound that the user has set is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf._jconf.contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/stemma/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete all that operators have stored in this application: call it when their results have been written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it survives lost executors, and nothing upstream runs twice."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df_columns: list[str], stem: str) -> str:
    """A column name that the input does not have."""
    taken, name = {c.lower() for c in df_columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
