"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of SparkContext.setCheckpointDir(); on one machine, where neither is set, a temporary one."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='stemma-')}")
    return path.rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows reads the same rows however often it runs, and a lost executor costs one stage."""
    path = f"{shared_folder(df.sparkSession)}/stemma/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
