"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-news-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that no other run uses; it goes when the application ends."""
    found = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(found)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, lineage cut."""
    at = f"{new_path(df.sparkSession, name)}/table"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
