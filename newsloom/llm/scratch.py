"""Shared scratch space for intermediate tables.

A step that is read more than once, or that ends a loop round, is written as
Parquet under the folder that ``spark.checkpoint.dir`` names.  Every executor
sees that folder, so the table survives the loss of any of them.  A table goes
when its operator has no more use for it, the others when the application
ends.  Only in local mode, where driver and executors share one machine, a
folder of our own is used if the setting is missing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Bytes of one Arrow batch on its way to Python, if the session has Spark's own value: texts may be long.
BATCH_BYTES = 8 << 20
#: Partial results that one task adds up, on average.
FAN_IN = 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode a temporary one if none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-newsloom-")
    return _OWN[app]


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session's owner has set a bound."""
    if spark.conf.get(_BATCH, "64MB") in ("67108864b", "64MB"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def added_up(parts: DataFrame, add, schema: str) -> DataFrame:
    """One row from partial results, by ``add`` over record batches, in a tree: ``FAN_IN`` of them at a time, about."""
    left = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4
    while left > 1:
        parts = parts.repartition(left).mapInArrow(add, schema)
        left //= FAN_IN
    return parts.repartition(1).mapInArrow(add, schema)


class Scratch:
    """Named tables of one operator run inside the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.used = 0
        small_batches(spark)
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)

    def path(self, name: str) -> str:
        """A new path under this run's folder."""
        self.used += 1
        return f"{self.root}/{self.used:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it read back, with its lineage cut."""
        at = self.path(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files behind tables that nothing will read again."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                at = jvm.org.apache.hadoop.fs.Path(f)
                at.getFileSystem(conf).delete(at, True)
