"""Streaming jobs: STR01-STR03, STR05, STR06.  Each takes and returns a streaming (or static) DataFrame."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.sources.keyed import KeyedTable
from newsloom.sources.workdir import written

LOG = "ts timestamp, type string, run_id string, task_id string, state string, attempt int, error string, reason string"


def log_stream(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """STR01: JSON lines that land in a folder."""
    return spark.readStream.schema(schema).json(path)


def latest_status(log: DataFrame) -> DataFrame:
    """STR02: the latest state of each run (update or complete mode)."""
    return log.groupBy("run_id").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("entries"))


def interval_counts(log: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """STR03: entries by type and interval, closed by a watermark."""
    counts = log.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("type").isin("task.failed", "task.retry_scheduled")).alias("troubles"))
    return counts.select(F.col("window.start").alias("start"), "type", "entries", "troubles")


def first_of_url(items: DataFrame, horizon: str = "72 hours") -> DataFrame:
    """STR05: the first item of each canonical URL within the horizon (items: url, at)."""
    keyed = items.withColumn("url_key", tx.url_key(F.col("url")))
    return keyed.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["url_key"])


def folded_progress(progress: DataFrame, task_columns: list[str]) -> DataFrame:
    """STR06: progress rows beside the task's columns, clashing names prefixed."""
    return progress.select(*[F.col(c).alias(f"progress_{c}" if c in task_columns else c) for c in progress.columns])


def run_batches(rows: DataFrame, out: str, state: str, mode: str = "update") -> None:
    """Run a stream over all that has landed.  Each batch is a folder of its own, so a batch that is run again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def last_batch(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with a ``batch``, those of the last batch of each key."""
    last = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*key, "batch"]).drop("batch")


class Stopped(RuntimeError):
    """A stream that was made to stop between a merge and the commit of its batch."""


def merge_stream(rows: DataFrame, table: KeyedTable, name: str, state: str, stop_after_merge: bool = False) -> None:
    """STR02/STR06: a run over all that has landed, every batch merged into a keyed table exactly once.

    The table keeps the number of the last batch of the stream ``name``, so a
    batch that was merged but not committed is not merged again after a
    restart.  ``stop_after_merge`` makes the stream fail at just that point.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(written(batch, "stream-batch"), (name, number))  # run once and whole, as the stream's own state asks for
        if stop_after_merge:
            raise Stopped(f"batch {number}")

    try:
        rows.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException as failed:
        if not stop_after_merge or "Stopped" not in str(failed):
            raise


def run_counts(counts: DataFrame, out: str, state: str) -> DataFrame:
    """STR03: a run over all that has landed; the last count of every interval, closed by the watermark or not."""
    run_batches(counts, out, state)
    seen = counts.sparkSession.read.schema(counts.withColumn("batch", F.lit(0)).schema).parquet(out)
    last = F.max_by(F.struct("entries", "troubles"), "batch").alias("last")
    return seen.groupBy("start", "type").agg(last).select("start", "type", "last.*")
