"""Writers: SNK01-SNK05, SNK08.  Every table is partitioned by its run or date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_layer(df: DataFrame, path: str, by: list[str]) -> None:
    """SNK01-SNK03: a layer's Parquet, only the partitions at hand replaced."""
    df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """SNK03: one text file tree of documents by report date; other dates stay."""
    docs.select("report_date", "document").write.partitionBy("report_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)


def envelopes(items: DataFrame, events: DataFrame, steps: DataFrame) -> DataFrame:
    """SNK04: each run's envelope as rows (run_id, part, pos, row) in JSON: total, then items, events and steps.

    A run may be large, so its envelope is never one row; sorted by part and
    position, its rows are the envelope's lines.
    """
    out = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")).select("run_id", F.lit("0-total").alias("part"), F.lit(0).cast("string").alias("pos"), F.to_json(F.struct("total")).alias("row"))
    for part, df, order in (("1-items", items, "item_index"), ("2-events", events, "ordinal"), ("3-steps", steps, "step_id")):
        pos = F.lpad(F.col(order).cast("string"), 12, "0") if dict(df.dtypes)[order] != "string" else F.col(order)
        out = out.unionByName(df.select("run_id", F.lit(part).alias("part"), pos.alias("pos"), F.to_json(F.struct(*[c for c in df.columns if c != "run_id"])).alias("row")))
    return out


def publish_plan(targets: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """SNK05: what to publish: targets (name, ref), a checkpoint's refs (ref, path), existing files (path)."""
    out = targets.join(refs, "ref", "left").join(files.select("path").withColumn("there", F.lit(True)), "path", "left")
    return out.select("name", "ref", "path", F.when(F.col("path").isNull(), "skipped: missing_ref").when(F.col("there").isNull(), "skipped: source_missing").otherwise("published").alias("status"))


def append_log(df: DataFrame, path: str) -> None:
    """SNK08: rows as JSON lines."""
    df.write.mode("append").json(path)
