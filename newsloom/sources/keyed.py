"""Keyed tables that are updated in place of being rewritten: SNK06, SNK07, WN08.

A table is a fixed number of buckets by the hash of its key.  An update joins
and rewrites only the buckets that new keys fall into; the files of the others
stay as they are.  A manifest names the folder of every bucket, and its
appearance under the next number is what makes an update visible: a reader
follows the last manifest, so an update that fails half-way leaves the table
as it was.  A manifest also keeps, for each stream that writes, the number of
its last batch: a batch that is run again after a restart changes nothing.
One writer at a time; a second one fails when it writes the same manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """The latest row of each key under ``path``; ``at`` is the column by which the later of two rows is known."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], at: str, buckets: int = 64):
        self.spark, self.path, self.key, self.at, self.buckets = spark, path.rstrip("/"), key, at, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last manifest: version, folder of each bucket, last batch of each stream."""
        at, fs = self._fs(f"{self.path}/manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": {}, "batches": {}}
        source, fs = self._fs(f"{self.path}/manifest/{names[-1]}")
        stream = fs.open(source)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, found: dict) -> None:
        """The manifest under its number; written aside and renamed, so it is there as a whole or not at all."""
        name = f"{self.path}/manifest/{found['version']:010d}.json"
        aside, fs = self._fs(f"{name}.tmp")
        target, _ = self._fs(name)
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            raise FileExistsError(f"another writer made version {found['version']}")

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows, by the last manifest."""
        return self._of(sorted(self.manifest()["buckets"].values()))

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Insert or replace by key; of rows of one key the latest counts, and new before old.

        ``batch``: name of a stream and number of its batch; False, and nothing
        is done, if that batch is in the table already.
        """
        found = self.manifest()
        if batch and found["batches"].get(batch[0], -1) >= batch[1]:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumns({"bucket": bucket, "fresh": F.lit(1)})
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as there are buckets
        version = found["version"] + 1
        if touched:
            old = self._of([found["buckets"][str(b)] for b in touched if str(b) in found["buckets"]]).withColumns({"bucket": bucket, "fresh": F.lit(0)})
            order = Window.partitionBy("bucket", *self.key).orderBy(F.desc("fresh"), F.desc(self.at))
            last = old.unionByName(new).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "fresh")
            last.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        found["version"] = version
        found["buckets"] |= {str(b): f"{self.path}/v{version}/bucket={b}" for b in touched}
        if batch:
            found["batches"][batch[0]] = batch[1]
        self._publish(found)
        return True
