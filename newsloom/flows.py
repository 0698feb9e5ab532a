"""Queries of streams and keyed tables, each beside its DuckDB SQL.

A stream reads slices of a given table that land one after another in the
shared work folder and runs over all that has landed, so each slice is a run
that takes up the state of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import keyed, workdir
from newsloom.streaming import jobs, online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def _land(rows: DataFrame, folder: str, at: int) -> DataFrame:
    """Land slice ``at`` of ``rows`` (by a column ``slice``) in a folder; the folder as a stream."""
    rows = rows.where(F.col("slice") == at).drop("slice")
    rows.write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


@_query("""
WITH RECURSIVE e AS (SELECT event_id AS vec_id, ts FROM events), i AS (
  SELECT label AS bucket, 'evt_' || vec_id AS name, vec_id, epoch_us(ts) AS t, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END, ts, CAST(vec_id AS VARCHAR)) AS pos FROM embeddings JOIN e USING (vec_id)
), r AS (
  SELECT bucket, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS vec_id, CAST(NULL AS VARCHAR) AS event_id, false AS new, CAST([] AS STRUCT(name VARCHAR, t BIGINT, v DOUBLE[])[]) AS open FROM (SELECT DISTINCT bucket FROM i)
  UNION ALL
  SELECT bucket, pos, vec_id, coalesce(hit.name, own.name), hit IS NULL, CASE WHEN hit IS NULL THEN list_append(open, own) ELSE list_transform(open, lambda x: CASE WHEN x.name = hit.name THEN {'name': x.name, 't': greatest(x.t, own.t), 'v': x.v} ELSE x END) END FROM (
    SELECT i.bucket, i.pos, i.vec_id, r.open, {'name': i.name, 't': i.t, 'v': i.v} AS own,
      list_first(list_sort(list_filter(list_transform(r.open, lambda x, k: {'s': -list_cosine_similarity(x.v, i.v), 'k': k, 'name': x.name, 'near': abs(x.t - i.t) <= 259200000000}), lambda y: y.near AND y.s <= -0.3))) AS hit
    FROM r JOIN i ON i.bucket = r.bucket AND i.pos = r.pos + 1
  )
)
SELECT vec_id, event_id, CASE WHEN new THEN 'create' ELSE 'assign' END AS decision FROM r WHERE pos > 0
""")
def online_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR04: vectors as items by time, each assigned to the nearest open event of its label within 72 hours or opening one; three runs over one state."""
    times = _table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").alias("at"))
    day = F.dayofmonth("at")
    rows = _table(spark, sf_dir, "embeddings").join(times, "vec_id").select(F.col("vec_id").cast("string").alias("item_id"), "at", F.col("label").alias("bucket"), F.col("embedding").cast("array<double>").alias("vector"), F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2).alias("slice"))
    at = workdir.new_path(spark, "online")
    for part in range(3):
        items = _land(rows, f"{at}/in", part)
        with online.rocksdb(spark):
            online.assign_online(items, 0.3).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema("item_id string, event_id string, decision string").parquet(f"{at}/out").select(F.col("item_id").cast("long").alias("vec_id"), "event_id", "decision")


@_query("""
SELECT run_id, CAST(pos AS INT) AS pos, seq, type FROM (
  SELECT user_id % 20 AS run_id, event_id AS seq, event_type AS type, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS back, least(100, count(*) OVER (PARTITION BY user_id % 20)) - row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS pos FROM events
) WHERE back <= 100
""")
def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01: the last 100 entries of each run by event time, from a log that lands in two slices out of order."""
    log = _table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("type"), (F.col("event_id") % 2).alias("slice"))
    at = workdir.new_path(spark, "tails")
    for part in (0, 1):
        rows = _land(log, f"{at}/in", part)
        with online.rocksdb(spark):
            jobs.run_batches(online.log_tails(rows, 100, 60), f"{at}/out", f"{at}/state")
    seen = spark.read.schema("run_id long, pos int, us long, seq long, type string, batch int").parquet(f"{at}/out")
    return jobs.last_batch(seen, ["run_id"]).select("run_id", "pos", "seq", "type")


@_query("""
SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, ts) AS progress_state, count(*) AS entries FROM events GROUP BY user_id
""")
def merged_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR02, STR06: the latest state of each run as a stream of updates merged into a keyed table; the stream stops between a merge and its commit and starts again."""
    log = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("state"), "ts", (F.col("event_id") % 3).alias("slice"))
    at = workdir.new_path(spark, "progress")
    table = keyed.KeyedTable(spark, f"{at}/table", "run_id string, progress_state string, progress_at timestamp, entries long", ["run_id"], "progress_at", 16)
    for part in range(3):
        latest = jobs.folded_progress(jobs.latest_status(_land(log, f"{at}/in", part)), ["state", "at"])
        if part == 1:
            jobs.merge_stream(latest, table, "progress", f"{at}/state", stop_after_merge=True)
        jobs.merge_stream(latest, table, "progress", f"{at}/state")
    return table.read().select("run_id", "progress_state", "entries")


@_query("""
WITH e AS (
  SELECT 'https://h.org/' || event_type || '/' || user_id AS url_key, ts, event_id, CASE WHEN event_id % 10 = 0 THEN 2 WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS slice FROM events
), s AS (
  SELECT url_key, slice, arg_max(ts, event_id % 97 * 10000000000 + event_id) AS t FROM e GROUP BY url_key, slice
), w AS (
  SELECT max(t) FILTER (WHERE slice = 0) - INTERVAL 72 HOUR AS w1, max(t) FILTER (WHERE slice <= 1) - INTERVAL 72 HOUR AS w2 FROM s
), a AS (
  SELECT url_key, t FROM s WHERE slice = 0
), b AS (
  SELECT url_key, t FROM s, w WHERE slice = 1 AND t > w1 AND url_key NOT IN (SELECT url_key FROM a, w WHERE t + INTERVAL 72 HOUR > w1)
), c AS (
  SELECT url_key, t FROM s, w WHERE slice = 2 AND t > w2 AND url_key NOT IN (SELECT url_key FROM (SELECT * FROM a UNION ALL SELECT * FROM b), w WHERE t + INTERVAL 72 HOUR > w2)
)
SELECT url_key, strftime(t, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
""")
def streamed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR05: the first item of each canonical URL within 72 hours, over three landings; rows behind the watermark are late, and a URL comes again when its horizon is over."""
    day, n = F.dayofmonth("ts"), F.col("event_id")
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("https://H.org/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("/?q=1")).alias("url"), "ts", n, F.when(n % 10 == 0, 2).when(day <= 10, 0).when(day <= 20, 1).otherwise(2).alias("slice"))
    rows = rows.groupBy("url", "slice").agg(F.max_by("ts", n % 97 * 10_000_000_000 + n).alias("at"))
    at = workdir.new_path(spark, "urls")
    for part in range(3):
        items = _land(rows, f"{at}/in", part)
        with online.rocksdb(spark):
            jobs.run_batches(jobs.first_of_url(items), f"{at}/out", f"{at}/state", "append")
    seen = spark.read.schema("url string, at timestamp, url_key string, batch int").parquet(f"{at}/out")
    return seen.select("url_key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@_query("""
WITH d AS (SELECT sha256('m' || chr(10) || split_part(coalesce(text, ''), chr(10), 1)) AS cache_key, doc_id FROM documents),
u AS (SELECT cache_key, doc_id, 1 AS turn FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT cache_key, doc_id, 2 FROM d WHERE doc_id % 3 = 0)
SELECT cache_key, doc_id AS created_at, CAST(turn AS INT) AS turn FROM u QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY turn DESC, doc_id DESC) = 1
""")
def cache_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06, SNK07, WN08: a keyed table updated twice and read back."""
    key = F.sha2(F.concat(F.lit("m\n"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).cast("binary"), 256)
    docs = _table(spark, sf_dir, "documents").select(key.alias("cache_key"), F.col("doc_id").alias("created_at"))
    table = keyed.KeyedTable(spark, f"{workdir.new_path(spark, 'cache')}/table", "cache_key string, created_at long, turn int", ["cache_key"], "created_at", 32)
    for turn, step in ((1, 2), (2, 3)):
        table.upsert(docs.where(F.col("created_at") % step == 0).withColumn("turn", F.lit(turn)))
    return table.read()
