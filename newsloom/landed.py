"""Queries over landed files, responses and run logs, each beside its DuckDB SQL.

Files are written from the given tables into the shared work folder by the
library's own sinks (or as a feed would land) and read back by its readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, rules
from newsloom.functions import text as tx
from newsloom.operators import greedy, responses, runlog, sections, vectors
from newsloom.sources import feeds, sinks, workdir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL if SQL can say it."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------- responses


@_query("""
WITH l AS (SELECT conv_id, turn, text, conv_id % 5 = 0 AS plain, CASE WHEN conv_id % 3 = 0 AND conv_id % 5 <> 0 THEN 2 END AS done FROM conversations),
k AS (SELECT * FROM l WHERE CASE WHEN plain THEN coalesce(text, '') <> '' ELSE done IS NULL OR turn < done END),
c AS (SELECT conv_id, bool_or(NOT plain) AS streamed, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE NOT plain), '') AS said, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE plain) AS plain FROM k GROUP BY conv_id)
SELECT d.conv_id AS request_id, coalesce(c.streamed, false) AS streamed, md5(CASE WHEN c.streamed THEN c.said ELSE coalesce(c.plain, 'none') END) AS content FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c USING (conv_id)
""")
def stream_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS02: each conversation as the lines of a streamed (or, every fifth, plain) response."""
    n, turn = F.col("conv_id"), F.col("turn")
    chunk = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(n % 5 == 0, F.col("text")).when((n % 3 == 0) & (turn == 2), F.lit("data: [DONE]")).otherwise(chunk)
    out = responses.reassembled(_table(spark, sf_dir, "conversations").select(n.alias("request_id"), turn.alias("pos"), line.alias("line")))
    return out.select("request_id", "streamed", F.md5(F.coalesce("content", F.lit("none")).cast("binary")).alias("content"))


@_query("""
WITH RECURSIVE n AS (SELECT lang, count(*) AS n0 FROM documents WHERE doc_id % 50 = 0 GROUP BY lang),
i AS (SELECT d.lang, d.doc_id, doc_id % 4 AS act, CASE WHEN doc_id % 8 = 1 THEN doc_id % 90 + 1 ELSE (doc_id // 4) % 9 + 1 END AS k, coalesce(n.n0, 0) AS n0, row_number() OVER (PARTITION BY d.lang ORDER BY doc_id) AS pos FROM documents d LEFT JOIN n USING (lang) WHERE doc_id % 50 <> 0),
r AS (
  SELECT lang, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS made, CAST(-1 AS BIGINT) AS doc_id, false AS new, CAST(0 AS BIGINT) AS number FROM (SELECT DISTINCT lang FROM i)
  UNION ALL
  SELECT i.lang, i.pos, r.made + x.new, i.doc_id, x.new = 1, CASE WHEN x.new = 1 THEN i.n0 + r.made + 1 WHEN i.act = 1 THEN i.k END
  FROM r JOIN i ON i.lang = r.lang AND i.pos = r.pos + 1, LATERAL (SELECT CASE WHEN i.act = 0 OR (i.act = 1 AND i.k > i.n0 + r.made) THEN 1 ELSE 0 END AS new) x
)
SELECT lang AS run_id, CAST(doc_id AS INT) AS item_index, CASE WHEN number IS NULL THEN 'discard' ELSE 'assign' END AS decision, coalesce('evt_20240101_' || lpad(CAST(number AS VARCHAR), 4, '0'), '') AS event_id, new AS created FROM r WHERE pos > 0
""")
def membership_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM08, ID01: documents assigned, created or discarded in order; unknown targets create."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("run_id"), "source", F.substring_index("text", "\n", 1).alias("title"))
    day, n = F.lit("2024-01-01"), F.col("doc_id")
    old = docs.where(n % 50 == 0).withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy("doc_id")))
    items = docs.where(n % 50 != 0).select("run_id", n.cast("int").alias("item_index"), "title", F.col("source").alias("platform"), day.alias("scrape_date"))
    target = F.when(n % 8 == 1, n % 90 + 1).otherwise(F.floor(n / 4) % 9 + 1)
    none = F.lit(None).cast("string")
    said = docs.where(n % 50 != 0).select("run_id", n.cast("int").alias("item_index"), _pick([" Create", "assign", "discard", "maybe"], n % 4).alias("decision"), tx.event_id(day, target).alias("matched_event_id"), none.alias("event_label"), none.alias("event_summary"), F.lit("Model").alias("event_type"), F.array().cast("array<string>").alias("key_entities"), F.lit("80").alias("confidence"), none.alias("reason"))
    out, made, _ = responses.apply_membership(items, old.select("run_id", tx.event_id(day, F.col("nth")).alias("event_id")), said)
    created = made.select("run_id", "event_id", F.col("event_label").alias("l")).withColumn("first", F.lit(True))
    first = out.withColumn("turn", F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy("item_index"))).join(created.drop("l"), ["run_id", "event_id"], "left")
    return first.select("run_id", "item_index", F.col("classification_decision").alias("decision"), F.coalesce("event_id", F.lit("")).alias("event_id"), (F.coalesce("first", F.lit(False)) & (F.col("turn") == 1)).alias("created"))


@_query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS ev, list_cosine_similarity(q.v, e.v) AS s FROM v q JOIN v e ON q.label = e.label AND q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ev) AS rank FROM p)
SELECT query_id, 'evt_' || query_id AS seed, string_agg('evt_' || ev, ',' ORDER BY rank) AS candidates, CAST(sum(ev % 6) AS BIGINT) AS members FROM r WHERE rank <= 5 GROUP BY query_id
""")
def merge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM15, JN04: request rows of every twentieth event and its five nearest of the same label."""
    none = F.lit(None).cast("string")
    fields = {"event_label": F.concat(F.lit("event "), F.col("vec_id").cast("string")), "event_summary": none, "event_type": F.lit("model"), "key_entities": F.array(F.col("label").cast("string")), "member_count": (F.col("vec_id") % 6).cast("int"), "platforms": F.array().cast("array<string>"), "latest_pubtime": none, "first_pubtime": none, "representative_titles": F.array().cast("array<string>")}
    rows = _table(spark, sf_dir, "embeddings").withColumns({"scope": F.col("label"), "event_id": F.concat(F.lit("evt_"), F.col("vec_id").cast("string")), "ordinal": F.col("vec_id"), "at": F.lit("2024-01-01").cast("timestamp"), "vector": F.col("embedding")} | fields)
    seeds = rows.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))
    found = vectors.recall(seeds.select("scope", "query_id", "at", "vector", F.col("event_id").alias("exclude_id")), rows.select("scope", "event_id", "at", "vector", "ordinal"))
    out = responses.requests(seeds, rows, found, responses.EVENT_FIELDS, ("seed_event", "candidate_events"))
    offered = F.from_json(F.get_json_object("request", "$.candidate_events"), "array<struct<event_id:string,member_count:int>>")
    return out.select("query_id", F.get_json_object("request", "$.seed_event.event_id").alias("seed"), F.array_join(F.transform(offered, lambda e: e["event_id"]), ",").alias("candidates"), F.aggregate(F.transform(offered, lambda e: e["member_count"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("members"))


def _label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as events of a run for each label, all of one day."""
    text, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    return _table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("run_id"), F.col("vec_id").cast("int").alias("ordinal"), F.concat(F.lit("evt_"), F.col("vec_id").cast("string")).alias("event_id"), F.concat(F.lit("event "), F.col("vec_id").cast("string")).alias("event_label"), none.alias("event_summary"), F.lit("model").alias("event_type"), text.alias("key_entities"),
        F.lit(1).alias("member_count"), text.alias("platforms"), none.alias("latest_pubtime"), none.alias("first_pubtime"), text.alias("representative_titles"), (F.col("vec_id") % 100 / 100.0).alias("confidence"), F.array(F.col("vec_id").cast("int")).alias("source_news_ids"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.col("embedding").alias("vector"),
    )


_GREEDY = """
WITH RECURSIVE v AS (SELECT CAST(label AS VARCHAR) AS run_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (
  SELECT run_id, list(vec_id ORDER BY vec_id) AS pending, -1 AS idx, CAST([] AS BIGINT[]) AS members FROM v GROUP BY run_id
  UNION ALL
  SELECT run_id, list_filter(pending, lambda x: NOT list_contains(m, x)), idx + 1, m FROM (
    SELECT g.run_id, g.pending, g.idx, list_concat([g.pending[1]], coalesce((SELECT list(b.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id)[1:39] FROM v a JOIN v b ON b.run_id = a.run_id WHERE a.run_id = g.run_id AND a.vec_id = g.pending[1] AND b.vec_id <> a.vec_id AND list_contains(g.pending, b.vec_id)), [])) AS m
    FROM g WHERE len(g.pending) > 0
  )
)
SELECT run_id, CAST(unnest(members) AS VARCHAR) AS key, idx AS group_index, CAST(unnest(generate_series(0, len(members) - 1)) AS INT) AS position FROM g WHERE idx >= 0
"""

_MERGED_GROUPS = _GREEDY[: _GREEDY.rindex("SELECT run_id, CAST(unnest")].rstrip() + """, m AS (SELECT run_id, members FROM g WHERE idx >= 0)
SELECT run_id, 'evt_' || members[1] AS event_id, array_to_string(list_sort(members[1:2]), ',') AS ids FROM m
UNION ALL SELECT run_id, 'evt_' || x, CAST(x AS VARCHAR) FROM (SELECT run_id, unnest(members[3:]) AS x FROM m)
"""
_SEED_MERGES = """
WITH RECURSIVE v AS (SELECT CAST(label AS VARCHAR) AS run_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
  SELECT run_id, vec_id, row_number() OVER (PARTITION BY run_id ORDER BY round, vec_id) AS pos FROM v, generate_series(1, 2) AS x(round) WHERE vec_id % 7 = 0
), r AS (
  SELECT run_id, CAST(0 AS BIGINT) AS pos, list(vec_id) AS alive, CAST([] AS STRUCT(t BIGINT, s BIGINT)[]) AS edges FROM v GROUP BY run_id
  UNION ALL
  SELECT run_id, pos + 1, list_filter(alive, lambda x: NOT list_contains(got, x)), list_concat(edges, list_transform(got, lambda x: {'t': seed, 's': x})) FROM (
    SELECT r.run_id, r.pos, r.alive, r.edges, s.vec_id AS seed, CASE WHEN list_contains(r.alive, s.vec_id) THEN coalesce((
      SELECT list_filter((list(b.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id))[1:5], lambda x: (x - s.vec_id) % 10 = 0 AND x - s.vec_id >= 10 AND x - s.vec_id <= 120)
      FROM v a JOIN v b ON b.run_id = a.run_id WHERE a.run_id = r.run_id AND a.vec_id = s.vec_id AND b.vec_id <> a.vec_id AND list_contains(r.alive, b.vec_id)), []) ELSE [] END AS got
    FROM r JOIN s ON s.run_id = r.run_id AND s.pos = r.pos + 1
  )
), e AS (
  SELECT run_id, unnest(arg_max(edges, pos)) AS x FROM r GROUP BY run_id
), c AS (
  SELECT run_id, vec_id, vec_id AS root FROM v UNION ALL SELECT c.run_id, c.vec_id, e.x.t FROM c JOIN e ON e.run_id = c.run_id AND e.x.s = c.root
)
SELECT run_id, 'evt_' || root AS event_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids FROM c WHERE (run_id, root) NOT IN (SELECT (run_id, x.s) FROM e) GROUP BY run_id, root
"""


@_query(_SEED_MERGES)
def seed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM09, EM10: two rounds in which every seventh event takes, of ids next to its own, those it is offered."""
    events = _label_events(spark, sf_dir)
    n = F.col("ordinal")
    ids = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda d: F.concat(F.lit("evt_"), (n + d * 10).cast("string")))
    landed = events.where(n % 7 == 0).select("run_id", F.col("event_id").alias("seed_id"), ids.alias("merge_event_ids"), F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    out, _ = responses.seed_merges(events, landed, 5)
    return out.select("run_id", "event_id", F.array_join(F.array_sort("source_news_ids").cast("array<string>"), ",").alias("ids"))


@_query(_MERGED_GROUPS)
def merge_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM16, EM02, EM06, EM07: a label's events in greedy groups of 40, of each group the first two merged."""

    def answer(asked: DataFrame) -> DataFrame:
        events = F.from_json("request", "array<struct<event_id:string>>")
        group = F.struct(F.get(events, 0)["event_id"].alias("target_event_id"), F.array(F.get(events, 1)["event_id"]).alias("source_event_ids"), F.lit(None).cast("string").alias("event_label"), F.lit(None).cast("string").alias("event_summary"))
        return asked.where("size > 1").select("run_id", F.col("group_index").alias("batch_index"), F.array(group).alias("merge_groups"))

    _, merged = responses.merge_layer(_label_events(spark, sf_dir).drop("at"), answer)
    return merged.select("run_id", "event_id", F.array_join(F.col("source_news_ids").cast("array<string>"), ",").alias("ids"))


# ---------------------------------------------------------------- landed files

_CLEAN = "[^A-Za-z0-9 .,&<>]"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a plain title and the time of the event with their id."""
    times = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.timestamp_seconds(F.unix_seconds("ts")).alias("at"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.trim(F.regexp_replace(F.substring(F.substring_index("text", "\n", 1), 1, 80), _CLEAN, "")).alias("title"))
    return docs.join(times, "doc_id").select("*", F.concat(F.lit("https://a.org/x?i="), F.col("doc_id").cast("string"), F.lit("&b=1")).alias("url"))


_ITEMS = f"items AS (SELECT d.doc_id, d.source, trim(regexp_replace(substr(split_part(d.text, chr(10), 1), 1, 80), '{_CLEAN}', '', 'g')) AS title, date_trunc('second', e.ts) AS moment, 'https://a.org/x?i=' || d.doc_id || '&b=1' AS url FROM documents d JOIN events e ON e.event_id = d.doc_id)"


@_query(f"""
WITH {_ITEMS} SELECT source AS platform, title, url, CASE WHEN doc_id % 4 <> 3 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S+00:00') END AS pubtime, '2024-02-02' AS scrape_date FROM items QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20
""")
def rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01, WN01, DT01: a feed folder for each source, read back."""
    n = F.col("doc_id")
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    when = F.when(n % 4 == 0, F.concat(F.lit("<pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"))).when(n % 4 == 1, F.concat(F.lit("<pubDate>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate>"))).when(n % 4 == 2, F.concat(F.lit("<pubDate></pubDate><updated>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</updated>"))).otherwise("")
    lines = _items(spark, sf_dir).select(F.col("source").alias("feed"), n, F.concat(F.lit("<item><title> "), xml(F.col("title")), F.lit(" </title><link>"), xml(F.col("url")), F.lit("</link>"), when, F.lit("</item>")).alias("value"))
    ends = lines.select("feed").distinct().select("feed", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("doc_id"), F.lit("<rss><channel>").alias("value")), F.struct(F.lit(2**62).alias("doc_id"), F.lit("</channel></rss>").alias("value")))).alias("e")).select("feed", "e.*")
    lines = lines.unionByName(ends)
    at = workdir.new_path(spark, "rss")
    lines.repartition("feed").sortWithinPartitions("feed", "doc_id").drop("doc_id").write.mode("overwrite").partitionBy("feed").text(at)
    return feeds.read_rss(spark, at, "2024-02-02", 20)


@_query(f"""
WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM items)
SELECT source AS platform, CAST(pos AS INT) AS pos, title, url, CASE WHEN doc_id % 3 = 0 THEN strftime(moment - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') WHEN doc_id % 3 = 1 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S+00:00') END AS pubtime, '2024-02-02' AS scrape_date FROM r WHERE pos < 50
""")
def hot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03, DT02, WN01: an aggregator file of at most 60 rows for each source, read back."""
    n = F.col("doc_id")
    ranked = _items(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("nth <= 60")
    row = F.struct("nth", F.struct("title", "url", F.when(n % 3 == 0, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("pubDate"), F.when(n % 3 == 1, F.struct((F.unix_seconds("at") * 1000).alias("date"))).alias("extra")).alias("r"))
    files = ranked.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("items"))
    wide = F.when(F.length("source") % 2 == 0, F.to_json(F.struct("items"))).otherwise(F.to_json("items"))
    at = workdir.new_path(spark, "hot")
    files.select("source", wide.alias("value")).write.mode("overwrite").partitionBy("source").text(at)
    return feeds.read_hot_lists(spark, at, "2024-02-02", 50)


@_query(f"""
WITH {_ITEMS} SELECT source AS platform, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE title END AS title, url, CASE WHEN doc_id % 2 = 0 THEN '2024-03-03' ELSE '2024-02-02' END AS scrape_date, CASE WHEN doc_id % 11 = 0 OR title = '' THEN 'title' ELSE '' END AS missing FROM items
""")
def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC02, SRC10, SRC16, FL16: JSON item files of both shapes, read back and checked."""
    n = F.col("doc_id")
    row = F.struct(F.col("source").alias("platform"), F.when(n % 11 == 0, F.lit(" ")).otherwise(F.col("title")).alias("title"), "url", F.when(n % 2 == 0, F.lit("2024-03-03")).alias("scrape_date"))
    files = _items(spark, sf_dir).groupBy(F.floor(n / 50).alias("chunk")).agg(F.collect_list(row).alias("items"))
    at = workdir.new_path(spark, "items")
    files.select(F.when(F.col("chunk") % 2 == 0, F.to_json(F.struct("items"))).otherwise(F.to_json("items")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(at)
    good, bad = feeds.contract(feeds.read_items(spark, at, "2024-02-02"))
    columns = ["platform", "title", "url", "scrape_date"]
    return good.select(*columns, F.lit("").alias("missing")).unionByName(bad.select(*columns, F.array_join("missing", ",").alias("missing")))


@_query("""
WITH t AS (SELECT event_id FROM events ORDER BY ts DESC LIMIT 25) SELECT event_type AS type, count(*) AS entries, count(*) FILTER (WHERE event_id IN (SELECT event_id FROM t)) AS tail FROM events GROUP BY event_type
""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK08, SRC13, SO07: a log appended twice, with lines that are no rows; all of it and its tail."""
    rows = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("type"), "event_id")
    at = workdir.new_path(spark, "log")
    for part in (0, 1):
        sinks.append_log(rows.where(F.col("event_id") % 2 == part), at)
    rows.where("event_id % 100 = 0").select(F.lit("{broken").alias("value")).write.mode("append").text(at)
    schema = "ts string, type string, event_id long"
    tail = feeds.read_log(spark, at, schema, 25).select("event_id", F.lit(1).alias("last"))
    return feeds.read_log(spark, at, schema).join(tail, "event_id", "left").groupBy("type").agg(F.count(F.lit(1)).alias("entries"), F.count("last").alias("tail"))


@_query("SELECT lang AS run_id, doc_id, CASE WHEN lang = 'en' THEN 'again' ELSE source END AS source FROM documents WHERE lang <> 'en' OR doc_id % 2 = 0")
def run_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK01, SNK02: a layer by run, then one run of it written again."""
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), "doc_id", "source")
    at = workdir.new_path(spark, "layer")
    sinks.write_layer(docs, at, ["run_id"])
    sinks.write_layer(docs.where("run_id = 'en' and doc_id % 2 = 0").withColumn("source", F.lit("again")), at, ["run_id"])
    return spark.read.parquet(at)


@_query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY day) SELECT CAST(day AS VARCHAR) AS report_date, (CASE WHEN day = (SELECT min(day) FROM d) THEN 'again ' ELSE 'entries ' END) || n AS document FROM d
""")
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03: a document for each day, then that of the first day written again; the others stay."""
    days = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("report_date")).agg(F.count(F.lit(1)).alias("n"))
    at = workdir.new_path(spark, "documents")
    sinks.write_documents(days.select("report_date", F.concat(F.lit("entries "), F.col("n").cast("string")).alias("document")), at)
    first = days.agg(F.min("report_date").alias("report_date"))
    sinks.write_documents(days.join(first, "report_date").select("report_date", F.concat(F.lit("again "), F.col("n").cast("string")).alias("document")), at)
    return spark.read.text(at).select(F.col("report_date").cast("string").alias("report_date"), F.col("value").alias("document"))


@_query("""
SELECT lang AS run_id, '0-total' AS part, CAST(1 AS BIGINT) AS lines, CAST(count(*) AS VARCHAR) AS total FROM documents GROUP BY lang
UNION ALL SELECT lang, '1-items', count(*), '' FROM documents GROUP BY lang UNION ALL SELECT lang, '2-events', count(*), '' FROM documents WHERE doc_id % 2 = 0 GROUP BY lang UNION ALL SELECT lang, '3-steps', count(DISTINCT source), '' FROM documents GROUP BY lang
""")
def result_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK04: the lines of each run's result envelope."""
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), F.col("doc_id").alias("item_index"), F.col("doc_id").alias("ordinal"), F.col("source").alias("step_id"))
    out = sinks.envelopes(docs.select("run_id", "item_index", "step_id"), docs.where("ordinal % 2 = 0").select("run_id", "ordinal"), docs.select("run_id", "step_id").distinct())
    return out.groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.max(F.get_json_object("row", "$.total")), F.lit("")).alias("total"))


@_query("""
SELECT c_name AS name, CAST(c_custkey % 200 AS VARCHAR) AS ref, '/p/' || s_nationkey AS path, CASE WHEN s_suppkey IS NULL THEN 'skipped: missing_ref' WHEN s_nationkey % 2 = 0 THEN 'published' ELSE 'skipped: source_missing' END AS status
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 200
""")
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK05: customers as targets, suppliers as references, even nations as the files that are there."""
    targets = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 200).cast("string").alias("ref"))
    path = lambda c: F.concat(F.lit("/p/"), F.col(c).cast("string")).alias("path")
    refs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), path("s_nationkey"))
    return sinks.publish_plan(targets, refs, _table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(path("n_nationkey")))


@_query("""
SELECT trim(s_name) AS id, CASE WHEN s_suppkey % 3 = 0 THEN trim(s_name) ELSE 'named ' || s_suppkey END AS name, 'http://s/' || s_suppkey AS url, CASE WHEN s_suppkey % 5 = 0 THEN 'paper' ELSE 'news' END AS content_type
FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey % 7 <> 0 AND s_nationkey % 2 = 0
""")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC09, FL14: source definitions with defaults; enabled ones of the allowed columns without a redirect."""
    n = F.col("s_suppkey")
    raw = _table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_name").alias("id"), F.when(n % 3 != 0, F.concat(F.lit("named "), n.cast("string"))).alias("name"), F.concat(F.lit("http://s/"), n.cast("string")).alias("url"), F.when(n % 4 == 1, False).when(n % 4 == 2, True).alias("enabled"), F.when(n % 5 == 0, "paper").when(n % 5 == 1, "").alias("content_type"))
    more = _table(spark, sf_dir, "supplier").select(F.trim("s_name").alias("id"), F.when(n % 7 == 0, "elsewhere").alias("redirect"), (F.col("s_nationkey") % 2).cast("string").alias("column"))
    rows = feeds.source_rows(raw).join(more, "id")
    return feeds.enabled_sources(rows, ["0"]).select("id", "name", "url", "content_type")


@_query("""
SELECT 'documents' AS dataset, count(*) AS items FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings
""")
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: rows of each table."""
    return runlog.dataset_counts({n: _table(spark, sf_dir, n) for n in ("documents", "pages", "events", "embeddings")})


@_query("""
SELECT lang AS run_id, doc_id, CASE WHEN lang IN ('en', 'de') AND doc_id % 3 = 0 THEN 'snapshot' ELSE 'items' END AS origin FROM documents WHERE lang NOT IN ('en', 'de') OR doc_id % 3 = 0
""")
def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: runs that stopped where they can resume have their snapshot, the others their plain items."""
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), "doc_id")
    stage = F.when(F.col("run_id") == "en", "started").when(F.col("run_id") == "de", "after_clustered_event_extraction").otherwise("done")
    snapshot = docs.where("doc_id % 3 = 0").withColumns({"stage": stage, "origin": F.lit("snapshot")})
    return feeds.resumed(snapshot, docs.withColumn("origin", F.lit("items"))).select("run_id", "doc_id", "origin")


# ---------------------------------------------------------------- run logs

_STATES = ["succeeded", "failed", "queued", "running", "blocked", "skipped", "waiting"]
_TASKS = f"tasks AS (SELECT event_id AS id, ts, CAST(event_id AS VARCHAR) AS task_id, CAST(user_id AS VARCHAR) AS run_id, event_type AS step_id, {_quoted(_STATES)}[(event_id * 13 + user_id) % 7 + 1] AS state FROM events)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        n.cast("string").alias("task_id"), n.alias("id"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step_id"), _pick(_STATES, (n * 13 + F.col("user_id")) % 7).alias("state"), "ts",
        F.when(n % 5 != 0, F.array((n - n % 5).cast("string"), (n * 7).cast("string"))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint of every third task, by its state and time."""
    return _tasks(spark, sf_dir).where("id % 3 = 0").select("run_id", "step_id", "task_id", F.col("state").alias("status"), F.col("ts").alias("finished_at"), F.concat(F.lit("/c/"), F.lpad("task_id", 9, "0")).alias("path"), F.create_map(F.lit("items"), F.concat(F.lit("/i/"), (F.col("id") % 4).cast("string")), F.concat(F.lit("o"), (F.col("id") % 2).cast("string")), F.lit("/o")).alias("output_refs"))


_ROLLED = "CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'blocked') THEN 'blocked' WHEN bool_or(state = 'running') THEN 'running' WHEN bool_or(state IN ('queued', 'waiting')) THEN 'queued' WHEN bool_and(state = 'succeeded') THEN 'succeeded' ELSE 'partial' END"


@_query(f"""
WITH {_TASKS}, s AS (SELECT run_id, step_id, {_ROLLED} AS status, count(*) AS tasks, count(*) FILTER (WHERE state IN ('queued', 'waiting', 'running')) AS active, string_agg(task_id, ',' ORDER BY task_id) FILTER (WHERE state = 'blocked') AS blocked, count(*) FILTER (WHERE state = 'failed') AS failed FROM tasks GROUP BY ALL),
d AS (SELECT run_id, step_id, CAST(id - id % 5 AS VARCHAR) AS dep FROM tasks WHERE id % 5 <> 0 UNION ALL SELECT run_id, step_id, CAST(id * 7 AS VARCHAR) FROM tasks WHERE id % 5 <> 0),
b AS (SELECT d.run_id, d.step_id, string_agg(DISTINCT t.step_id, ',' ORDER BY t.step_id) AS before FROM d JOIN tasks t ON t.task_id = d.dep WHERE t.step_id <> d.step_id GROUP BY ALL),
c AS (SELECT run_id, step_id, '/c/' || lpad(task_id, 9, '0') AS path, state AS last FROM tasks WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY ts DESC, path DESC) = 1)
SELECT s.run_id, s.step_id, s.status, s.tasks, CAST(s.active AS INT) AS active, coalesce(s.blocked, '') AS blocked, CAST(s.failed AS INT) AS failed, coalesce(b.before, '') AS before, coalesce(c.path, '') AS checkpoint_path, coalesce(c.last, '') AS checkpoint_status FROM s LEFT JOIN b USING (run_id, step_id) LEFT JOIN c USING (run_id, step_id)
""")
def step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, AG15, AG23, WN08: steps with status, ids by class, steps before them and their last checkpoint."""
    out = runlog.step_views(_tasks(spark, sf_dir), _checkpoints(spark, sf_dir))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select("run_id", "step_id", "status", "tasks", F.size("active_ids").alias("active"), joined("blocked_ids").alias("blocked"), F.size("failed_ids").alias("failed"), joined("depends_on_steps").alias("before"), F.coalesce("checkpoint_path", F.lit("")).alias("checkpoint_path"), F.coalesce("checkpoint_status", F.lit("")).alias("checkpoint_status"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).groupBy("run_id", "step_id").agg(runlog.rolled_up().alias("status"))


_STEPS = f"steps AS (SELECT run_id, step_id, {_ROLLED} AS status FROM tasks GROUP BY ALL)"
_WORST = "CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'blocked') THEN 'blocked' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'queued') THEN 'queued' WHEN bool_or(status = 'partial') THEN 'partial' WHEN bool_and(status = 'succeeded') THEN 'succeeded' END"


@_query(f"""
WITH {_TASKS}, {_STEPS}, k AS (SELECT run_id, 'buying' AS pipeline_step, step_id, status FROM steps WHERE step_id IN ('buying', 'purchase', 'signup') UNION ALL SELECT run_id, 'looking', step_id, status FROM steps WHERE step_id = 'looking' OR starts_with(step_id, 'cl') OR starts_with(step_id, 'vi')),
g AS (SELECT run_id, pipeline_step, {_WORST} AS status, string_agg(step_id, ',' ORDER BY step_id) AS ids FROM k GROUP BY ALL)
SELECT r.run_id, p.pipeline_step, coalesce(g.status, 'idle') AS status, coalesce(g.ids, '') AS ids FROM (SELECT DISTINCT run_id FROM steps) r CROSS JOIN (SELECT unnest(['buying', 'looking', 'resting']) AS pipeline_step) p LEFT JOIN g USING (run_id, pipeline_step)
""")
def declared_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: status of declared steps by id and by prefix."""
    text = "array<string>"
    declared = spark.range(3).select(_pick(["buying", "looking", "resting"], F.col("id")).alias("pipeline_step"), F.when(F.col("id") == 0, F.array(F.lit("purchase"), F.lit("signup"))).otherwise(F.array().cast(text)).alias("ids"), F.when(F.col("id") == 1, F.array(F.lit("cl"), F.lit("vi"))).otherwise(F.array().cast(text)).alias("prefixes"))
    out = runlog.pipeline_status(_steps(spark, sf_dir), declared)
    return out.select("run_id", "pipeline_step", "status", F.coalesce(F.array_join("step_ids", ","), F.lit("")).alias("ids"))


@_query(f"""
WITH {_TASKS}, {_STEPS}, r AS (SELECT run_id, 'given' AS state FROM tasks GROUP BY run_id UNION ALL SELECT 'empty ' || n_nationkey, 'created' FROM nation),
p AS (SELECT run_id, {_ROLLED} AS derived, count(*) AS tasks, count(*) FILTER (WHERE state IN ('queued', 'waiting', 'running')) AS active, count(*) FILTER (WHERE state = 'blocked') AS blocked FROM tasks GROUP BY run_id),
s AS (SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE status = 'succeeded') AS done FROM steps GROUP BY run_id)
SELECT r.run_id, coalesce(p.derived, r.state) AS state, coalesce(p.tasks, 0) AS tasks, coalesce(s.steps, 0) AS steps, coalesce(s.done, 0) AS done, CAST(coalesce(p.active, 0) AS INT) AS active, CAST(coalesce(p.blocked, 0) AS INT) AS blocked FROM r LEFT JOIN p USING (run_id) LEFT JOIN s USING (run_id)
""")
def run_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, AG18, AG28, SRC15: runs with derived states and summaries; runs without tasks keep their own."""
    tasks = _tasks(spark, sf_dir)
    runs = tasks.select("run_id").distinct().withColumn("state", F.lit("given")).unionByName(_table(spark, sf_dir, "nation").select(F.concat(F.lit("empty "), F.col("n_nationkey").cast("string")).alias("run_id"), F.lit("created").alias("state")))
    out = runlog.run_list(runs, tasks, _steps(spark, sf_dir))
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return out.select("run_id", "state", zero("tasks").alias("tasks"), zero("steps").alias("steps"), zero("steps_succeeded").alias("done"), size("active_ids").alias("active"), size("blocked_ids").alias("blocked"))


@_query(f"""
WITH {_TASKS}, w AS (SELECT *, id % 3 AS key, CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS later FROM tasks WHERE state IN ('queued', 'waiting')),
d AS (SELECT w.task_id, 0 AS pos, CAST(id - id % 5 AS VARCHAR) AS dep FROM w WHERE id % 5 <> 0 UNION ALL SELECT w.task_id, 1, CAST(id * 7 AS VARCHAR) FROM w WHERE id % 5 <> 0),
o AS (SELECT d.task_id, arg_min(d.dep, d.pos) AS dep FROM d JOIN tasks t ON t.task_id = d.dep AND t.state IN ('queued', 'waiting', 'running') GROUP BY d.task_id),
n AS (SELECT id % 3 AS key, count(*) AS running FROM tasks WHERE state = 'running' GROUP BY 1),
k AS (SELECT w.run_id, w.task_id, CASE WHEN later = 1 THEN 'retry_window' WHEN o.dep IS NOT NULL THEN 'dependency' WHEN n.running >= 2 THEN 'concurrency' END AS kind FROM w LEFT JOIN o USING (task_id) LEFT JOIN n USING (key))
SELECT run_id, kind, string_agg(task_id, ',' ORDER BY task_id) AS task_ids FROM k WHERE kind IS NOT NULL GROUP BY ALL
""")
def waiting_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19, JN13: waiting tasks of each run by what they wait for."""
    now = F.lit("2030-01-01").cast("timestamp")
    tasks = _tasks(spark, sf_dir).withColumns({"concurrency_key": (F.col("id") % 3).cast("string"), "max_concurrency": F.lit(2), "next_attempt_at": F.when(F.col("id") % 6 == 0, now + F.expr("INTERVAL 1 HOUR"))})
    return runlog.waiting_groups(runlog.waiting(tasks, now)).select("run_id", "kind", F.array_join("task_ids", ",").alias("task_ids"))


@_query(f"""
WITH {_TASKS} SELECT t.task_id, count(c.task_id) AS checkpoints, coalesce(max('/c/' || lpad(c.task_id, 9, '0')), '') AS latest_path FROM tasks t LEFT JOIN tasks c ON c.task_id = t.task_id AND c.id % 3 = 0 GROUP BY t.task_id
""")
def task_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17: tasks with the number of their checkpoints and the latest path."""
    return runlog.task_checkpoints(_tasks(spark, sf_dir), _checkpoints(spark, sf_dir)).select("task_id", "checkpoints", F.coalesce("latest_path", F.lit("")).alias("latest_path"))


@_query(f"""
WITH {_TASKS}, a AS (SELECT run_id, ts, 'items' AS name, '/i/' || (id % 4) AS path FROM tasks WHERE id % 3 = 0 UNION ALL SELECT run_id, ts, 'o' || (id % 2), '/o' FROM tasks WHERE id % 3 = 0)
SELECT run_id, 'output' AS role, path, name FROM a QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY ts DESC, name DESC) = 1
""")
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, AG26, WN08: artifacts of each run, the last of each role and path."""
    return runlog.artifacts(_checkpoints(spark, sf_dir)).select("run_id", "role", "path", "name")


@_query("""
WITH s AS (SELECT s_suppkey AS source_id, s_suppkey % 5 <> 0 AS enabled, CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE '' END AS redirect FROM supplier),
t AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS state, c_custkey % 2 AS items FROM customer WHERE c_custkey % 4 <> 0)
SELECT source_id, concat_ws(',', CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN redirect <> '' THEN 'redirect' END, CASE WHEN state IS NULL THEN 'no_step' END, CASE WHEN state = 'failed' THEN 'failed' END, CASE WHEN items = 0 THEN 'no_items' END) AS reasons, enabled AND redirect = '' AS active FROM s LEFT JOIN t USING (source_id)
""")
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL20, AG20: why a source gives nothing."""
    n, c = F.col("s_suppkey"), F.col("c_custkey")
    sources = _table(spark, sf_dir, "supplier").select(n.alias("source_id"), (n % 5 != 0).alias("enabled"), F.when(n % 7 == 0, "x").otherwise("").alias("redirect"))
    steps = _table(spark, sf_dir, "customer").where(c % 4 != 0).select(c.alias("source_id"), F.when(c % 3 == 0, "failed").otherwise("succeeded").alias("state"), (c % 2).alias("items"))
    return runlog.source_diagnostics(sources, steps).select("source_id", F.array_join("reasons", ",").alias("reasons"), "active")


@_query("""
SELECT lang AS run_id, count(*) AS items, count(*) FILTER (WHERE doc_id % 2 = 0) AS events, count(*) FILTER (WHERE doc_id % 7 = 0) AS discarded, count(*) FILTER (WHERE doc_id % 900 = 1) AS merged_events FROM documents GROUP BY lang
""")
def classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10: counts of each classify run."""
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), "doc_id")
    return runlog.classify_stats(docs, docs.where("doc_id % 2 = 0"), docs.where("doc_id % 7 = 0"), docs.where("doc_id % 900 = 1"))


@_query("""
WITH c AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 2 AS n FROM supplier), p AS (SELECT c_custkey AS id, c_name AS name, 1 AS n FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(c.id, p.id) AS id, coalesce(c.name, p.name) AS name, CASE WHEN c.n > 0 THEN 'own' WHEN p.n > 0 THEN 'old' ELSE '' END AS tasks FROM c FULL JOIN p ON p.id = c.id
""")
def merged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: steps at hand before persisted ones; an empty list counts as missing."""
    empty = F.array().cast("array<string>")
    now = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 1, F.array(F.lit("own"))).otherwise(empty).alias("tasks"))
    old = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("old")).alias("tasks"))
    return runlog.merge_steps(now, old, ["id"], ["tasks"]).select("id", "name", F.array_join("tasks", ",").alias("tasks"))


@_query("WITH t AS (SELECT user_id, ts, event_type, event_id FROM events) SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, ts) AS state, count(*) AS entries FROM t GROUP BY user_id")
def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR02: the latest state of each run, by the streaming job over a finished log."""
    from newsloom.streaming import jobs

    log = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("state"), "ts")
    return jobs.latest_status(log).select("run_id", "state", "entries")


# ---------------------------------------------------------------- expressions


@_query(rf"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS t, doc_id * 7 % 130 AS raw FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE raw / 1.0 END AS v, trim(regexp_replace(t, '[^A-Za-z0-9 ]', '', 'g')) AS t FROM d)
SELECT doc_id, round(CASE WHEN v IS NULL THEN 0.0 WHEN v <= 1 THEN v WHEN v <= 10 THEN v / 10 WHEN v <= 100 THEN v / 100 ELSE 1.0 END, 6) AS confidence, CASE WHEN v IS NULL THEN 'confidence_missing_or_invalid' WHEN v <= 1 THEN '' WHEN v <= 10 THEN 'confidence_scaled_from_10' WHEN v <= 100 THEN 'confidence_scaled_from_100' ELSE 'confidence_out_of_range' END AS warning,
  round(greatest(0.0, least(100.0, coalesce(v, 0.0) - 20)), 2) AS clamped, md5(CASE WHEN t = '' THEN '该事件缺少标题信息。' ELSE t || '。' END) AS sentence, CASE WHEN t = '' THEN 'none' ELSE t END AS cleaned,
  concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'x' END, nullif(lower(split_part(t, ' ', 1)), '')) AS members, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE lower(split_part(t, ' ', 1)) END AS main, doc_id % 4 AS whole,
  CASE WHEN doc_id % 5 = 0 THEN '2024-01-0' || (doc_id % 9 + 1) ELSE '2024-02-01' END AS report_date, doc_id % 6 IN (4, 5) AS outside, round(CASE WHEN doc_id % 6 IN (4, 5) THEN 40.0 ELSE 8.0 END, 4) AS age
FROM e
""")
def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX09, TX10, TX14, NM01, NM03, EN04, AR03, DT05, DT06, FL13 over every document."""
    n = F.col("doc_id")
    raw = F.when(n % 9 == 0, F.lit("n/a")).otherwise((n * 7 % 130).cast("string"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.substring_index("text", "\n", 1), "[^A-Za-z0-9 ]", "").alias("t"), raw.alias("raw")).withColumn("t", F.trim("t"))
    conf = tx.report_confidence(F.col("raw"))
    members = F.array(F.when(n % 2 == 0, F.lit(" X ")).otherwise(F.lit(" ")), F.substring_index("t", " ", 1))
    day = dates.report_date(F.when(n % 5 == 0, F.concat(F.lit("2024-01-0"), (n % 9 + 1).cast("string"))).otherwise(F.lit("2024-02-01")))
    at = F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval(hours=F.when(n % 6 >= 4, 32).otherwise(0))
    return rows.select(
        "doc_id", F.round(conf["value"], 6).alias("confidence"), F.array_join(conf["warnings"], ",").alias("warning"), F.round(tx.clamp(F.coalesce(F.col("raw").try_cast("double"), F.lit(0.0)) - 20), 2).alias("clamped"), F.md5(tx.ensure_sentence(F.col("t")).cast("binary")).alias("sentence"),
        F.coalesce(tx.clean(F.col("t")), F.lit("none")).alias("cleaned"), F.array_join(tx.lowered_set(tx.clean_list(members)), ",").alias("members"), tx.first_lowered(members).alias("main"), F.get(tx.int_list(F.array(F.lit("no"), (n % 4).cast("string"))), 0).cast("long").alias("whole"),
        day.cast("string").alias("report_date"), dates.outside_window(at, F.lit("2024-02-01").cast("timestamp"), 24).alias("outside"), F.round(dates.age_hours(F.lit("2024-02-01").cast("date"), at), 4).alias("age"),
    )


def _rewrites(column: str, table: list) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k.replace(chr(39), chr(39) * 2)}') THEN {i}" for i, (k, _) in enumerate(table)) + " ELSE -1 END"


@_query(rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9 ]', '', 'g')) AS t FROM documents),
e AS (SELECT *, lower(t || ' ' || {_quoted([k for k, _ in rules.TITLE_REWRITES] + ['nothing'])}[doc_id % {len(rules.TITLE_REWRITES) + 1} + 1]) AS low, lower(t || ' ' || {_quoted([k for k, _ in rules.SUMMARY_REWRITES] + ['nothing'])}[doc_id % {len(rules.SUMMARY_REWRITES) + 1} + 1]) AS sum FROM d),
p AS (SELECT doc_id, regexp_replace(t, ' +', ' ', 'g') AS c, low, sum FROM e)
SELECT doc_id, CAST({_rewrites("low", rules.TITLE_REWRITES)} AS INT) AS title_rule, CAST({_rewrites("sum", rules.SUMMARY_REWRITES)} AS INT) AS summary_rule, rtrim(substr(c, 1, 30)) AS polished, rtrim(substr(c, 1, 25)) AS trend, CAST(CASE WHEN lower(substr(c, 1, 120)) = lower(substr(upper(c), 1, 120)) THEN 2 ELSE 3 END AS INT) AS kept,
  sha256('{{"messages": [{{"content": "' || c || '", "role": "user"}}], "model": "m", "task": "t", "temperature": 0.1}}') AS response_key
FROM p
""")
def wording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX15, TX17, TX18, TX20, TX21, HS02 over the first line of every document."""
    n = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "[^A-Za-z0-9 ]", "")).alias("t"))
    keyed = lambda table: F.concat_ws(" ", "t", _pick([k for k, _ in table] + ["nothing"], n % (len(table) + 1)))
    index = lambda table: F.coalesce(tx.rewrite(keyed(table), [(k, str(i)) for i, (k, _) in enumerate(table)]).cast("int"), F.lit(-1))
    t = tx.compact(F.col("t"))
    said = F.array(F.struct(F.lit("user").alias("role"), t.alias("content")))
    return rows.select(
        "doc_id", index(rules.TITLE_REWRITES).alias("title_rule"), index(rules.SUMMARY_REWRITES).alias("summary_rule"), tx.polish_text(F.col("t"), 30).alias("polished"), tx.trend_text(F.col("t"), 25).alias("trend"),
        F.size(tx.first_by_prefix(F.array(t, F.upper(t), F.concat(F.lit("other "), t)))).alias("kept"), tx.response_key(F.lit("t"), F.lit("m"), F.lit("0.1"), said).alias("response_key"),
    )


# ---------------------------------------------------------------- pages and groups


@_query(f"""
WITH i AS (SELECT doc_id, doc_id // 20 AS page_id, doc_id // 20 % 5 AS kind, trim(regexp_replace(substr(split_part(text, chr(10), 1), 1, 80), '[^A-Za-z0-9.&]+', ' ', 'g')) AS title FROM documents),
u AS (SELECT page_id, kind, title, CASE kind WHEN 0 THEN (CASE WHEN doc_id % 3 = 0 THEN '/policy-x/' ELSE '/news/' END) || (doc_id % 15) ELSE '/papers/' || (doc_id % 15) END AS path, doc_id % 20 AS n FROM i WHERE kind <= 2 AND (kind > 0 OR doc_id % 7 <> 0) AND title <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, path ORDER BY n) AS nth FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM f WHERE nth = 1)
SELECT page_id, pos, 'https://h.org' || path AS url, title, CASE WHEN kind = 2 THEN '' ELSE 'day ' || n END AS published, ['listing', 'structured', 'links'][kind + 1] AS status FROM r
UNION ALL SELECT DISTINCT page_id, -1, '', '', '', CASE WHEN kind = 3 THEN 'blocked' WHEN kind = 4 THEN 'empty' WHEN page_id NOT IN (SELECT page_id FROM r) THEN 'empty' ELSE ['listing', 'structured', 'links'][kind + 1] END FROM i
""")
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC05-SRC08, SRC20, UD01: listing pages, pages with embedded papers, with paper links, blocked and empty ones."""
    n = F.col("doc_id")
    title = F.trim(F.regexp_replace(F.substring(F.substring_index("text", "\n", 1), 1, 80), "[^A-Za-z0-9.&]+", " "))
    rows = _table(spark, sf_dir, "documents").select(n, F.floor(n / 20).alias("page_id"), (F.floor(n / 20) % 5).alias("kind"), title.alias("title"))
    safe = F.replace(F.col("title"), F.lit("&"), F.lit("&amp;"))
    number, day = (n % 15).cast("string"), F.concat(F.lit("day "), (n % 20).cast("string"))
    link = F.concat(F.lit('<div><a class="c" href="'), F.when(n % 3 == 0, "/policy-x/").otherwise("/news/"), number, F.lit('?a=1"><h3> '), safe, F.lit(" </h3>"), F.when(n % 7 != 0, F.concat(F.lit("<time>"), day, F.lit("</time>"))).otherwise(""), F.lit("</a></div>"))
    paper = F.struct(F.struct(number.alias("id"), F.col("title").alias("title")).alias("paper"), day.alias("publishedAt"))
    plain = F.concat(F.lit('<p><a href="/papers/'), number, F.lit('"><b>'), safe, F.lit("</b></a></p>"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c.alias("x")))), lambda v: v["x"])
    pages = rows.groupBy("page_id", "kind").agg(ordered(link).alias("links"), ordered(paper).alias("papers"), ordered(plain).alias("plain"))
    props = F.replace(F.replace(F.to_json(F.struct(F.col("papers").alias("dailyPapers"))), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    body = F.when(F.col("kind") == 0, F.array_join("links", "")).when(F.col("kind") == 1, F.concat(F.lit("<div data-target=\"DailyPapers\" data-props='"), props, F.lit("'></div>"))).when(F.col("kind") == 2, F.array_join("plain", "")).when(F.col("kind") == 3, "Attention: solve the CAPTCHA").otherwise("<p>nothing</p>")
    out = feeds.extract_pages(pages.select("page_id", F.lit("https://h.org/x").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html")))
    none = lambda c: F.coalesce(c, F.lit(""))
    return out.select("page_id", F.coalesce("pos", F.lit(-1)).alias("pos"), F.regexp_replace(none("url"), r"\?a=1$", "").alias("url"), none("title").alias("title"), none("published").alias("published"), "status")


def _label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("run_id"), F.col("vec_id").alias("ordinal"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@_query(_GREEDY)
def greedy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM01, EM02: greedy groups of 40 over the whole run of each label."""
    return greedy.greedy_groups(_label_vectors(spark, sf_dir), 40)


@_query(_GREEDY)
def greedy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM01, EM02: the same groups by speculative rounds over blocks, as runs too large for a task take them."""
    return greedy.greedy_groups(_label_vectors(spark, sf_dir), 40, run_rows=0)


# ---------------------------------------------------------------- small set operations


@_query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST07: the first event of each user."""
    return sections.first_of_id(_table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@_query("SELECT source, doc_id FROM documents ORDER BY source, doc_id OFFSET 25 LIMIT 50")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO04: a page of the ordered documents."""
    return feeds.page_of(_table(spark, sf_dir, "documents").select("source", "doc_id"), [F.col("source"), F.col("doc_id")], 25, 50)


@_query("SELECT lang AS report_date, CAST(doc_id AS VARCHAR) AS event_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0")
def passed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST05: eligible rows that no section took."""
    n = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select(F.col("lang").alias("report_date"), n.cast("string").alias("event_id"), (n % 3 == 0).alias("may_insight"), (n % 5 == 0).alias("should_include_report"))
    return sections.passed_over(rows, "insight").select("report_date", "event_id")


@_query("""
WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS day, split_part(event_type, 'i', 1) || '/' || user_id AS path FROM events), k AS (SELECT 'https://h.org/' || path AS url_key, min(day) AS day FROM e GROUP BY 1) SELECT url_key, CAST(day AS VARCHAR) AS day FROM k
""")
def first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UR02, WN08: the first day of each canonical URL."""
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("https://H.org/"), F.substring_index("event_type", "i", 1), F.lit("/"), F.col("user_id").cast("string"), F.lit("/?q="), F.col("event_id").cast("string")).alias("url"), F.to_date("ts").alias("day"))
    return rows.groupBy(tx.url_key(F.col("url")).alias("url_key")).agg(F.min("day").cast("string").alias("day"))
