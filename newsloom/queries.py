"""Queries of the news engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import flows, landed, oracle, report_queries
from newsloom.functions import dates
from newsloom.functions import text as tx
from newsloom.operators import enrich, evidence, fold, greedy, runlog, sections, vectors
from newsloom.plans import news_view, report
from newsloom.sources import feeds, workdir
from newsloom.streaming import jobs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # the event log's times carry no zone: they are UTC
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL01, FL03, SC01-SC07, SO01, SRC11, JN01, NM01, DT06: the scored top of each day."""
    return report.flagship(spark, sf_dir)


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX01-TX05, TX07, TX08, TX19, TX24 over every document."""
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.normal_title(t).cast("binary")).alias("title_md5"), F.md5(tx.compact(t).cast("binary")).alias("compact_md5"), tx.mojibake(t).alias("mojibake"), tx.mostly_english(t).alias("english"), tx.quality(t).alias("quality"), tx.short_sentence(t, F.lit("none")).alias("short"), tx.has_any(t, ["license", "secret", "token"]).alias("keyword"), tx.token_estimate(t).alias("tokens"),
    )


def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX11, AG06: distinct tokens of every document, and the title key of its first line."""
    title = F.substring_index("text", "\n", 1)
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens"), F.array_join(F.slice(F.array_sort(tx.tokens(title)), 1, 8), " ").alias("title_key"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UR01-UR03, WN07: hosts and keys of every page, and whether it is the first of its key."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", tx.host(F.col("url")).alias("host"), tx.netloc(F.col("url")).alias("netloc"), tx.url_key(F.col("url")).alias("url_key"), tx.official(tx.host(F.col("url"))).alias("official"))
    first = pages.groupBy("url_key").agg(F.min("page_id").alias("first_id"))
    return pages.join(first, "url_key").select("page_id", "host", "netloc", "url_key", "official", (F.col("page_id") == F.col("first_id")).alias("is_first"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT01-DT04: five written forms of each event time read back."""
    ts, form = F.col("ts"), F.col("event_id") % 5
    secs = F.unix_seconds(ts)
    whole = F.timestamp_seconds(secs)
    written = F.when(form == 0, secs.cast("string")).when(form == 1, (secs * 1000).cast("string")).when(form == 2, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 3, F.date_format(whole, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("Mon, "), F.date_format(whole, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    return _table(spark, sf_dir, "events").select("event_id", F.unix_seconds(dates.first_date(F.lit(None).cast("string"), written)).alias("read_seconds"), form.alias("form"))


def source_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN01, SRC04, ST01: at most 20 rows of each source, cached ones where no live row is."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("platform"), "doc_id")
    number = F.regexp_extract("platform", r"(\d+)$", 1).cast("int")
    live, cached = docs.where(number % 3 != 0), docs
    asked = docs.select("platform").distinct()
    rows, _ = feeds.live_or_cached(live.withColumn("origin", F.lit("live")), cached.withColumn("origin", F.lit("cache")), asked)
    return feeds.capped(rows, ["platform"], F.col("doc_id"), 20)


def item_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG01, AR01: items folded into their events."""
    items = news_view.items(spark, sf_dir).select("event_id", "platform", "title", "item_index", dates.parse_iso(F.col("pubtime")).alias("pubtime"), F.col("item_index").alias("pos"))
    out = fold.fold_items(items, ["event_id"])
    return out.select("event_id", F.array_join("platforms", ",").alias("platforms"), F.array_join("representative_titles", "|").alias("titles"), F.array_join(F.col("source_news_ids").cast("array<string>"), ",").alias("ids"), F.col("member_count").cast("long").alias("member_count"), "first_pubtime", "latest_pubtime")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as claims: a user's run, its hour a batch, its value an item."""
    rows = _table(spark, sf_dir, "events")
    return rows.select((F.col("user_id") % 7).cast("string").alias("run_id"), F.hour("ts").alias("batch_index"), F.col("user_id").alias("event_pos"), F.col("event_id").alias("pos"), (F.col("event_id") * F.col("event_id") % 2003).cast("int").alias("item_index"))


def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN02, WN03, JN05: the first event to claim an item has it; events with items are numbered."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("item_index"))
    items = docs.crossJoin(F.broadcast(spark.range(7).select(F.col("id").cast("string").alias("run_id"))))  # seven fixed rows
    first = fold.first_claims(_claims(spark, sf_dir), items)
    numbers = fold.numbered_events(first)
    return first.join(numbers, ["run_id", "batch_index", "event_pos"]).select("run_id", "item_index", "batch_index", "event_pos", "number")


def omitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN06: documents that no claim names."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("r").alias("run_id"), F.col("doc_id").cast("int").alias("item_index"), F.col("source").alias("platform"), F.lit("").alias("title"))
    first = _claims(spark, sf_dir).select(F.lit("r").alias("run_id"), "item_index").distinct()
    return fold.omitted(docs, first, first.limit(0)).select("item_index", "platform", "stage")


def _dated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts")
    rows = _table(spark, sf_dir, "embeddings").join(times, "vec_id", "left")
    return rows.select("vec_id", F.when(F.col("vec_id") % 17 != 0, F.col("ts")).alias("at"), F.col("embedding").alias("vector"))


def similarity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN03, JN04, SO02, NM04: the 5 nearest vectors within 72 hours of every 20th one."""
    rows = _dated_vectors(spark, sf_dir)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "at", "vector", F.col("vec_id").cast("string").alias("exclude_id"))
    events = rows.select(F.col("vec_id").cast("string").alias("event_id"), "at", "vector", F.col("vec_id").alias("ordinal"))
    return vectors.recall(queries, events).select("query_id", F.col("rank").cast("int").alias("rank"), "event_id", F.round("similarity", 6).alias("similarity"))


def undated_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN03, SO02: the 5 nearest of all vectors without a time, for every 20th one, by pivot cells of 200 events."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.lit(None).cast("timestamp").alias("at"), F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "at", "vector", F.col("vec_id").cast("string").alias("exclude_id"))
    events = rows.select(F.col("vec_id").cast("string").alias("event_id"), "at", "vector", F.col("vec_id").alias("ordinal"))
    return vectors.nearest_anytime(queries, events, 5, 200).select("query_id", F.col("rank").cast("int").alias("rank"), "event_id", F.round("similarity", 6).alias("similarity"))


def greedy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM01, EM02: greedy groups of 40 within label and coarse bucket."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("run_id"), vectors.coarse_bucket(F.col("embedding"), 4).alias("bucket"), F.col("vec_id").alias("ordinal"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return greedy.greedy_groups(rows, 40, ["run_id", "bucket"])


def entity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN04: per day one document of each leading word, then the first 10."""
    rows = news_view.items(spark, sf_dir).select("report_date", "event_id", F.col("item_index").alias("place"), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("main_entity"), F.length("text").cast("double").alias("scores_top_news"), F.lit(0.0).alias("final_score"), F.lit(0.0).alias("importance_score"), F.lit(0.0).alias("source_score"))
    out = sections.one_per_entity(rows, "top_news", 10)
    return out.select(F.col("report_date").cast("string").alias("report_date"), F.col("position").cast("int").alias("position"), F.col("place").cast("int").alias("item_index"), "main_entity")


def section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC09, SC11, AR02, WN05, WN06: the selected events of each day."""
    return report.section_table(spark, sf_dir)


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN09, TX13, TX16, AG05, RP05: evidence of the selected events."""
    return report.evidence_table(spark, sf_dir)


def daily_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP01, RP02, AG08: the public document of each day."""
    return report.daily_documents(spark, sf_dir)


def debug_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RP03: the debug document of each day."""
    return report.debug_documents(spark, sf_dir)


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG08: the four most common topics of each day, ties by first seen."""
    rows = news_view.events(spark, sf_dir).select("report_date", "ordinal", tx.report_type(F.col("event_type")).alias("topic"))
    per = rows.groupBy("report_date", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("report_date").orderBy(F.desc("n"), "seen"))
    return per.withColumn("rank", rank).where("rank <= 4").select(F.col("report_date").cast("string").alias("report_date"), "rank", "topic", "n")


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC05-SRC08, SRC20, UD01: rows extracted from every page and its status."""
    out = feeds.extract_pages(_table(spark, sf_dir, "pages"))
    return out.groupBy("page_id").agg(F.max("status").alias("status"), F.count("pos").alias("rows"))


def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX12, TX13: readable text of every page."""
    text = evidence.readable_text(F.col("html"), F.lit("text/html"))
    return _table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HS01, JN07, EM03, SNK06, SNK07, WN08: documents by cache key, those of even ids being cached."""
    work = _table(spark, sf_dir, "documents").select("doc_id", tx.vector_key(F.lit("m"), F.substring_index("text", "\n", 1)).alias("cache_key"))
    cache = vectors.upsert(work.limit(0).select("cache_key", F.col("doc_id").alias("created_at")), work.where("doc_id % 2 = 0").select("cache_key", F.col("doc_id").alias("created_at")))
    hits, misses = vectors.cache_lookup(work, cache)
    return hits.select("doc_id", "cache_key", "created_at").unionByName(misses.select("doc_id", "cache_key", F.lit(-1).cast("long").alias("created_at")))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as tasks: the user's group, states by type and id."""
    states = ["succeeded", "failed", "queued", "running", "blocked", "skipped", "waiting"]
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("task_id"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("step_id"), F.element_at(F.array(*[F.lit(s) for s in states]), ((F.col("event_id") * 13 + F.col("user_id")) % 7 + 1).cast("int")).alias("state"),
        F.when(F.col("event_id") % 5 != 0, F.array((F.col("event_id") - F.col("event_id") % 5).cast("string"), (F.col("event_id") * 7).cast("string"))).otherwise(F.array().cast("array<string>")).alias("depends_on"), F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string")).alias("task_group_id"),
        F.when(F.col("event_id") % 4 == 0, (F.col("event_id") / 2).cast("long").cast("string")).alias("parent_task_id"), "ts",
    )


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11-AG13: state totals of each group."""
    out = runlog.status_summary(_tasks(spark, sf_dir), ["task_group_id"])
    return out.select("task_group_id", "total", F.to_json("by_state").alias("by_state"), "active", "terminal", "succeeded", "failed", "blocked")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, AG17: rolled-up state of each run and step."""
    return _tasks(spark, sf_dir).groupBy("run_id", "step_id").agg(runlog.rolled_up().alias("status"), F.count(F.lit(1)).alias("tasks"))


def dependency_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13: the first dependency that blocks each task."""
    return runlog.dependency_blocks(_tasks(spark, sf_dir))


def task_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15, JN16: dependents, children and group members of each task."""
    return runlog.relatives(_tasks(spark, sf_dir))


def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN09: entries of each user in order, with the seconds since the one before."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in [*runlog.HISTORY, "other.a", "other.b"]]), (F.col("event_id") % 13 + 1).cast("int"))
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), kinds.alias("type"))
    return runlog.attempt_history(log).select("task_id", "seq", "type", F.col("nth").cast("int").alias("nth"), F.coalesce("since", F.lit(-1)).alias("since"))


def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL15: documents of a language whose row holds a keyword in any case."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return feeds.lookup_rows(docs, {"lang": "en"}, "LICENSE").select("doc_id", "source")


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST02, ST06: suppliers as own rows over customers as the seed, then an upsert."""
    seed = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    own = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("nation"))
    merged = feeds.merged_sources(seed, own)
    return feeds.upsert_sources(merged, own.where("id % 3 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"), F.coalesce("nation", F.lit(-1)).alias("nation")))


def merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG03, AG04, EM07: events folded along accepted merge edges."""
    events = news_view.events(spark, sf_dir).withColumn("run_id", F.col("report_date").cast("string")).drop("report_date")
    events = events.select("run_id", "ordinal", "event_id", "event_label", "event_summary", "event_type", "key_entities", "member_count", "platforms", "latest_pubtime", F.col("latest_pubtime").alias("first_pubtime"), "representative_titles", F.col("confidence").cast("double").alias("confidence"), F.array("ordinal").alias("source_news_ids"))
    group = F.struct(F.concat(F.lit("evt_"), (F.col("ordinal") - F.col("ordinal") % 8).cast("string")).alias("target_event_id"), F.array("event_id").alias("source_event_ids"), F.lit(None).cast("string").alias("event_label"), F.lit(None).cast("string").alias("event_summary"), F.lit("").alias("reason"))
    merges = events.where("ordinal % 8 <> 0").groupBy("run_id", (F.col("ordinal") % 8).alias("batch_index")).agg(F.array_sort(F.collect_list(group)).alias("merge_groups"))
    out, _ = fold.apply_merges(events, merges)
    return out.select("run_id", "event_id", F.size("source_news_ids").alias("members"), F.array_join("platforms", ",").alias("platforms"), "latest_pubtime", F.round("confidence", 6).alias("confidence"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01, STR03: entries by type and 5 minutes, streamed from landed files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source needs a folder: the glob names the one table in it
    log = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")
    counts = jobs.interval_counts(log.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type")))
    at = workdir.new_path(spark, "stream")
    out = jobs.run_counts(counts, f"{at}/out", f"{at}/state")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "type", "entries")


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG07, EN02, EN03, FL02, FL11, AR03: platform weight and kind, and report type, of every event."""
    rows = enrich.with_signals(enrich.candidates(news_view.events(spark, sf_dir), news_view.items(spark, sf_dir).drop("report_date").join(news_view.events(spark, sf_dir).select("event_id", "report_date"), "event_id")))
    return rows.select("event_id", "normalized_event_type", F.array_join("platform_set", ",").alias("platforms"), F.array_max(F.transform("platform_set", tx.platform_weight)).alias("weight"), F.array_contains("kinds", "official").alias("official"), "mismatch")


def _extraction(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as items of a run for each language, and a response for each batch of ids.

    A response names, for every even document, an event of it and its
    neighbour, and discards every seventh document.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    items = docs.select(F.col("lang").alias("run_id"), F.col("doc_id").cast("int").alias("item_index"), F.col("source").alias("platform"), F.substring_index("text", "\n", 1).alias("title"), F.lit("").alias("url"), F.lit(None).cast("string").alias("pubtime"), F.lit("2024-01-01").alias("scrape_date"))
    event = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("Model").alias("event_type"), (F.col("doc_id") % 90 + 10).alias("confidence"), F.array("doc_id", F.col("doc_id") + 1).alias("source_news_ids")))
    out = F.when(F.col("doc_id") % 7 == 0, F.struct(F.col("doc_id").alias("index"), F.lit("off topic").alias("reason")))
    ordered = lambda c, name: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("doc_id", c.alias("x"))))), lambda v: v["x"]).alias(name)
    batches = docs.groupBy(F.col("lang").alias("run_id"), F.floor(F.col("doc_id") / 40).cast("int").alias("batch_index")).agg(ordered(event, "events"), ordered(out, "discards"))
    return items, batches.select("run_id", "batch_index", F.to_json(F.struct("events", "discards")).alias("response"))


def extracted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM05, AG01, AG02, ID01, EN01, NM02, JS01: events folded from extraction responses."""
    _, events, _ = fold.apply_extraction(*_extraction(spark, sf_dir))
    return events.select("run_id", "event_id", F.col("member_count").cast("long").alias("member_count"), F.array_join(F.col("source_news_ids").cast("array<string>"), ",").alias("ids"), F.round("confidence", 6).alias("confidence"), "event_type")


def extraction_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM05, JN06, TX29: discarded and omitted items of the extraction responses."""
    _, _, discards = fold.apply_extraction(*_extraction(spark, sf_dir))
    return discards.select("run_id", "item_index", "stage", "reason")


def item_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM05: the decision and event of every item."""
    items, _, _ = fold.apply_extraction(*_extraction(spark, sf_dir))
    return items.select("run_id", "item_index", "classification_decision", F.coalesce("event_id", F.lit("")).alias("event_id"), F.coalesce("relevance_score", F.lit(-1)).alias("relevance_score"))


_ERRORS = ["", "Read timed out", "HTTP 403 Forbidden", "bad row", "solve the CAPTCHA first"]


def task_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL17, FL21, FL22: retry, blocked and failure flags of every task."""
    rows = _tasks(spark, sf_dir).withColumn("n", F.col("task_id").cast("long"))
    rows = rows.withColumns({"attempt": F.col("n") % 4, "max_attempts": F.col("n") % 3 + 1, "retry_scheduled": F.col("n") % 9 == 0, "error": F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("n") % 5 + 1).cast("int"))})
    retry, blocked, failed = runlog.retry_state(), runlog.blocked_state(F.col("error"), F.when(F.col("n") % 2 == 0, "dependency")), runlog.failure(F.col("error"), F.col("n") % 2 == 0)
    return rows.select("task_id", retry["status"].alias("retry"), retry["remaining"].alias("remaining"), blocked["blocked"].alias("blocked"), blocked["safe_to_skip"].alias("safe_to_skip"), failed["code"].alias("code"), failed["retryable"].alias("retryable"))


def scrape_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: final state of each user's attempts."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    error = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), order.alias("attempt"), (F.col("event_id") % 4 == 0).alias("ok"), error.alias("error"), (F.col("event_id") % 2 == 0).alias("contract"))
    return runlog.scrape_outcomes(rows, 50).select("job_id", "attempts", "state", F.coalesce("code", F.lit("")).alias("code"))


def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG09: events, selected and sourced of each day."""
    return runlog.report_stats(report.assigned(spark, sf_dir)).withColumn("report_date", F.col("report_date").cast("string"))


def polish_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM11: one request for each selected event."""
    rows = report.assigned(spark, sf_dir)
    sources = evidence.select_sources(rows.where("should_include_report"))
    items = sources.withColumns({"text": F.lit(""), "fetched": F.lit(False)})
    return evidence.polish_requests(rows, items).withColumn("report_date", F.col("report_date").cast("string"))


def trend_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM12: one request for each day."""
    return evidence.trend_requests(report.assigned(spark, sf_dir)).withColumn("report_date", F.col("report_date").cast("string"))


QUERIES = (
    flagship, text_rules, token_rules, url_rules, date_forms, source_caps, item_fold, first_claims, omitted_items, similarity_recall, undated_recall, greedy_groups, entity_dedupe, section_table, evidence_table, daily_documents, debug_documents, topic_counts, page_status, readable_pages, cache_lookup,
    group_summary, run_states, dependency_blocks, task_relatives, attempt_history, keyword_lookup, merged_sources, merge_fold, stream_counts, source_scores,
    extracted_events, extraction_discards, item_decisions, task_flags, scrape_outcomes, report_stats, polish_requests, trend_requests,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {q.__name__: q for q in QUERIES} | landed.QUERIES | flows.QUERIES | report_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return oracle.sql() | landed.SQL | flows.SQL | report_queries.SQL | {"section_table": report_queries.SECTION_TABLE, "report_stats": report_queries.REPORT_STATS, "daily_documents": report_queries.DAILY_DOCUMENTS}
