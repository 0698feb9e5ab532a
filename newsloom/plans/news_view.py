"""A news-shaped view of the driver's tables, the same in Spark and in SQL.

A document is an item; its time is that of the event row with its id.  Two
neighbouring documents share an event, named after the even id.  Types,
confidence and members follow from the id, platforms from the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx

#: Platform of each source number, and event type of each id, in turn.
PLATFORMS = ["openai", "arxiv", "techcrunch-ai", "aibase", "hacker-news", "reddit", "blog-a", "nvidia", "wired", "infoq", "aihot", "blog-b", "huggingface_papers_trending", "reuters", "solidot", "github-trending", "blog-c", "microsoft", "venturebeat", "zhidx"]
TYPES = ["model_release", "Product Launch", "funding", "research", "benchmark", "policy", "tooling", "rumor", "hardware", "open_source", "legal", "partnership", "", "infrastructure", "company_business", "paper", "unheard_of"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_date, item_index, platform, title, url, pubtime, scrape_date, event_id, text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    times = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = docs.join(times, "doc_id")
    key = F.col("doc_id") - F.col("doc_id") % 2
    return rows.select(
        F.to_date("ts").alias("report_date"), F.col("doc_id").cast("int").alias("item_index"), _pick(PLATFORMS, F.regexp_extract("source", r"(\d+)$", 1).cast("int") % len(PLATFORMS)).alias("platform"),
        F.substring(F.substring_index("text", "\n", 1), 1, 90).alias("title"), F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("https://www.site"), (F.col("doc_id") % 50).cast("string"), F.lit(".example.com/a/"), F.col("doc_id").cast("string"))).alias("url"),
        F.when(F.col("doc_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubtime"), F.date_format("ts", "yyyy-MM-dd").alias("scrape_date"), F.concat(F.lit("evt_"), key.cast("string")).alias("event_id"), "text", "doc_id",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_date, ordinal, event_id and the event's fields, one for each even document."""
    rows = items(spark, sf_dir).where("doc_id % 2 = 0")
    return rows.select(
        "report_date", F.col("item_index").alias("ordinal"), "event_id", F.col("title").alias("event_label"), tx.compact_start(F.col("text"), 160).alias("event_summary"), _pick(TYPES, (F.col("doc_id") / 2).cast("int") % len(TYPES)).alias("event_type"),
        tx.leading_words(F.col("text")).alias("key_entities"), (F.col("doc_id") % 6 + 1).cast("int").alias("member_count"), F.when(F.col("doc_id") % 4 == 0, F.array("platform")).otherwise(F.array().cast("array<string>")).alias("platforms"), F.col("pubtime").alias("latest_pubtime"),
        F.array().cast("array<string>").alias("representative_titles"), F.when(F.col("doc_id") % 8 != 2, (F.col("doc_id") % 60 + 45).cast("string")).otherwise("0.95").alias("confidence"), F.array().cast("array<int>").alias("source_news_ids"),
    )
