"""The daily report chain over the news-shaped view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import documents, enrich, evidence, sections
from newsloom.plans import news_view


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all days, scored and verified."""
    # an item's day is its event's day: the neighbour's own time does not matter
    events = news_view.events(spark, sf_dir)
    items = news_view.items(spark, sf_dir).drop("report_date").join(events.select("event_id", "report_date"), "event_id")
    return enrich.enrich(enrich.candidates(events, items))


def flagship(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    """The top of each day's report."""
    rows = sections.report_order(enriched(spark, sf_dir)).where(F.col("place") <= most)
    return rows.select(
        F.col("report_date").cast("string").alias("report_date"), "place", "event_id", "normalized_event_type", "content_layer", "importance_score", "source_score", "freshness_score", "relevance_score", "actionability_score", "novelty_score", "risk_penalty", "final_score",
        "verify_status", "text_quality", F.array_join("platforms", ",").alias("platforms"), F.size("source_items").alias("sources"), "member_count", F.round("confidence", 6).alias("confidence"),
    )


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with tags, section scores, section and place in it."""
    return sections.assign(enriched(spark, sf_dir))


def section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected events of each day and section."""
    out = assigned(spark, sf_dir).where("should_include_report")
    return out.select(F.col("report_date").cast("string").alias("report_date"), "report_section", "position", "event_id", "final_score", F.array_join("report_tags", ",").alias("tags"), *[F.col(f"scores_{s}") for s in ("top_news", "insight", "deep_asset", "watchlist")])


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each selected event from the landed pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # a page stands for the source whose id it has
    landed = pages.select(F.concat(F.lit("https://www.site"), (F.col("page_id") % 50).cast("string"), F.lit(".example.com/a/"), F.col("page_id").cast("string")).alias("url"), "html", F.lit("text/html").alias("content_type"))
    out = evidence.with_evidence(assigned(spark, sf_dir), landed).where("should_include_report")
    return out.select(F.col("report_date").cast("string").alias("report_date"), "event_id", "evidence_strength", "source_agreement", "fetched_source_count", "requested_source_count", F.array_join("domains", ",").alias("domains"), F.array_join("mismatch_flags", ",").alias("flags"), F.size("key_facts").alias("facts"), "one_sentence", "duplicate_key.title_key")


def daily_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public document of each day."""
    return documents.documents(assigned(spark, sf_dir)).withColumn("report_date", F.col("report_date").cast("string"))


def debug_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debug document of each day."""
    return documents.documents(assigned(spark, sf_dir), debug=True).withColumn("report_date", F.col("report_date").cast("string"))
