"""From event candidates to scored report rows: one narrow chain of expressions.

FL01-FL12, SC01-SC10, TX20-TX23, TX28, AG07.  Candidates carry report_date,
ordinal, event_id, event_label, event_summary, event_type, key_entities,
representative_titles, platforms, member_count, confidence, validation
warnings, latest_pubtime (instant) and source_items
(array of platform, title, url, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, rules
from newsloom.functions import text as tx

SOURCE = "array<struct<platform:string,title:string,url:string,pubtime:string,scrape_date:string,source_news_id:int,classification_decision:string,classification_reason:string>>"


def candidates(events: DataFrame, items: DataFrame) -> DataFrame:
    """SRC11/JN01: events with their items in order; duplicates out, gaps filled from the items.

    ``items`` carry report_date and item_index; an event is found by its id
    within its report date.
    """
    fields = ["platform", "title", "url", "pubtime", "scrape_date", "item_index", "classification_decision", "classification_reason"]
    for f in fields:
        if f not in items.columns:
            items = items.withColumn(f, F.lit(None).cast("int" if f == "item_index" else "string"))
    one = F.struct("item_index", F.struct(*[tx.text_or_empty(F.col(f)).alias(f) if f in ("platform", "title") else F.col(f).alias("source_news_id" if f == "item_index" else f) for f in fields]).alias("s"))
    # scoring costs far more than an event's bytes show: both sides are dealt out in a stated number of tasks, which is not coalesced
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = items.where(F.col("event_id") != "").repartition(tasks, "report_date", "event_id").groupBy("report_date", "event_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).cast(SOURCE).alias("source_items"))
    rows = events.where(~F.coalesce("is_duplicate", F.lit(False))) if "is_duplicate" in events.columns else events
    number = F.col("ordinal").cast("string")
    rows = rows.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), F.concat(F.lit("event_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))))
    out = rows.repartition(tasks, "report_date", "event_id").join(grouped, ["report_date", "event_id"], "left").withColumn("source_items", F.coalesce("source_items", F.array().cast(SOURCE)))
    items_of, conf = F.col("source_items"), tx.report_confidence(F.col("confidence"))
    titles = F.filter(F.transform(F.slice(items_of, 1, 5), lambda s: s["title"]), lambda t: t != "")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(items_of, lambda s: s["platform"]), lambda p: p != "")))
    return out.select(
        "report_date", "ordinal", "event_id", "source_items",
        *[tx.text_or_empty(F.col(c).cast("string")).alias(c) for c in ("event_label", "event_summary", "event_type")],
        F.coalesce(F.nullif(F.col("member_count").cast("int"), F.lit(0)), F.nullif(F.size(items_of), F.lit(0)), F.lit(1)).alias("member_count"),
        F.when(F.size(tx.clean_list(F.col("platforms"))) > 0, tx.clean_list(F.col("platforms"))).otherwise(names).alias("platforms"),
        F.when(F.size(tx.clean_list(F.col("representative_titles"))) > 0, tx.clean_list(F.col("representative_titles"))).otherwise(titles).alias("representative_titles"),
        tx.clean_list(F.col("key_entities")).alias("key_entities"),
        F.when(F.size(tx.int_list(F.col("source_news_ids"))) > 0, tx.int_list(F.col("source_news_ids"))).otherwise(F.transform(items_of, lambda s: s["source_news_id"])).alias("source_news_ids"),
        dates.parse_iso(F.col("latest_pubtime").cast("string")).alias("latest_pubtime"),
        conf["value"].alias("confidence"), conf["warnings"].alias("validation_warnings"),
    )


def possible_mismatch() -> Column:
    """FL02: none of the first five sources' titles holds any longer word of the label."""
    words = F.filter(F.split(F.regexp_replace(F.lower("event_label"), "[-/]", " "), r"(?U)\s+"), lambda w: F.length(w) >= 4)
    titles = F.filter(F.transform(F.slice("source_items", 1, 5), lambda s: F.lower(tx.text_or_empty(s["title"]))), lambda t: t != "")
    hit = F.exists(titles, lambda t: F.exists(words, lambda w: F.contains(t, w)))
    return (F.size(words) > 0) & (F.size(titles) > 0) & ~hit


def with_signals(df: DataFrame) -> DataFrame:
    """Columns that several rules share, each computed once."""
    parts = [F.col("event_label"), F.col("event_summary"), F.col("event_type"), F.array_join("representative_titles", " "), F.array_join("key_entities", " ")]
    df = df.withColumns({"normalized_event_type": tx.report_type(F.col("event_type")), "haystack": F.lower(F.concat_ws(" ", *parts)), "platform_set": tx.lowered_set(F.col("platforms"))})
    hay = F.col("haystack")
    plain = F.lower(F.concat_ws(" ", *parts[:2], *parts[3:]))
    kinds = F.array_distinct(F.transform("platform_set", tx.platform_kind))
    focuses = F.array_compact(F.array(*[F.when(tx.any_in(hay, words), F.lit(name)) for name, words in rules.FOCUS_WORDS.items()]))
    df = df.withColumns({"kinds": kinds, "focuses": focuses, "mismatch": possible_mismatch(), "plain": plain, "layer_text": F.concat_ws(" ", plain, "normalized_event_type")})
    kind = F.col("normalized_event_type")
    paper = F.arrays_overlap("platform_set", F.array(*[F.lit(p) for p in rules.PAPER_PLATFORMS])) | (kind.isin(rules.INSIGHT_TYPES) & tx.any_in(hay, rules.PAPER_SIGNAL_WORDS))
    return df.withColumn("paper_signal", F.coalesce(paper, F.lit(False)))


def content_layer() -> Column:
    """FL01."""
    kind = F.col("normalized_event_type")
    return (
        F.when(kind == "rumor", "noise")
        .when(kind.isin(rules.NEWS_TYPES), "news")
        .when(kind.isin(rules.INSIGHT_TYPES) | tx.any_in(F.col("layer_text"), rules.INSIGHT_WORDS), "insight")
        .when(kind.isin(rules.ASSET_LAYER_TYPES) | tx.any_in(F.col("layer_text"), rules.ASSET_LAYER_WORDS), "deep_asset")
        .otherwise("news")
    )


def _boost(part: str) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.array_contains("focuses", f), v[part]).otherwise(0.0) for f, v in rules.FOCUS_BOOSTS.items()])


def _plus(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def scores() -> dict[str, Column]:
    """SC02-SC08: the components before the paper boosts."""
    kind, hay, n = F.col("normalized_event_type"), F.col("haystack"), F.size("platform_set")
    conf, members, kinds = F.col("confidence"), F.col("member_count"), F.col("kinds")
    importance = tx.lookup(kind, rules.IMPORTANCE, F.lit(rules.IMPORTANCE["unknown"])) + F.when(n >= 2, F.least(F.lit(8.0), n * 3.0)).otherwise(0.0)
    importance = importance + _plus(kind.isin(rules.HIGH_IMPACT_TYPES) & (conf >= 0.9), 5.0) + _plus(members >= 4, 4.0) + _boost("importance") + _plus(F.size("focuses") >= 2, 3.0) - _plus(conf < 0.7, 10.0)
    base = F.coalesce(F.array_max(F.transform("platform_set", tx.platform_weight)), F.lit(25.0))
    single = F.least(base, reduce(lambda a, k: F.when(F.array_contains(kinds, k), rules.SINGLE_CAPS[k]).otherwise(a), reversed(list(rules.SINGLE_CAPS)), F.lit(62.0)))
    several = tx.clamp(base + F.least(F.lit(12.0), (n - 1) * 4.0) + _plus(F.array_contains(kinds, "official"), 4.0))
    source = F.when(F.size("platforms") == 0, 25.0).when(n <= 1, single).otherwise(several)
    age = dates.age_hours(F.col("report_date"), F.col("latest_pubtime"))
    freshness = F.when(F.col("latest_pubtime").isNull(), 20.0).when(age <= 24, 100.0).when(age <= 72, 82.0).when(age <= 168, 62.0).when(age <= 720, 34.0).otherwise(12.0)
    relevance = F.when(tx.any_in(hay, rules.AI_WORDS), 88.0).otherwise(F.when(F.size("focuses") > 0, 82.0).otherwise(52.0)) + _boost("relevance")
    link = F.exists("source_items", lambda s: tx.strip(tx.text_or_empty(s["url"])) != "")
    action = F.lit(45.0) + _plus(kind.isin(rules.ACTIONABLE_TYPES), 22.0) + _plus(tx.any_in(hay, rules.ACTIONABLE_WORDS), 18.0) + _plus(kind.isin(rules.PRACTICAL_TYPES), 8.0) + _boost("actionability") + _plus(link, 5.0)
    novelty = F.lit(58.0) + _plus(kind.isin(rules.NOVEL_TYPES), 14.0) + _plus(tx.any_in(hay, rules.NOVELTY_WORDS), 16.0) + _boost("novelty") - _plus(tx.any_in(hay, rules.FOLLOW_UP_WORDS), 14.0) + _plus(members >= 5, 4.0)
    lone = n <= 1
    risk = _plus(lone & ~F.array_contains(kinds, "official"), 2.0) + _plus(lone & F.array_contains(kinds, "community"), 3.0) + _plus(conf < 0.7, 8.0) + _plus(F.col("latest_pubtime").isNull(), 6.0) + _plus(F.col("mismatch"), 18.0)
    return {"importance": tx.clamp(importance), "source": source, "freshness": freshness, "relevance": tx.clamp(relevance), "actionability": tx.clamp(action), "novelty": tx.clamp(novelty), "risk_penalty": F.least(F.lit(40.0), risk)}


def with_scores(df: DataFrame) -> DataFrame:
    """SC01: components, paper boosts, final score and its reason."""
    parts = scores()
    paper = F.col("paper_signal")
    boosts = {"importance": F.lit(5.0), "relevance": F.lit(6.0), "novelty": F.lit(5.0), "actionability": F.when(tx.any_in(F.col("haystack"), rules.PAPER_CODE_WORDS), 8.0).otherwise(3.0)}
    df = df.withColumns({name if name == "risk_penalty" else f"{name}_score": F.when(paper, tx.clamp(c + boosts[name])).otherwise(c) if name in boosts else c for name, c in parts.items()})
    final = reduce(lambda a, b: a + b, [F.col(f"{k}_score") * w for k, w in rules.WEIGHTS.items()]) - F.col("risk_penalty")
    whole = lambda c: F.col(c).cast("int").cast("string")  # noqa: E731  components are whole numbers
    reason = F.concat(F.lit("impact="), whole("importance_score"), *[x for k in ("source", "freshness", "relevance", "actionability", "novelty") for x in (F.lit(f", {k}="), whole(f"{k}_score"))], F.lit(", risk_penalty="), whole("risk_penalty"))
    extra = F.array_compact(F.array(F.when(F.size("focuses") > 0, F.concat(F.lit("focus="), F.array_join("focuses", "+"))), F.when(paper, F.lit("paper_signal"))))
    return df.withColumns({"final_score": F.round(tx.clamp(final), 2), "score_reason": F.concat(reason, F.when(F.size(extra) > 0, F.concat(F.lit(", "), F.array_join(extra, ", "))).otherwise(""))})


def with_summary(df: DataFrame) -> DataFrame:
    """TX20-TX23: title, sentence and why; English sentences become rule-made ones."""
    df = df.withColumn("raw_title", tx.best_title(F.col("event_label"), F.col("representative_titles")))
    df = df.withColumn("title", F.coalesce(tx.rewrite(F.col("raw_title"), rules.TITLE_REWRITES), F.col("raw_title")))
    df = df.withColumn("sentence", tx.short_sentence(F.col("event_summary"), F.col("title")))
    df = df.withColumn("sentence", F.coalesce(tx.rewrite(F.concat_ws(" ", "raw_title", "sentence"), rules.SUMMARY_REWRITES), F.col("sentence")))
    named = F.filter(F.transform("key_entities", tx.strip), lambda e: e != "")
    native = F.filter(named, lambda e: ~tx.mostly_english(e))
    leading = tx.strip(F.regexp_extract("title", r"^([A-Z][A-Za-z0-9.&-]*(?:\s+[A-Z][A-Za-z0-9.&-]*){0,2})", 1))
    subject = F.coalesce(F.get(native, 0), F.get(named, 0), F.nullif(leading, F.lit("")), F.lit("相关机构"))
    both, low = F.concat_ws(" ", "sentence", "title"), F.lower(F.concat_ws(" ", "sentence", "title"))
    action = reduce(lambda a, x: F.when(both.rlike(x[0]), x[1]).otherwise(a), reversed(rules.ACTIONS), F.lit("更新"))
    details = F.slice(F.array_compact(F.array(*[F.when(tx.any_in(low, words), F.lit(d)) for words, d in rules.DETAILS])), 1, 3)
    made = F.concat(subject, action, tx.lookup(F.col("normalized_event_type"), rules.TYPE_NOUNS, F.lit("AI 动态")), F.when(F.size(details) > 0, F.concat(F.lit("，重点涉及"), F.array_join(details, "、"))).otherwise(""), F.lit("。"))
    own = F.when(~tx.mostly_english(F.col("sentence")), F.col("sentence")).when(~tx.mostly_english(F.col("title")), tx.short_sentence(F.col("title"), F.col("title"))).otherwise(made)
    return df.withColumns({"one_sentence": own, "why_important": tx.lookup(F.col("normalized_event_type"), rules.WHY, F.lit(rules.WHY_OTHER))}).drop("raw_title", "sentence")


def verify() -> Column:
    """FL03: struct(status, reason), the first rule that fits."""
    kinds, n = F.col("kinds"), F.size("platform_set")
    media = F.array_contains(kinds, "authority_media") | F.array_contains(kinds, "chinese_media")
    table = [
        (F.col("text_quality").isin("bad", "missing"), "needs_review", "文本存在乱码或缺失，需要人工复核。"),
        (F.col("latest_pubtime").isNull(), "needs_review", "缺少发布时间，不能稳定判断时效性。"),
        (F.array_contains("validation_warnings", "confidence_out_of_range"), "needs_review", "confidence 超出有效范围。"),
        (F.col("mismatch"), "needs_review", "事件标题与来源标题明显不一致，疑似上游错聚类。"),
        (tx.any_in(F.col("plain"), rules.RUMOR_WORDS), "rumor", "包含传闻或未确认措辞，适合进入待观察线索。"),
        (F.array_contains(kinds, "community") & (n == 1), "single_source", "community single source, kept for normal ranking."),
        (F.array_contains(kinds, "official"), "verified", "包含官方来源。"),
        ((n >= 2) & media, "verified", "来自多个平台且包含媒体来源。"),
    ]
    last = F.struct(F.lit("single_source").alias("status"), F.lit("单一平台来源，已保留但需要展示来源状态。").alias("reason"))
    return reduce(lambda a, r: F.when(r[0], F.struct(F.lit(r[1]).alias("status"), F.lit(r[2]).alias("reason"))).otherwise(a), reversed(table), last)


def enrich(df: DataFrame) -> DataFrame:
    """SC10: classify, score, summarise, check quality, verify and collect warnings."""
    df = with_summary(with_scores(with_signals(df).withColumn("content_layer", content_layer())))
    df = df.withColumn("text_quality", tx.quality(F.col("title"), F.col("one_sentence"), F.col("event_type"), F.array_join("key_entities", " ")))
    df = df.withColumn("verified", verify())
    more = F.array_compact(F.array(F.when(F.col("latest_pubtime").isNull(), "latest_pubtime_missing"), F.when(F.col("text_quality") != "ok", F.concat(F.lit("text_quality_"), "text_quality")), F.when(F.size("source_items") == 0, "source_items_missing")))
    df = df.withColumns({"verify_status": F.col("verified.status"), "verify_reason": F.col("verified.reason"), "warnings": F.concat("validation_warnings", more)})
    return df.withColumnRenamed("key_entities", "entities").drop("verified", "plain", "layer_text", "haystack", "representative_titles", "validation_warnings")
