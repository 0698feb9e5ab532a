"""Report documents: RP01-RP03, AG08, SO05, SO06, EN05, one text per report date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import rules
from newsloom.functions import text as tx
from newsloom.operators.sections import watch_reason

SECTIONS = [("top_news", "一、今日重点新闻", "今日暂无达标内容。"), ("insight", "二、研究、评测与论文", "今日暂无达标内容。"), ("deep_asset", "三、长期方法与资源沉淀", "今日暂无达到推送阈值的深层资源。"), ("watchlist", "五、高质量待观察", "今日暂无高质量待观察内容。")]


@F.pandas_udf(T.StringType())
def one_decimal(v: pd.Series) -> pd.Series:
    """One decimal as Python writes it (exact binary value, half to even)."""
    return pd.Series(np.char.mod("%.1f", v.to_numpy(float)))


def sources() -> Column:
    """SO06: the first three distinct sources as links."""
    items = F.transform("source_items", lambda s: F.struct(F.coalesce(F.nullif(s["platform"], F.lit("")), F.lit("unknown")).alias("p"), tx.text_or_empty(s["url"]).alias("u")))
    keyed = F.transform(items, lambda s, i: F.struct(F.when(s["u"] != "", s["u"]).otherwise(s["p"]).alias("k"), i.alias("i"), s["p"].alias("p"), s["u"].alias("u")))
    keys = F.transform(keyed, lambda x: x["k"])
    first = F.slice(F.filter(keyed, lambda x: F.array_position(keys, x["k"]) == x["i"] + 1), 1, 3)
    links = F.array_join(F.transform(first, lambda x: F.when(x["u"] != "", F.concat(F.lit("["), x["p"], F.lit("]("), x["u"], F.lit(")"))).otherwise(x["p"])), ", ")
    names = F.when(F.size("platforms") > 0, F.array_join("platforms", ", ")).otherwise("unknown")
    return F.when(F.size("source_items") == 0, names).otherwise(links)


def evidence_label() -> Column:
    """EN05: strength and the number of sources read, from optional evidence columns."""
    strength = tx.text_or_empty(F.col("evidence_strength"))
    label = F.coalesce(tx.lookup(strength, rules.STRENGTH_LABELS), F.nullif(strength, F.lit("")), F.lit("未知"))
    count = F.coalesce("fetched_source_count", F.lit(0))
    return F.when(count > 0, F.concat(label, F.lit("（已读取 "), count.cast("string"), F.lit(" 个原始来源）"))).otherwise(label)


def entries(df: DataFrame, debug: bool) -> DataFrame:
    """RP01: one text block for each selected event."""
    for c, kind in (("evidence_strength", "string"), ("fetched_source_count", "int")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    status = F.when(F.col("report_section") == "watchlist", "待观察").otherwise(F.coalesce(tx.lookup(F.col("verify_status"), rules.STATUS_LABELS), F.col("verify_status")))
    lines = [F.concat(F.col("position").cast("string"), F.lit(". **"), "title", F.lit("**")), F.concat(F.lit("   - 简报："), "one_sentence"), F.concat(F.lit("   - 为什么重要："), "why_important")]
    if debug:
        lines.append(F.when(F.col("report_section") == "watchlist", F.concat(F.lit("   - 待观察原因："), watch_reason())))
    lines.append(F.concat(F.lit("   - 来源："), sources()))
    if debug:
        own = F.coalesce(F.try_element_at("section_scores", F.col("report_section")), F.col("final_score"))
        lines += [
            F.concat(F.lit("   - 状态："), status, F.lit("；证据："), evidence_label()),
            F.concat(F.lit("   - Debug：总分 "), one_decimal("final_score"), F.lit("；栏目分 "), one_decimal(own), F.lit("；类型 "), "normalized_event_type", F.lit("；标签 "), F.array_join(F.slice("report_tags", 1, 8), "、")),
            F.when(F.size("warnings") > 0, F.concat(F.lit("   - Warnings："), F.array_join(F.slice("warnings", 1, 5), ", "))),
        ]
    else:
        lines.append(F.concat(F.lit("   - 状态："), status))
    return df.select("report_date", "report_section", "position", F.concat_ws("\n", *lines, F.lit("")).alias("entry"))


def trends(selected: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """AG08/SO05/EM13: the day's trend text, from a landed summary or by rule."""
    news = selected.where("report_section <> 'watchlist'")
    kinds = news.groupBy("report_date", "normalized_event_type").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("report_date").orderBy(F.desc("n"), "seen"))
    label = F.coalesce(tx.lookup(F.col("normalized_event_type"), rules.TOPIC_LABELS), F.col("normalized_event_type"))
    topics = kinds.withColumn("r", rank).where("r <= 4").groupBy("report_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(label, F.lit(" "), F.col("n").cast("string"), F.lit(" 条")).alias("t")))), lambda x: x["t"]), "、").alias("topics"))
    best = F.row_number().over(Window.partitionBy("report_date").orderBy(F.desc("scores_top_news"), F.desc("final_score"), F.desc("importance_score"), F.desc("source_score"), "place"))
    examples = news.withColumn("r", best).where("r <= 3").groupBy("report_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("“"), "title", F.lit("”")).alias("t")))), lambda x: x["t"]), "、").alias("examples"))
    research = news.groupBy("report_date").agg(F.count_if(F.col("report_section").isin("insight", "deep_asset")).alias("research"))
    made = F.concat(
        F.lit("今天入选内容整体呈现出从产业基础设施到方法沉淀同步推进的特征："), "examples", F.lit(" 等事件说明，市场关注点正在从单点模型能力扩展到算力供给、部署成本、企业落地和可复用技术资产。从类型分布看，今天更集中的信号包括："), "topics",
        F.lit("；同时有 "), F.col("research").cast("string"), F.lit(" 条内容来自研究、评测、论文或长期资源层，说明值得跟踪的不只是即时新闻，也包括后续可能影响产品路线和工程实践的方法类成果。"),
    )
    out = research.join(topics, "report_date").join(examples, "report_date").select("report_date", made.alias("trend"))
    if summaries is None:
        return out
    landed = summaries.select("report_date", F.nullif(tx.strip(F.col("trend_summary")), F.lit("")).alias("landed"))
    return out.join(landed, "report_date", "full").select("report_date", F.coalesce("landed", "trend").alias("trend"))


def documents(df: DataFrame, summaries: DataFrame | None = None, debug: bool = False) -> DataFrame:
    """RP02/RP03: (report_date, document) for every date of the assigned events."""
    selected = df.where("should_include_report")
    blocks = entries(selected, debug).groupBy("report_date", "report_section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]), "\n").alias("block"))
    wide = blocks.groupBy("report_date").pivot("report_section", [s for s, *_ in SECTIONS]).agg(F.first("block"))
    days = df.select("report_date").distinct().join(wide, "report_date", "left").join(trends(selected, summaries), "report_date", "left")
    default = "今日暂无达标内容。"
    part = {s: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(F.col(s), F.lit((default if debug else empty) + "\n"))) for s, title, empty in SECTIONS}
    trend = F.concat(F.lit("## 四、今日趋势观察\n\n"), F.coalesce("trend", F.lit("今日入选内容不足，暂不生成趋势观察。")), F.lit("\n"))
    head = F.concat(F.lit("# AI 情报早报调试版 - " if debug else "# AI 情报早报 - "), F.col("report_date").cast("string"), F.lit("\n"))
    tail = [] if debug else [F.lit("\n> 说明：本报告面向群内阅读；评分、栏目分和标签等调试信息已单独写入 daily_report_debug.md 和 report_candidates.json。")]
    body = F.concat_ws("\n", head, part["top_news"], part["insight"], part["deep_asset"], trend, part["watchlist"], *tail)
    return days.select("report_date", F.concat(tx.strip(body), F.lit("\n")).alias("document"))
