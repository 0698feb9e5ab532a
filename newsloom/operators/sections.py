"""Report sections per day: SC09, SC11, AR02, FL06-FL12, WN04-WN06, WN10, SO01, SO03, JN11, RP04.

A day may hold most events, so nothing ranks or gathers whole days: each
section first prunes exactly, by ranks that Spark limits before the shuffle, to
a number of rows that does not depend on the day's events, and only those
narrow rows meet in one array for each day.  The choices are then array
expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import rules
from newsloom.functions import text as tx
from newsloom.sources.workdir import written


def _text(*columns: str) -> Column:
    """The fields and the entities, blank-joined in lower case."""
    return F.lower(F.concat(*[x for c in columns for x in (F.col(c), F.lit(" "))], F.array_join("entities", " ")))


def _overlap(names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap("platform_set", F.array(*[F.lit(n) for n in names])), F.lit(False))


def with_flags(df: DataFrame) -> DataFrame:
    """FL04-FL10 as columns: what each section asks of an event."""
    kind = F.col("normalized_event_type")
    df = df.withColumns({"short_text": _text("title", "one_sentence", "normalized_event_type"), "long_text": _text("title", "one_sentence", "why_important", "normalized_event_type"), "main_entity": tx.first_lowered(F.col("entities")), "main_platform": tx.first_lowered(F.col("platforms"))})
    df = df.withColumns({"is_paper": _overlap(rules.PAPER_PLATFORMS) | (kind.isin(rules.PAPER_TYPES) & tx.any_in(F.col("short_text"), rules.PAPER_WORDS)), "is_trending": _overlap(["huggingface_papers_trending"]), "is_reusable": tx.any_in(F.col("long_text"), rules.REUSABLE_WORDS)})
    names = F.filter(F.transform("platforms", F.lower), lambda p: p != "")
    hinted = lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(h)) for h in rules.COMMUNITY_HINTS])
    link = F.exists("source_items", lambda s: tx.strip(tx.text_or_empty(s["url"])) != "")
    useful = (F.col("actionability_score") >= 70) | (F.col("novelty_score") >= 72) | (F.col("is_paper") & (F.col("final_score") >= 52))
    asset = ~tx.any_in(F.col("short_text"), rules.ASSET_EXCLUDE) & (kind.isin(rules.ASSET_TYPES) | F.col("content_layer").isin("insight", "deep_asset")) & (tx.any_in(F.col("short_text"), rules.ASSET_WORDS) | F.col("is_reusable") | link) & useful & (F.col("risk_penalty") <= 18)
    return df.withColumns({"is_community": (F.size(names) > 0) & F.forall(names, hinted), "is_asset": asset, "is_top": (F.col("verify_status") != "rumor") & (F.col("final_score") >= 72) & (F.col("risk_penalty") <= 18)})


def tags() -> Column:
    """AR02."""
    flag = lambda c, name: F.when(c, F.lit(name))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.col("normalized_event_type"), F.col("content_layer"), F.col("verify_status"), flag(F.col("final_score") >= 80, "high_score"), flag(F.col("actionability_score") >= 70, "actionable"), flag(F.col("novelty_score") >= 72, "novel"),
        flag(F.col("risk_penalty") >= 12, "risk"), flag(F.col("source_score") >= 80, "strong_source"), flag(F.size(F.array_distinct(F.transform("platforms", F.lower))) == 1, "single_platform"), flag(F.col("is_community"), "community_only"), flag(F.col("is_asset"), "asset_candidate"), flag(F.col("is_top"), "top_news_candidate"),
    ))))


def section_scores() -> dict[str, Column]:
    """SC09."""
    risk, reason = F.col("risk_penalty"), F.lower("score_reason")
    strategic = F.least(F.lit(7.0), reduce(lambda x, y: x + y, [F.when(F.contains(reason, F.lit(k)), 4.0).otherwise(0.0) for k in rules.FOCUS_WORDS]))
    extra = {"insight": F.when(F.col("is_paper"), 6.0).otherwise(0.0), "deep_asset": F.when(F.col("is_reusable"), 5.0).otherwise(0.0)}
    made = {}
    for section, weights in rules.SECTION_WEIGHTS.items():
        score = reduce(lambda x, y: x + y, [F.col(f"{part}_score") * w for part, w in weights.items()])
        if section == "watchlist":
            score = score + F.least(risk, F.lit(24.0)) * 0.08 - F.greatest(risk - 24.0, F.lit(0.0)) * 0.50
        else:
            score = score - risk * rules.SECTION_RISK[section]
        score = score + strategic * rules.SECTION_STRATEGIC[section]
        made[section] = score + extra[section] if section in extra else score
    return {k: F.round(tx.clamp(v), 2) for k, v in made.items()}


def section_candidates() -> dict[str, Column]:
    """Who may enter which section."""
    open_ = F.col("verify_status") != "needs_review"
    kind, final, status = F.col("normalized_event_type"), F.col("final_score"), F.col("verify_status")
    sourced = status.isin("verified", "single_source")
    insight = sourced & (F.col("risk_penalty") <= 18) & (((F.col("content_layer") == "insight") & (final >= 58)) | (kind.isin(rules.PAPER_TYPES) & (final >= 56)) | (F.col("is_paper") & (final >= 50) & (F.col("source_score") >= 70)))
    strong = F.col("importance_score") >= 70
    watch = ((status == "rumor") & (F.col("importance_score") >= 55)) | ((status == "single_source") & (final >= 74) & strong) | (F.col("is_community") & (final >= 68) & strong) | (kind.isin(rules.WATCH_TYPES) & (F.col("risk_penalty") >= 12) & (final >= 65))
    return {"top_news": open_ & (F.col("content_layer") == "news") & F.col("is_top"), "insight": open_ & insight, "deep_asset": open_ & F.col("is_asset") & sourced & (final >= 60), "watchlist": open_ & watch}


def _order(section: str) -> list[Column]:
    """WN10: section score, then the event's own scores, then report order."""
    return [F.desc(f"scores_{section}"), F.desc("final_score"), F.desc("importance_score"), F.desc("source_score"), F.asc("place")]


def type_limit(kind: str) -> int:
    """How many top news of a type a day takes."""
    return rules.TOP_TYPE_LIMITS.get(kind, rules.OTHER_TYPE_LIMIT)


def _row(section: str) -> Column:
    """An event as it stands in its section's array: fields to sort by first."""
    rank = [(-F.col(c)).alias(n) for c, n in ((f"scores_{section}", "score"), ("final_score", "final"), ("importance_score", "importance"), ("source_score", "source"))]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_paper", "is_trending", "is_reusable")]
    return F.struct(*rank, "place", F.col("event_id").alias("id"), F.col("normalized_event_type").alias("kind"), F.col("main_entity").alias("entity"), F.col("main_platform").alias("platform"), *flags)


def _of_day(df: DataFrame, section: str) -> DataFrame:
    """(report_date, rows): the day's rows in section order."""
    return df.groupBy("report_date").agg(F.array_sort(F.collect_set(_row(section))).alias("rows"))


def capped(rows: Column, limit: int, caps: dict[str, Callable[[Column], Column | int]], exempt: tuple[str, ...] = ()) -> Column:
    """The first ``limit`` of the ordered rows, passing over those whose value of a field is used up.

    ``caps``: field to how many rows may share a value; a blank value of an
    ``exempt`` field is shared by any number.
    """

    def room(held: Column, x: Column, field: str) -> Column:
        left = F.size(F.filter(held, lambda h: h[field] == x[field])) < caps[field](x)
        return ((x[field] == "") | left) if field in exempt else left

    def step(held: Column, x: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, [room(held, x, f) for f in caps], F.size(held) < limit), F.array_append(held, x)).otherwise(held)

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def _pruned_top(df: DataFrame, limit: int) -> DataFrame:
    """Rows that may be chosen: a bounded number for each type and platform of a day.

    A triple of type, entity and platform fills no more places than its
    smallest limit.  Within a type and platform at most ``limit`` over the
    entity limit entities are ever used up, and the type's limit is chosen, so
    the rows of that many entities, best first, are enough.
    """
    most_of_type = max([rules.OTHER_TYPE_LIMIT, *rules.TOP_TYPE_LIMITS.values()])
    own = tx.lookup(F.col("normalized_event_type"), rules.TOP_TYPE_LIMITS, F.lit(rules.OTHER_TYPE_LIMIT))
    most = F.least(own, F.when(F.col("main_entity") != "", rules.ENTITY_LIMIT).otherwise(most_of_type), F.when(F.col("main_platform") != "", rules.PLATFORM_LIMIT).otherwise(most_of_type))
    triple = Window.partitionBy("report_date", "normalized_event_type", "main_entity", "main_platform")
    left = df.withColumn("nth", F.row_number().over(triple.orderBy(*_order("top_news")))).where(F.col("nth") <= F.lit(most_of_type)).where(F.col("nth") <= most)
    left = left.withColumn("best", F.min(_row("top_news")).over(triple))
    pool = Window.partitionBy("report_date", "normalized_event_type", "main_platform").orderBy("best")
    return left.withColumn("nth", F.dense_rank().over(pool)).where(F.col("nth") <= limit // rules.ENTITY_LIMIT + most_of_type).drop("nth", "best")


def _chosen_top(rows: Column, limit: int) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in rules.TOP_TYPE_LIMITS.items() for x in pair]) if rules.TOP_TYPE_LIMITS else None
    of_kind = lambda x: F.coalesce(F.try_element_at(kinds, x["kind"]), F.lit(rules.OTHER_TYPE_LIMIT)) if kinds is not None else F.lit(rules.OTHER_TYPE_LIMIT)
    return capped(rows, limit, {"kind": of_kind, "entity": lambda x: rules.ENTITY_LIMIT, "platform": lambda x: rules.PLATFORM_LIMIT}, ("entity", "platform"))


def _placed(rows: Column) -> Column:
    """Ids with their places from 1."""
    return F.transform(rows, lambda x, i: F.struct(x["id"].alias("event_id"), (i + 1).alias("position")))


def top_news(df: DataFrame, limit: int = rules.SECTION_SIZES["top_news"]) -> DataFrame:
    """WN05: (report_date, event_id, position) of the diversity-capped best."""
    if "is_paper" not in df.columns:
        df = df.withColumns({c: F.lit(False) for c in ("is_paper", "is_trending", "is_reusable")})
    days = _of_day(_pruned_top(df, limit), "top_news")
    return days.select("report_date", F.explode(_placed(_chosen_top(F.col("rows"), limit))).alias("x")).select("report_date", "x.*")


def one_per_entity(df: DataFrame, section: str, limit: int) -> DataFrame:
    """WN04: the best of each main entity (blank ones all), then the first ``limit``; adds ``position``."""
    same = Window.partitionBy("report_date", "main_entity").orderBy(*_order(section))
    first = df.withColumn("nth", F.row_number().over(same)).where((F.col("nth") == 1) | (F.col("main_entity") == "")).drop("nth")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("report_date").orderBy(*_order(section)))).where(F.col("position") <= limit)


def _papers(section: str, least: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Which rows may be forced in: a paper, and a trending paper."""
    good = lambda x: x["score"] <= -least  # noqa: E731  scores are negated to sort by
    if section == "deep_asset":
        return lambda x: x["is_paper"] & x["is_reusable"] & good(x), lambda x: x["is_trending"] & x["is_paper"] & x["is_reusable"] & good(x)
    return lambda x: x["is_paper"] & good(x), lambda x: x["is_trending"] & good(x)


def _pruned(df: DataFrame, section: str, limit: int, taken: int, least: float) -> DataFrame:
    """Rows that may be chosen after ``taken`` of the day's events have gone to other sections.

    Of an entity the best row that is left is among its first ``taken`` + 1; of
    the entities, those with the ``limit`` + ``taken`` best rows are enough,
    and of papers to be forced in, the first ``taken`` + 1 of each kind.
    """
    own = F.when(F.col("main_entity") != "", F.col("main_entity")).otherwise(F.concat(F.lit("\0"), "event_id"))
    df = df.withColumn("entity_key", own)
    entity = Window.partitionBy("report_date", "entity_key")
    first = df.withColumn("nth", F.row_number().over(entity.orderBy(*_order(section)))).where(F.col("nth") <= taken + 1)
    first = first.withColumn("best", F.min(_row(section)).over(entity))
    kept = first.withColumn("nth", F.dense_rank().over(Window.partitionBy("report_date").orderBy("best"))).where(F.col("nth") <= limit + taken).drop("nth", "best")
    if section != "watchlist":
        for may in _papers(section, least):
            some = df.withColumn("row", _row(section)).where(may(F.col("row"))).drop("row")
            some = some.withColumn("nth", F.row_number().over(Window.partitionBy("report_date").orderBy(*_order(section)))).where(F.col("nth") <= taken + 1).drop("nth")
            kept = kept.unionByName(some)
    return kept.drop("entity_key")


def _forced(held: Column, extra: Column, kind: str, limit: int) -> Column:
    """``extra`` in place of the weakest row (no paper, if there is such), unless its kind is there already."""
    known = F.exists(held, lambda h: h[kind] | (h["id"] == extra["id"]))
    weakest = F.array_min(F.transform(held, lambda h, i: F.struct(h["is_paper"].alias("paper"), (-h["score"]).alias("score"), i.alias("at"))))["at"]
    swapped = F.transform(held, lambda h, i: F.when(i == weakest, extra).otherwise(h))
    return F.when(extra.isNull() | known, held).when(F.size(held) < limit, F.array_append(held, extra)).otherwise(swapped)


def _ordered(rows: Column, limit: int) -> Column:
    """By scores, ties as they stand."""
    keyed = F.transform(rows, lambda x, i: F.struct(x["score"].alias("a"), x["final"].alias("b"), x["importance"].alias("c"), x["source"].alias("d"), i.alias("e"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda k: k["x"])


def report_order(df: DataFrame) -> DataFrame:
    """SO01: ``place`` of each event in its day's report; to be cut to the first few."""
    day = Window.partitionBy("report_date").orderBy(F.desc("final_score"), F.desc("importance_score"), F.desc("source_score"), F.asc("ordinal"))
    return df.withColumn("place", F.row_number().over(day))


def with_order(df: DataFrame) -> DataFrame:
    """SO01 without ranking: ``place`` is what events of a day are sorted by, in ascending order."""
    return df.withColumn("place", F.struct(*[(-F.col(c)).alias(c) for c in ("final_score", "importance_score", "source_score")], "ordinal"))


def choices(narrow: DataFrame, least: float = 58.0) -> DataFrame:
    """WN04-WN06, JN11: (report_date, event_id, report_section, position) of the events that the sections choose in turn."""
    sizes = rules.SECTION_SIZES
    days, taken = None, 0
    for section in ("top_news", "insight", "deep_asset", "watchlist"):
        rows = narrow.where(f"may_{section}")
        rows = _pruned_top(rows, sizes[section]) if section == "top_news" else _pruned(rows, section, sizes[section], taken, least)
        taken += sizes[section]
        one = _of_day(rows, section).withColumnRenamed("rows", f"rows_{section}")
        days = one if days is None else days.join(one, "report_date", "full")
    empty = F.slice(F.coalesce(*[F.col(f"rows_{s}") for s in sizes]), 1, 0)
    days = days.withColumns({f"rows_{s}": F.coalesce(f"rows_{s}", empty) for s in sizes})
    days = days.withColumn("chosen_top_news", _chosen_top(F.col("rows_top_news"), sizes["top_news"])).withColumn("gone", F.transform("chosen_top_news", lambda x: x["id"]))
    for section in ("insight", "deep_asset", "watchlist"):
        days = days.withColumn("open", F.filter(f"rows_{section}", lambda x: ~F.array_contains("gone", x["id"])))
        days = days.withColumn("held", capped(F.col("open"), sizes[section], {"entity": lambda x: F.lit(1)}, ("entity",)))
        if section != "watchlist":
            for kind, may in zip(("is_paper", "is_trending"), _papers(section, least), strict=True):
                days = days.withColumn("extra", F.get(F.filter("open", may), 0)).withColumn("held", _forced(F.col("held"), F.col("extra"), kind, sizes[section]))
            days = days.withColumn("held", _ordered(F.col("held"), sizes[section]))
        days = days.withColumnRenamed("held", f"chosen_{section}").withColumn("gone", F.concat("gone", F.transform(f"chosen_{section}", lambda x: x["id"])))
    placed = F.map_from_entries(F.array(*[F.struct(F.lit(s), _placed(F.col(f"chosen_{s}"))) for s in sizes]))
    return days.select("report_date", F.explode(placed).alias("report_section", "places")).select("report_date", "report_section", F.explode("places").alias("x")).select("report_date", "x.event_id", "report_section", "x.position")


def assign(df: DataFrame) -> DataFrame:
    """SC11: enriched events with tags, section scores, section and place in it."""
    df = with_flags(with_order(df))
    made = section_scores()
    may = section_candidates()
    df = df.withColumns({f"scores_{k}": v for k, v in made.items()} | {"report_tags": tags()} | {f"may_{k}": F.coalesce(v, F.lit(False)) for k, v in may.items()})
    # read by every section below: computed once
    df = written(df, "flagged")
    narrow = df.select("report_date", "event_id", "normalized_event_type", "main_entity", "main_platform", "place", "final_score", "importance_score", "source_score", "is_paper", "is_trending", "is_reusable", *[f"{x}_{k}" for k in may for x in ("scores", "may")])
    chosen = written(choices(narrow), "chosen")
    out = df.join(chosen, ["report_date", "event_id"], "left")
    scores = F.create_map(*[x for k in made for x in (F.lit(k), F.col(f"scores_{k}"))])
    tagged = F.when(F.col("report_section").isNull(), F.col("report_tags")).otherwise(F.array_sort(F.array_union("report_tags", F.array("report_section"))))
    return out.withColumns({"section_scores": scores, "report_tags": tagged, "should_include_report": F.col("report_section").isNotNull()})


def passed_over(df: DataFrame, section: str) -> DataFrame:
    """ST05: events that a section might have taken and no section did."""
    chosen = df.where("should_include_report").select("report_date", "event_id")
    return df.where(f"may_{section}").join(chosen, ["report_date", "event_id"], "left_anti")


def first_of_id(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """ST07: the first row of each key, in the order given."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth = 1").drop("nth")


def unselected(df: DataFrame, most: int = 50) -> DataFrame:
    """SO03/RP04: the day's first unselected events with a high score."""
    rows = df.where(F.col("report_section").isNull() & (F.col("verify_status") != "needs_review") & (F.col("final_score") >= 60))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("report_date").orderBy("place"))).where(F.col("nth") <= most).drop("nth")


def review_queue(df: DataFrame) -> DataFrame:
    """FL19: events to look at by hand."""
    return df.where((F.col("verify_status") == "needs_review") | F.array_contains("warnings", "source_items_missing"))


def watch_reason() -> Column:
    """FL12: why an event is on the watch list."""
    everything = F.lower(F.concat_ws(" ", "title", "one_sentence", "why_important", "normalized_event_type", F.array_join("entities", " "), F.array_join("platforms", " ")))
    return (
        F.when((F.col("verify_status") == "rumor") | F.array_contains("report_tags", "community_only"), "来源更偏线索或社区传播，信号有价值，但暂不宜放入重点新闻。")
        .when(tx.any_in(everything, rules.COMPUTE_WORDS), "算力或芯片方向的信号价值较高，但还需观察后续产品落地、订单或实际性能数据。")
        .when(tx.any_in(everything, rules.BIOMED_WORDS), "生物医药交叉方向值得跟踪，但需继续观察评估结果、实验验证或药研场景采用。")
        .when(F.col("normalized_event_type").isin(rules.POLICY_TYPES), "政策或治理方向可能影响合规和出海，但落地路径和执行细则还需继续观察。")
        .otherwise("事件具有跟踪价值，但当前更适合作为高质量线索，等待更明确的落地进展或外部验证。")
    )
