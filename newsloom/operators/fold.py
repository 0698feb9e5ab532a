"""Responses to events, items to events, events into events.

AG01-AG04, AR01, EM05, EM07, EM10, JN05, JN06, WN02, WN03, ST03.  ``run_id``
is part of every key, so all runs fold in one pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions import text as tx
from newsloom.sources.workdir import written

RESPONSE = "events array<struct<event_label:string,event_summary:string,event_type:string,key_entities:array<string>,confidence:string,source_news_ids:array<string>,member_reasons:map<string,string>>>, suspects array<struct<index:string,reason:string,relevance_score:string>>, discards array<struct<index:string,reason:string,relevance_score:string>>"

#: Why an item that no part of a response names is discarded.
OMITTED = "LLM omitted item from clustered extraction response"


def claims(responses: DataFrame) -> DataFrame:
    """One row for each item id that an event of a response names, in response order."""
    parsed = responses.withColumn("r", tx.rescued_object(F.col("response"), RESPONSE))
    events = parsed.select("run_id", "batch_index", F.posexplode("r.events").alias("event_pos", "e"))
    return events.select("run_id", "batch_index", "event_pos", "e", F.posexplode(tx.int_list(F.col("e.source_news_ids"))).alias("pos", "item_index"))


def first_claims(found: DataFrame, items: DataFrame) -> DataFrame:
    """WN02/JN05: known items only, each to the first event that names it."""
    known = found.join(items.select("run_id", "item_index"), ["run_id", "item_index"], "left_semi")
    order = Window.partitionBy("run_id", "item_index").orderBy("batch_index", "event_pos", "pos")
    return known.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def numbered_events(first: DataFrame) -> DataFrame:
    """WN03: (run_id, batch_index, event_pos, number) of events that kept a claim."""
    kept = first.select("run_id", "batch_index", "event_pos").distinct()
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("batch_index", "event_pos")))


def not_assigned(responses: DataFrame, items: DataFrame) -> DataFrame:
    """EM05: discards, then suspects, the first row of an item counts; stage, reason and relevance."""
    parsed = responses.withColumn("r", tx.rescued_object(F.col("response"), RESPONSE))
    rows = None
    for rank, (part, stage, default) in enumerate((("discards", "clustered_title_discard", "LLM discarded in clustered extraction"), ("suspects", "clustered_title_suspect", "title-only suspected AI item"))):
        one = parsed.select("run_id", "batch_index", F.posexplode(f"r.{part}").alias("pos", "x"))
        one = one.select("run_id", "batch_index", F.lit(rank).alias("part"), "pos", F.col("x.index").try_cast("int").alias("item_index"), F.lit(stage).alias("stage"), F.coalesce(tx.clean(F.col("x.reason")), F.lit(default)).alias("reason"), F.col("x.relevance_score").try_cast("int").alias("relevance_score"))
        rows = one if rows is None else rows.unionByName(one)
    known = rows.join(items.select("run_id", "item_index", "title", "platform"), ["run_id", "item_index"])
    order = Window.partitionBy("run_id", "item_index").orderBy("batch_index", "part", "pos")
    return known.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("run_id", "item_index", "title", "platform", "stage", "reason", "relevance_score")


def omitted(items: DataFrame, first: DataFrame, named: DataFrame) -> DataFrame:
    """JN06: items that no part of a response names."""
    rest = items
    # one after the other: a join on a union whose parts are dealt by the same key can fail (see ``apply_extraction``)
    for one in (first, named):
        rest = rest.join(one.select("run_id", "item_index"), ["run_id", "item_index"], "left_anti")
    return rest.select("run_id", "item_index", "title", "platform", F.lit("clustered_title_omitted").alias("stage"), F.lit(OMITTED).alias("reason"), F.lit(None).cast("int").alias("relevance_score"))


def fold_items(members: DataFrame, keys: list[str]) -> DataFrame:
    """AG01: items (platform, title, item_index, pubtime instant, claim order ``pos``) folded by event key.

    Sets and extremes combine before the shuffle; lists are bounded by an
    event's members.
    """
    out = members.groupBy(*keys).agg(
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        tx.top_titles(F.collect_set("title")).alias("representative_titles"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_index"))), lambda x: x["item_index"]).alias("source_news_ids"),
        F.min("pubtime").alias("first_at"),
        F.max("pubtime").alias("latest_at"),
    )
    ids = F.array_distinct("source_news_ids")
    return out.select(*keys, "platforms", "representative_titles", ids.alias("source_news_ids"), F.size(ids).alias("member_count"), dates.iso_utc(F.col("first_at")).alias("first_pubtime"), dates.iso_utc(F.col("latest_at")).alias("latest_pubtime"))


def apply_extraction(items: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EM05/AG02: (items with decisions, events, discards) of the extraction responses.

    ``items``: run_id, item_index, platform, title, url, pubtime, scrape_date.
    An item that no part of a response names is told by that, not joined from
    the discards: those are a union whose parts are dealt by the key of the
    join, which Spark may read as twice the partitions of the other side.
    """
    first = first_claims(claims(responses), items)
    numbers = numbered_events(first)
    rows = items.withColumn("pubtime_at", dates.parse_iso(F.col("pubtime"))).select("run_id", "item_index", "title", "platform", "scrape_date", F.col("pubtime_at").alias("pubtime"))
    members = first.join(numbers, ["run_id", "batch_index", "event_pos"]).join(rows, ["run_id", "item_index"])
    head = members.groupBy("run_id", "number").agg(F.first("e").alias("e"), F.min_by("title", "pos").alias("first_title"), F.max("scrape_date").alias("scrape_date"))
    folded = fold_items(members, ["run_id", "number"]).join(head, ["run_id", "number"])
    events = folded.select(
        "run_id", F.col("number").alias("ordinal"), tx.event_id(F.col("scrape_date"), F.col("number")).alias("event_id"), F.coalesce(tx.clean(F.col("e.event_label")), F.col("first_title")).alias("event_label"),
        "member_count", "platforms", "latest_pubtime", "representative_titles", "first_pubtime", tx.classify_confidence(F.col("e.confidence")).alias("confidence"), tx.clean(F.col("e.event_summary")).alias("event_summary"),
        tx.extraction_type(F.col("e.event_type")).alias("event_type"), tx.clean_list(F.col("e.key_entities")).alias("key_entities"), "source_news_ids", F.col("scrape_date").alias("last_llm_updated_at"),
    )
    named = not_assigned(responses, items)
    discards = named.unionByName(omitted(items, first, named))
    assigned = members.select("run_id", "item_index", "number", F.coalesce(tx.clean(F.try_element_at("e.member_reasons", F.col("item_index").cast("string"))), F.lit("clustered title extraction")).alias("assign_reason"))
    assigned = assigned.join(events.select("run_id", F.col("ordinal").alias("number"), "event_id", "event_label", F.col("confidence").alias("event_confidence"), F.coalesce("event_summary", "event_label").alias("canonical_summary"), F.col("key_entities").alias("entities"), "event_type"), ["run_id", "number"]).drop("number")
    stages = named.select("run_id", "item_index", "stage", F.col("reason").alias("stage_reason"), F.col("relevance_score").alias("stage_score"))
    out = items.join(assigned, ["run_id", "item_index"], "left").join(stages, ["run_id", "item_index"], "left")
    has = F.col("assign_reason").isNotNull()
    out = out.withColumn("stage_reason", F.when(has | F.col("stage").isNotNull(), F.col("stage_reason")).otherwise(OMITTED))
    decision = F.when(has, "assign").when(F.col("stage") == "clustered_title_suspect", "suspect").otherwise("discard")
    out = out.withColumns({"classification_decision": decision, "classification_reason": F.coalesce("assign_reason", "stage_reason"), "is_ai_relevant": F.when(has, True).when(decision == "suspect", F.lit(None)).otherwise(False), "relevance_score": F.when(has, F.coalesce(F.nullif("stage_score", F.lit(0)), F.lit(90))).otherwise(F.col("stage_score"))})
    return out.drop("stage", "stage_reason", "stage_score", "assign_reason"), events, discards


def merge_edges(merges: DataFrame) -> DataFrame:
    """Proposed edges in order: run_id, step (batch, group), pos, target, source, label, summary.

    ``merges``: run_id, batch_index, merge_groups array of target_event_id,
    source_event_ids, event_label, event_summary.
    """
    groups = merges.select("run_id", "batch_index", F.posexplode("merge_groups").alias("group_pos", "g"))
    rows = groups.select("run_id", "batch_index", "group_pos", tx.clean(F.col("g.target_event_id")).alias("target"), tx.clean(F.col("g.event_label")).alias("label"), tx.clean(F.col("g.event_summary")).alias("summary"), F.posexplode(tx.clean_list(F.col("g.source_event_ids"))).alias("pos", "source"))
    return rows.where("target is not null and source <> target")


def accepted_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """AG04: edges that stand in order: neither end absorbed before, both ids known.

    Most edges touch no other and stand.  Among the rest order matters only
    inside a connected component, so components are dealt out and each is
    replayed by one small function.  A
    source named twice in one group counts twice and folds once.
    """
    ids = events.select("run_id", F.col("event_id").alias("id"))
    known = edges.join(ids.withColumnRenamed("id", "target"), ["run_id", "target"], "left_semi").join(ids.withColumnRenamed("id", "source"), ["run_id", "source"], "left_semi")
    # an edge stands by itself if its source is named once and is no target, and its target is no source
    columns = ["run_id", "batch_index", "group_pos", "pos", "target", "source", "label", "summary"]
    sources = known.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("named"))
    targets = known.select("run_id", F.col("target").alias("source"), F.lit(True).alias("also_target")).distinct()
    moving = sources.select("run_id", F.col("source").alias("target"), F.lit(True).alias("also_source"))
    marked = known.join(sources, ["run_id", "source"]).join(targets, ["run_id", "source"], "left").join(moving, ["run_id", "target"], "left")
    marked = written(marked.select(*columns, ((F.col("named") > 1) | F.col("also_target").isNotNull() | F.col("also_source").isNotNull()).alias("contested")), "marked")
    plain, contested = marked.where("not contested").select(*columns), marked.where("contested").select(*columns)
    if contested.isEmpty():
        return plain
    comps = components(contested.select("run_id", F.col("target").alias("a"), F.col("source").alias("b")))
    rows = contested.join(comps.toDF("run_id", "target", "component"), ["run_id", "target"])

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        out = []
        frame = frame.sort_values(["batch_index", "group_pos", "pos"])
        for _, group in frame.groupby(["batch_index", "group_pos"], sort=True):
            if group["target"].iloc[0] in gone:
                continue
            standing = [r for r in group.to_dict("records") if r["source"] not in gone]
            out += standing
            gone.update(r["source"] for r in standing)
        return pd.DataFrame(out, columns=columns)

    schema = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in columns)
    return plain.unionByName(rows.select(*columns, "component").groupBy("run_id", "component").applyInPandas(replay, schema))


def components(edges: DataFrame) -> DataFrame:
    """(run_id, id, component) by minimum labels with pointer jumping, until no label changes.

    Each round is written, so its lineage is cut; without edges there is none.
    """
    both = written(edges.unionByName(edges.select("run_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("run_id", "a").agg(F.min("b").alias("m")).select("run_id", F.col("a").alias("id"), F.least("a", "m").alias("component"))
    open_ = not both.isEmpty()
    while open_:
        near = both.join(labels.toDF("run_id", "b", "c"), ["run_id", "b"]).groupBy("run_id", F.col("a").alias("id")).agg(F.min("c").alias("near"))
        step = labels.join(near, ["run_id", "id"]).select("run_id", "id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.toDF("run_id", "component", "far")
        new = step.join(jump, ["run_id", "component"], "left").select("run_id", "id", "was", F.coalesce(F.least("component", "far"), "component").alias("component"))
        new = written(new, "labels")
        open_ = not new.where("component < was").isEmpty()
        labels = new.select("run_id", "id", "component")
    return labels


def roots(edges: DataFrame) -> DataFrame:
    """(run_id, id, root): where each absorbed event ends up, by pointer jumping until nothing moves."""
    up = written(edges.select("run_id", F.col("source").alias("id"), F.col("target").alias("root")).distinct(), "roots")
    moves = up.join(up.toDF("run_id", "root", "far"), ["run_id", "root"], "left_semi")
    while not moves.isEmpty():
        far = up.toDF("run_id", "root", "far")
        up = written(up.join(far, ["run_id", "root"], "left").select("run_id", "id", F.coalesce("far", "root").alias("root")), "roots")
        moves = up.join(up.toDF("run_id", "root", "far"), ["run_id", "root"], "left_semi")
    return up.select("run_id", "id", "root")


def apply_merges(events: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG03/EM07: (events after merging, accepted edges).

    An absorbed event brings arrays, times, confidence and fall-back summary
    and type; the last accepted group's label and summary win on its target.
    """
    edges = written(accepted_edges(merge_edges(merges), events), "edges")
    last = F.struct("batch_index", "group_pos")
    said = edges.groupBy("run_id", F.col("target").alias("event_id")).agg(F.max_by("label", F.when(F.col("label").isNotNull(), last)).alias("new_label"), F.max_by("summary", F.when(F.col("summary").isNotNull(), last)).alias("new_summary"), F.lit(True).alias("merged"))
    ends = roots(edges)
    rows = events.join(said, ["run_id", "event_id"], "left").join(ends.withColumnRenamed("id", "event_id"), ["run_id", "event_id"], "left")
    # the order in which sources fold, the target first
    turn = edges.groupBy("run_id", F.col("source").alias("event_id")).agg(F.min(F.struct("batch_index", "group_pos", "pos")).alias("turn"))
    rows = rows.join(turn, ["run_id", "event_id"], "left").withColumns({"head": F.col("root").isNull(), "root": F.coalesce("root", "event_id"), "event_label": F.coalesce("new_label", "event_label"), "event_summary": F.coalesce("new_summary", "event_summary")})
    order = F.struct(~F.col("head"), "turn")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    first = F.min_by(F.struct(*[c for c in events.columns if c not in ("run_id",)]), order).alias("own")
    found = rows.groupBy("run_id", "root").agg(
        first, F.count(F.lit(1)).alias("n"), flat("platforms").alias("platforms"), flat("representative_titles").alias("titles"), flat("source_news_ids").alias("ids"), flat("key_entities").alias("entities"), F.max("confidence").alias("confidence"),
        F.min_by("event_summary", F.when(F.col("event_summary").isNotNull(), order)).alias("summary"), F.min_by("event_type", F.when(F.col("event_type").isNotNull(), order)).alias("type"),
        F.min_by("first_pubtime", F.struct(dates.parse_iso(F.col("first_pubtime")).isNull(), dates.parse_iso(F.col("first_pubtime")))).alias("first"), F.max_by("latest_pubtime", dates.parse_iso(F.col("latest_pubtime"))).alias("latest"),
    )
    many = F.col("n") > 1
    replaced = {"platforms": F.col("platforms"), "representative_titles": tx.top_titles(F.col("titles")), "source_news_ids": F.col("ids"), "key_entities": F.col("entities"), "member_count": F.size("ids"), "confidence": F.col("confidence"), "event_summary": F.col("summary"), "event_type": F.col("type"), "first_pubtime": F.col("first"), "latest_pubtime": F.col("latest")}
    return found.select("run_id", *[(F.when(many, replaced[c]).otherwise(F.col(f"own.{c}")) if c in replaced else F.col(f"own.{c}")).alias(c) for c in events.columns if c != "run_id"]), edges


def allowed_ids(decoded, allowed, known):
    """EM10: merge ids that were offered and exist."""
    return F.array_intersect(F.array_intersect(tx.clean_list(decoded), allowed), known)


def remap_items(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Opt-in: items of absorbed events point to where the event went (the default leaves them)."""
    ends = roots(edges).withColumnRenamed("id", "event_id")
    return items.join(ends, ["run_id", "event_id"], "left").withColumn("event_id", F.coalesce("root", "event_id")).drop("root")
