"""Model responses and requests: JS02, EM08, EM09, EM15, EM16.

All runs at once; ``run_id`` is part of every key.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import fold, greedy, vectors
from newsloom.operators.running import running_counts
from newsloom.sources.workdir import written

# What a request tells of an item and of an event, in order.
NEWS_FIELDS = ["index", "title", "platform", "pubtime", "canonical_summary", "entities", "event_type", "relevance_score"]
EVENT_FIELDS = ["event_id", "event_label", "event_summary", "event_type", "key_entities", "member_count", "platforms", "latest_pubtime", "first_pubtime", "representative_titles"]

#: How many takeable events a seed's list of nearest ones allows for at first.
SLACK = 32


def reassembled(lines: DataFrame) -> DataFrame:
    """JS02: (request_id, streamed, content) from response lines (request_id, pos, line).

    ``data:`` lines before the first ``[DONE]`` are chunks whose deltas are
    joined in order; a response without such lines is its other lines, joined
    by newlines, or null.  Chunks that are no JSON say nothing.
    """
    data = F.when(F.startswith("line", F.lit("data:")), tx.strip(F.substring("line", 6, 2**31 - 1)))
    rows = lines.where(F.coalesce("line", F.lit("")) != "").withColumn("data", data)
    end = rows.where("data = '[DONE]'").groupBy("request_id").agg(F.min("pos").alias("end"))
    rows = rows.join(end, "request_id", "left").where("end is null or pos < end")
    delta = F.get_json_object(F.when(F.col("data").isNotNull(), F.col("data")), "$.choices[0].delta.content")
    joined = lambda c, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", c.alias("x"))))), lambda v: v["x"]), between)
    plain = F.when(F.col("data").isNull(), F.col("line"))
    out = rows.groupBy("request_id").agg(F.bool_or(F.col("data").isNotNull()).alias("streamed"), joined(delta, "").alias("said"), joined(plain, "\n").alias("plain"))
    every = lines.select("request_id").distinct().join(out, "request_id", "left")
    streamed = F.coalesce("streamed", F.lit(False))
    return every.select("request_id", streamed.alias("streamed"), F.when(streamed, F.col("said")).otherwise(F.nullif("plain", F.lit(""))).alias("content"))


def _payload(fields: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in fields])


def requests(seeds: DataFrame, events: DataFrame, found: DataFrame, seed_fields: list[str], names: tuple[str, str]) -> DataFrame:
    """EM15: (scope, query_id, request): a JSON row of each seed and its recalled events in rank order.

    ``seeds``: scope, query_id and the seed's fields; ``events``: scope,
    event_id and event fields; ``found``: scope, query_id, event_id, rank.
    ``names``: keys of the seed and of the candidates in the request.
    """
    offered = found.select("scope", "query_id", "event_id", "rank").join(events.select("scope", F.col("event_id").alias("id"), _payload(EVENT_FIELDS).alias("e")).withColumnRenamed("id", "event_id"), ["scope", "event_id"])
    lists = offered.groupBy("scope", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda x: x["e"]).alias("candidates"))
    rows = seeds.select("scope", "query_id", _payload(seed_fields).alias("seed")).join(lists, ["scope", "query_id"])
    return rows.select("scope", "query_id", F.to_json(F.struct(F.col("seed").alias(names[0]), F.col("candidates").alias(names[1])), {"ignoreNullFields": "false"}).alias("request"))


def apply_membership(items: DataFrame, events: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EM08: (decided items, created events, discards) of membership decisions in item order.

    ``items``: run_id, item_index, title, platform, scrape_date; ``events``:
    run_id, event_id; ``decisions``: run_id, item_index, decision and the
    event fields as text.  An assign to an event that is not there becomes a
    create; anything else but a create is a discard.  Created events are
    numbered on from the run's events, so whether an assign finds a created
    event depends only on how many were created before it, a running count
    over stretches of the run (``running_counts``).
    """
    count = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n0"))
    action = F.lower(F.coalesce(tx.clean(F.col("decision")), F.lit("discard")))
    rows = items.join(decisions, ["run_id", "item_index"]).join(count, "run_id", "left").withColumns({"n0": F.coalesce("n0", F.lit(0)), "action": action, "target": tx.clean(F.col("matched_event_id"))})
    known = events.select("run_id", F.col("event_id").alias("target"), F.lit(True).alias("known"))
    rows = rows.join(known, ["run_id", "target"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    prefix = F.concat(F.lit("evt_"), F.regexp_replace(F.substring("scrape_date", 1, 10), "-", ""), F.lit("_"))
    number = F.when(F.startswith("target", prefix), F.regexp_extract("target", r"_(\d{4,9})$", 1).try_cast("long"))
    number = F.when(number > F.col("n0"), number)
    rows = rows.withColumn("number", F.when((F.col("action") == "assign") & ~F.col("known"), number))
    sure = (F.col("action") == "create") | ((F.col("action") == "assign") & ~F.col("known") & F.col("number").isNull())
    rows = written(rows.withColumn("sure", sure), "membership")
    # an assign that names a number creates while fewer than that many events are there
    counted = running_counts(rows.select("run_id", "item_index", "sure", (F.col("number") - F.col("n0")).alias("bound")))
    rows = rows.join(counted.withColumnRenamed("counts", "creates"), ["run_id", "item_index"])
    rows = rows.withColumn("ordinal", F.when(F.col("creates"), F.col("n0") + F.col("before") + 1).cast("int"))
    made = F.when(F.col("creates"), tx.event_id(F.col("scrape_date"), F.col("ordinal"))).when(F.col("action") == "assign", F.col("target"))
    reason = tx.clean(F.col("reason"))
    out = rows.withColumns({"event_id": made, "classification_decision": F.when(made.isNull(), "discard").otherwise("assign"), "classification_reason": reason, "confidence": tx.classify_confidence(F.col("confidence"))})
    out = written(out.select("run_id", "item_index", "title", "platform", "scrape_date", "ordinal", "creates", "event_id", "classification_decision", "classification_reason", "confidence", "event_label", "event_summary", "event_type", "key_entities"), "membership")
    created = out.where("creates").select("run_id", "ordinal", "event_id", F.coalesce(tx.clean(F.col("event_label")), F.col("title")).alias("event_label"), tx.clean(F.col("event_summary")).alias("event_summary"), tx.extraction_type(F.col("event_type")).alias("event_type"), tx.clean_list(F.col("key_entities")).alias("key_entities"), "confidence", F.col("scrape_date").alias("last_llm_updated_at"))
    lost = out.where("event_id is null").select("run_id", "item_index", "title", "platform", F.lit("event_membership").alias("stage"), F.coalesce("classification_reason", F.lit("LLM discarded during event matching")).alias("reason"))
    return out.select("run_id", "item_index", "classification_decision", "classification_reason", "event_id", "confidence"), created, lost


def _lists(asked: DataFrame, events: DataFrame, named: DataFrame, k: int, hours: int) -> DataFrame:
    """Ranked lists of each seed's nearest events that hold its offer whatever earlier seeds take.

    An event is taken only by a seed that names it and has it among its ``k``
    nearest of those left.  Let every named event of a list count as takeable.
    If each list ends with the last event in reach or holds ``k`` events that
    are not takeable, then no event beyond a list is ever offered (``k`` nearer
    ones are always left), so nothing else is ever taken, and a list holds the
    offer at any time.  Lists that fall short are recalled four times as deep.
    """
    queries = asked.select(F.col("run_id").alias("scope"), F.col("event_id").alias("query_id"), "at", "vector", F.col("event_id").alias("exclude_id"))
    others = events.select(F.col("run_id").alias("scope"), "event_id", "at", "vector", "ordinal")
    ids = named.select(F.col("run_id").alias("scope"), F.col("seed_id").alias("query_id"), F.explode(tx.clean_list(F.col("merge_event_ids"))).alias("event_id")).distinct()
    more = SLACK

    def recalled(some: DataFrame) -> DataFrame:
        return vectors.recall(some, others, k + more, hours).select("scope", "query_id", "event_id", "rank", F.lit(k + more).alias("depth"))

    found = written(recalled(queries), "seed-lists")
    while True:
        takeable = found.join(ids, ["scope", "query_id", "event_id"], "left_semi").select("scope", "event_id", F.lit(1).alias("takeable")).distinct()
        sizes = found.join(takeable, ["scope", "event_id"], "left").groupBy("scope", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count("takeable").alias("taken"), F.max("depth").alias("depth"))
        short = written(sizes.where((F.col("n") >= F.col("depth")) & (F.col("n") - F.col("taken") < k)).select("scope", "query_id"), "seed-short")
        if short.isEmpty():
            return found
        more *= 4
        deeper = recalled(queries.join(short, ["scope", "query_id"], "left_semi"))
        found = written(found.join(short, ["scope", "query_id"], "left_anti").unionByName(deeper), "seed-lists")


def seed_round(events: DataFrame, named: DataFrame, k: int, hours: int) -> DataFrame:
    """One round of EM09: merge groups (run_id, batch_index, merge_groups) that the responses give.

    ``named``: run_id, seed_id, merge_event_ids.  Seeds come in event order;
    an event that an earlier seed took is no seed and no candidate any more.
    A seed's offer is its ``k`` nearest of the events left, from a list of its
    nearest that surely holds them (``_lists``).  Seeds without a response take
    nothing and are left out; the others of a run are replayed in one task, an
    offer of bounded length each.
    """
    asked = events.join(named.select("run_id", F.col("seed_id").alias("event_id")), ["run_id", "event_id"], "left_semi")
    found = _lists(asked, events, named, k, hours)
    offers = found.groupBy(F.col("scope").alias("run_id"), F.col("query_id").alias("seed_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]).alias("offer"))
    seeds = asked.select("run_id", F.col("event_id").alias("seed_id"), "ordinal")
    rows = named.select("run_id", "seed_id", tx.clean_list(F.col("merge_event_ids")).alias("ids")).join(offers, ["run_id", "seed_id"]).join(seeds, ["run_id", "seed_id"])

    def replay(run: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for ordinal, seed, offer, ids in run.sort_values("ordinal")[["ordinal", "seed_id", "offer", "ids"]].itertuples(index=False):
            left = [] if seed in taken else [x for x in offer if x not in taken][:k]
            got = sorted(set(left) & set(ids))
            taken.update(got)
            out += [(run["run_id"].iloc[0], int(ordinal), seed, got)] if got else []
        return pd.DataFrame(out, columns=["run_id", "ordinal", "seed_id", "sources"])

    got = rows.groupBy("run_id").applyInPandas(replay, f"run_id {rows.schema['run_id'].dataType.simpleString()}, ordinal int, seed_id string, sources array<string>")
    group = F.struct(F.col("seed_id").alias("target_event_id"), F.col("sources").alias("source_event_ids"), F.lit(None).cast("string").alias("event_label"), F.lit(None).cast("string").alias("event_summary"))
    return got.select("run_id", F.col("ordinal").alias("batch_index"), F.array(group).alias("merge_groups"))


def seed_merges(events: DataFrame, responses: DataFrame, k: int = 5, hours: int = 72, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """EM09: (events after the rounds, accepted edges with their round).

    ``events``: event fields with run_id, ordinal, at and vector; ``responses``:
    run_id, round, seed_id, merge_event_ids.  Rounds end early when one merges nothing.
    """
    edges = None
    for n in range(1, rounds + 1):
        merges = written(seed_round(events, responses.where(F.col("round") == n), k, hours), "seed-merges")
        if merges.isEmpty():
            break
        events, found = fold.apply_merges(events, merges)
        events = written(events, "seed-events")
        found = found.withColumn("round", F.lit(n))
        edges = found if edges is None else edges.unionByName(found)
    return events, edges


def merge_layer(events: DataFrame, answer: Callable[[DataFrame], DataFrame], size: int = 40, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """EM16: (requests, events after merging): events grouped, one request a group, its answers applied.

    ``events``: event fields with run_id, ordinal and vector; ``answer`` gives
    responses (run_id, batch_index, merge_groups) to requests (run_id,
    group_index, request, size), as landed by whoever calls the model.
    """
    groups = written(greedy.greedy_groups(events.select(*(by or ["run_id"]), "ordinal", F.col("event_id").alias("key"), "vector"), size, by), "merge-groups")
    asked = vectors.batches(events.withColumn("key", F.col("event_id")), groups, EVENT_FIELDS, by)
    merged, _ = fold.apply_merges(events.drop("vector"), answer(asked))
    return asked, merged
