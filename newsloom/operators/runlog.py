"""Run-log analytics: AG09-AG28, JN13-JN17, WN08, WN09, FL17, FL20-FL22.

Tables: ``tasks`` (task_id, run_id, step_id, state, depends_on, task_group_id,
parent_task_id, concurrency_key, max_concurrency, attempt, max_attempts,
next_attempt_at, started_at), ``log`` (ts, task_id, type, state, attempt,
error, reason), ``checkpoints`` (run_id, step_id, task_id, status, output_refs,
finished_at, path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import rules
from newsloom.functions import text as tx

ACTIVE, SUCCESS, TERMINAL, HISTORY = rules.ACTIVE_STATES, rules.SUCCESS_STATES, rules.TERMINAL_STATES, rules.HISTORY_TYPES


def _count(states: list[str]) -> Column:
    return F.count_if(F.col("state").isin(states))


def state_counts(tasks: DataFrame, by: list[str]) -> DataFrame:
    """AG11: tasks by state."""
    return tasks.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("tasks"))


def status_summary(tasks: DataFrame, by: list[str]) -> DataFrame:
    """AG12/AG13: totals by class of state; ``by_state`` is a map."""
    per = state_counts(tasks.where("state is not null and state <> ''"), by)
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "tasks")))).alias("by_state")
    total = lambda names, name: F.sum(F.when(F.col("state").isin(names), F.col("tasks")).otherwise(0)).alias(name)
    return per.groupBy(*by).agg(F.sum("tasks").alias("total"), states, total(ACTIVE, "active"), total(TERMINAL, "terminal"), total(["succeeded"], "succeeded"), total(["failed", "cancelled"], "failed"), total(["blocked"], "blocked"))


def rolled_up(default: str = "idle") -> Column:
    """AG14/AG17: the state of a set of tasks, in order of gravity; for use in agg()."""
    has = lambda names: F.bool_or(F.col("state").isin(names))
    return (
        F.when(has(["failed"]), "failed").when(has(["blocked"]), "blocked").when(has(["running"]), "running").when(has(["queued", "waiting"]), "queued")
        .when(F.bool_and(F.col("state") == "succeeded"), "succeeded").when(F.bool_and(F.col("state").isin(TERMINAL)), "partial").otherwise(default)
    )


def step_views(tasks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """AG15/AG14/AG23: one row for each step: status, counts, ids by class, steps before it, last checkpoint."""
    named = tasks.select("task_id", F.col("step_id").alias("before"))
    edges = tasks.select("run_id", "step_id", F.explode("depends_on").alias("task_id")).join(named, "task_id").where("before <> step_id").groupBy("run_id", "step_id").agg(F.array_sort(F.collect_set("before")).alias("depends_on_steps"))
    ids = lambda states, name: F.array_sort(F.collect_list(F.when(F.col("state").isin(states), F.col("task_id")))).alias(name)
    steps = tasks.groupBy("run_id", "step_id").agg(rolled_up().alias("task_status"), F.count(F.lit(1)).alias("tasks"), ids(ACTIVE, "active_ids"), ids(["blocked"], "blocked_ids"), ids(["failed", "cancelled"], "failed_ids"))
    last = latest_checkpoints(checkpoints, ["run_id", "step_id"]).select("run_id", "step_id", F.col("status").alias("checkpoint_status"), F.col("path").alias("checkpoint_path"))
    out = steps.join(edges, ["run_id", "step_id"], "left").join(last, ["run_id", "step_id"], "full")
    status = F.when(F.col("task_status").isNull() | (F.col("task_status") == "idle"), F.coalesce("checkpoint_status", F.lit("idle"))).otherwise(F.col("task_status"))
    return out.withColumn("status", status).drop("task_status")


def latest_checkpoints(checkpoints: DataFrame, by: list[str]) -> DataFrame:
    """WN08: the latest row of each key."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("finished_at"), F.desc("path"))
    return checkpoints.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def pipeline_status(steps: DataFrame, descriptors: DataFrame) -> DataFrame:
    """AG16: status of each declared step from the concrete ones, by id or prefix.

    ``descriptors``: pipeline_step, ids, prefixes.  They are a handful of
    declared rows; expanding a step's own prefixes keeps the join an equi-join.
    """
    ids = descriptors.select("pipeline_step", F.explode(F.array_distinct(F.concat(F.array("pipeline_step"), "ids"))).alias("key"))
    prefixes = descriptors.select("pipeline_step", F.explode("prefixes").alias("key"))
    lead = F.transform(F.sequence(F.lit(1), F.length("step_id")), lambda n: F.substring(F.col("step_id"), F.lit(1), n))
    matched = steps.join(ids, steps["step_id"] == ids["key"]).unionByName(steps.withColumn("lead", F.explode(lead)).join(prefixes, F.col("lead") == F.col("key")).drop("lead")).dropDuplicates(["run_id", "step_id", "pipeline_step"])
    has = lambda s: F.bool_or(F.col("status") == s)
    state = reduce(lambda acc, s: F.when(has(s), s).otherwise(acc), reversed(["failed", "blocked", "running", "queued", "partial"]), F.when(F.bool_and(F.col("status") == "succeeded"), "succeeded").otherwise(F.max_by("status", "step_id")))
    found = matched.groupBy("run_id", "pipeline_step").agg(state.alias("status"), F.array_sort(F.collect_set("step_id")).alias("step_ids"))
    # every run has every declared step: a plain product of two short lists, the declared one in one row
    declared = descriptors.agg(F.collect_set("pipeline_step").alias("declared"))
    runs = steps.select("run_id").distinct().withColumn("one", F.lit(1)).join(declared.withColumn("one", F.lit(1)), "one").select("run_id", F.explode("declared").alias("pipeline_step"))
    return runs.join(found, ["run_id", "pipeline_step"], "left").withColumn("status", F.coalesce("status", F.lit("idle")))


def run_list(runs: DataFrame, tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """AG17/AG18/AG28/SRC15: runs with derived state and summaries, for listing newest first."""
    ids = lambda states, name: F.array_sort(F.collect_list(F.when(F.col("state").isin(states), F.col("task_id")))).alias(name)
    per = tasks.groupBy("run_id").agg(rolled_up(None).alias("derived"), F.count(F.lit(1)).alias("tasks"), ids(ACTIVE, "active_ids"), ids(["blocked"], "blocked_ids"), ids(["failed"], "failed_ids"))
    done = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "succeeded").alias("steps_succeeded"), F.max("status").alias("any_step"))
    out = runs.join(per, "run_id", "left").join(done, "run_id", "left")
    return out.withColumn("state", F.coalesce("derived", "any_step", "state")).drop("derived", "any_step")


def dependency_blocks(tasks: DataFrame) -> DataFrame:
    """JN13: each task's first dependency that is missing or ended badly."""
    edges = tasks.select("task_id", F.posexplode("depends_on").alias("pos", "dependency_id"))
    parents = tasks.select(F.col("task_id").alias("dependency_id"), F.col("state").alias("dependency_state"))
    bad = edges.join(parents, "dependency_id", "left").withColumn("dependency_state", F.coalesce("dependency_state", F.lit("missing")))
    bad = bad.where((F.col("dependency_state") == "missing") | (F.col("dependency_state").isin(TERMINAL) & ~F.col("dependency_state").isin(SUCCESS)))
    first = bad.groupBy("task_id").agg(F.min_by(F.struct("dependency_id", "dependency_state"), "pos").alias("d"))
    return first.select("task_id", F.lit("dependency").alias("kind"), "d.*")


def waiting(tasks: DataFrame, now: Column) -> DataFrame:
    """AG19/JN13: why a waiting task waits: retry window, unfinished dependency or concurrency."""
    open_ = tasks.where(F.col("state").isin("queued", "waiting"))
    edges = open_.select("task_id", F.posexplode("depends_on").alias("pos", "dependency_id"))
    parents = tasks.select(F.col("task_id").alias("dependency_id"), F.col("state").alias("dependency_state")).where(~F.col("dependency_state").isin(TERMINAL))
    first = edges.join(parents, "dependency_id").groupBy("task_id").agg(F.min_by("dependency_id", "pos").alias("dependency_id"))
    running = tasks.where("state = 'running' and concurrency_key is not null").groupBy("concurrency_key").agg(F.count(F.lit(1)).alias("running"))
    out = open_.join(first, "task_id", "left").join(running, "concurrency_key", "left")
    kind = F.when(F.col("next_attempt_at") > now, "retry_window").when(F.col("dependency_id").isNotNull(), "dependency").when(F.coalesce(F.col("running") >= F.col("max_concurrency"), F.lit(False)), "concurrency")
    return out.select("run_id", "task_id", kind.alias("kind"), "dependency_id", "next_attempt_at").where("kind is not null")


def waiting_groups(found: DataFrame) -> DataFrame:
    """AG19: waiting tasks by kind, and the next retry."""
    return found.groupBy("run_id", "kind").agg(F.array_sort(F.collect_list("task_id")).alias("task_ids"), F.min("next_attempt_at").alias("next_attempt_at"))


def missing_tasks(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """JN15: task ids that a run names and no task has."""
    return runs.select("run_id", F.explode("task_ids").alias("task_id")).join(tasks.select("task_id"), "task_id", "left_anti")


def relatives(tasks: DataFrame) -> DataFrame:
    """JN16: counts of dependents, children and group members of each task."""
    dependents = tasks.select(F.explode("depends_on").alias("task_id")).groupBy("task_id").agg(F.count(F.lit(1)).alias("dependents"))
    children = tasks.where("parent_task_id is not null").groupBy(F.col("parent_task_id").alias("task_id")).agg(F.count(F.lit(1)).alias("children"))
    groups = tasks.where("task_group_id is not null").groupBy("task_group_id").agg(F.count(F.lit(1)).alias("group_members"))
    out = tasks.select("task_id", "task_group_id").join(dependents, "task_id", "left").join(children, "task_id", "left").join(groups, "task_group_id", "left")
    return out.select("task_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dependents", "children", "group_members")])


def task_checkpoints(tasks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """JN17: each task with its number of checkpoints and the latest path."""
    per = checkpoints.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("checkpoints"), F.max_by("path", F.struct("finished_at", "path")).alias("latest_path"))
    return tasks.select("run_id", "task_id").join(per, ["run_id", "task_id"], "left").fillna(0, ["checkpoints"])


def merge_steps(current: DataFrame, persisted: DataFrame, key: list[str], lists: list[str]) -> DataFrame:
    """JN14/ST02: current values before persisted ones; empty lists count as missing."""
    a, b = current.alias("a"), persisted.alias("b")
    out = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    pick = lambda c: F.coalesce(F.when(F.size(f"a.{c}") > 0, F.col(f"a.{c}")), F.col(f"b.{c}"), F.col(f"a.{c}")) if c in lists else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return out.select(*[pick(c).alias(c) for c in current.columns])


def attempt_history(log: DataFrame) -> DataFrame:
    """WN09: lifecycle entries of each task in order, with the seconds since the one before."""
    order = Window.partitionBy("task_id").orderBy("ts", "seq") if "seq" in log.columns else Window.partitionBy("task_id").orderBy("ts")
    rows = log.where(F.col("type").isin(HISTORY))
    return rows.withColumns({"nth": F.row_number().over(order), "since": F.unix_seconds("ts") - F.unix_seconds(F.lag("ts", 1).over(order))})


def retry_state() -> Column:
    """FL21: struct(status, remaining) of a task row with retry_scheduled."""
    used, most = F.greatest(F.coalesce("attempt", F.lit(0)), F.lit(0)), F.greatest(F.coalesce("max_attempts", F.lit(1)), F.lit(1))
    status = F.when(F.coalesce("retry_scheduled", F.lit(False)) | (F.col("state") == "waiting"), "scheduled").when((F.col("state") == "running") & (most > 1), "running").when((used > 0) | F.col("state").isin("failed", "cancelled", "blocked"), "attempted").otherwise("idle")
    return F.struct(status.alias("status"), F.greatest(most - used, F.lit(0)).alias("remaining"))


def blocked_state(reason: Column, kind: Column) -> Column:
    """FL22: struct(blocked, safe_to_skip)."""
    return F.struct(((F.col("state") == "blocked") | (F.coalesce(reason, F.lit("")) != "")).alias("blocked"), F.coalesce(kind.isin("dependency", "business"), F.lit(False)).alias("safe_to_skip"))


def failure(error: Column, contract: Column) -> Column:
    """FL17: struct(code, retryable, unrepairable) of a scrape error; ``contract``: it was a contract error."""
    low = F.lower(F.coalesce(error, F.lit("")))
    code = F.when(tx.any_in(low, rules.ACCESS_WORDS), "blocked").when(tx.any_in(low, rules.NETWORK_WORDS), "network_error").when(contract, "contract_error").otherwise("parse_error")
    return F.struct(code.alias("code"), (code == "network_error").alias("retryable"), code.isin("blocked", "network_error").alias("unrepairable"))


def scrape_outcomes(attempts: DataFrame, most: int) -> DataFrame:
    """AG24: final state of each scrape from its attempts (job_id, attempt, ok, error, contract)."""
    last = attempts.groupBy("job_id").agg(F.max("attempt").alias("attempts"), F.max_by(F.struct("ok", "error", "contract"), "attempt").alias("l"))
    code = failure(F.col("l.error"), F.coalesce("l.contract", F.lit(False)))
    out = last.withColumn("f", code)
    state = F.when(F.col("l.ok"), "succeeded").when(F.col("f.retryable") & (F.col("attempts") < most), "retrying").when(F.col("f.unrepairable"), "skipped_unrepairable").otherwise("repairing")
    return out.select("job_id", "attempts", state.alias("state"), F.when(~F.col("l.ok"), F.col("f.code")).alias("code"))


def artifacts(checkpoints: DataFrame) -> DataFrame:
    """AG22/AG26: artifacts from reference maps, the last of each role and path, by name."""
    rows = None
    for role in ("input", "output"):
        if f"{role}_refs" in checkpoints.columns:
            one = checkpoints.select("run_id", "finished_at", F.lit(role).alias("role"), F.explode(f"{role}_refs").alias("name", "path"))
            rows = one if rows is None else rows.unionByName(one)
    order = Window.partitionBy("run_id", "role", "path").orderBy(F.desc("finished_at"), F.desc("name"))
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def source_diagnostics(sources: DataFrame, steps: DataFrame) -> DataFrame:
    """FL20/AG20: active flag and reasons of each source.

    ``sources``: source_id, enabled, redirect; ``steps``: source_id, state, items.
    """
    out = sources.join(steps, "source_id", "left")
    reasons = F.array_compact(F.array(F.when(~F.col("enabled"), "disabled"), F.when(F.coalesce("redirect", F.lit("")) != "", "redirect"), F.when(F.col("state").isNull(), "no_step"), F.when(F.col("state") == "failed", "failed"), F.when(F.col("items") == 0, "no_items")))
    return out.withColumns({"reasons": reasons, "active": F.col("enabled") & (F.coalesce("redirect", F.lit("")) == "")})


def report_stats(events: DataFrame) -> DataFrame:
    """AG09: events, selected and sourced of each report."""
    return events.groupBy("report_date").agg(F.count(F.lit(1)).alias("events"), F.count_if("should_include_report").alias("selected"), F.count_if(F.size("source_items") > 0).alias("with_sources"))


def classify_stats(items: DataFrame, events: DataFrame, discards: DataFrame, edges: DataFrame) -> DataFrame:
    """AG10: counts of a classify run."""
    per = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    out = per(items, "items").join(per(events, "events"), "run_id", "left").join(per(discards, "discarded"), "run_id", "left").join(per(edges, "merged_events"), "run_id", "left")
    return out.fillna(0)


def dataset_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """AG21: (dataset, items) of each named table."""
    rows = [df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("dataset"), "items") for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)
