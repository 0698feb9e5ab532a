"""Greedy similarity groups, exact at any size of a run: EM01, EM02.

The order is sequential: the first pending row takes its ``size - 1`` nearest
pending rows, then the next pending row takes its own.  A run of up to
``RUN_ROWS`` rows is one task's work.  A larger one goes in rounds.  In each,
the first rows of the run are taken for seeds by speculation: for each of them
the ``LIST`` times ``size`` nearest rows behind it are found among all open
rows, by matrix products over blocks of bounded size that Spark deals out.
One short replay then walks these seeds in order.  A row that an earlier seed
took is no seed.  A seed takes the nearest rows of its list that are still
free.  A seed of whose list too little is left cannot be decided, since the
rows beyond its list are unknown; it ends the round, and so the result is
that of the sequential order.  Rows of decided groups leave the open table.
The first seed of a round is always decided.  Rounds take twice as many seeds
as were decided in the one before, up to ``MOST_SEEDS``.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.workdir import written

#: Rows of a run that one task may group by itself.
RUN_ROWS = 20_000
#: Rows of a block of open rows, seeds of a run in the first and in any round, and the length of a seed's list in groups.
BLOCK, FIRST_SEEDS, MOST_SEEDS, LIST = 10_000, 64, 2048, 4
#: Runs that are broadcast at most, with their width.
BROADCAST_RUNS = 100_000


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    norm = np.sqrt((vectors * vectors).sum(axis=1)) if vectors.size else np.zeros(len(vectors))
    return np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)


def padded(vectors: list, width: int) -> np.ndarray:
    """Vectors of the run's width as rows; others, of another length or null, have no direction."""
    return np.array([np.asarray(v, float) if v is not None and len(v) == width else np.zeros(width) for v in vectors]).reshape(len(vectors), width)


def greedy_order(vectors: np.ndarray, size: int) -> list[list[int]]:
    """EM01: the first pending row and its size - 1 nearest, ties in order, again and again."""
    unit = unit_rows(vectors)
    left = np.arange(len(vectors))
    groups = []
    while len(left):
        rest = left[1:]
        near = rest[np.argsort(-np.round(unit[rest] @ unit[left[0]], 12), kind="stable")[: size - 1]]
        groups.append([int(left[0]), *near.tolist()])
        left = np.setdiff1d(rest, near, assume_unique=True)
    return groups


def _schema(rows: DataFrame, by: list[str]) -> str:
    return ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in by] + ["key string", "group_index int", "position int"])


def _small_runs(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Groups of runs that fit a task."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ordinal", "key"], kind="stable").reset_index(drop=True)
        width = max((len(v) for v in frame["vector"] if v is not None), default=0)
        out = [(i, g, p) for g, members in enumerate(greedy_order(padded(frame["vector"].tolist(), width), size)) for p, i in enumerate(members)]
        made = frame.loc[[i for i, *_ in out], [*by, "key"]].reset_index(drop=True)
        made["group_index"], made["position"] = [g for _, g, _ in out], [p for *_, p in out]
        return made

    return rows.groupBy(*by).applyInPandas(group, _schema(rows, by))


def _behind(places: list[tuple], seed: tuple) -> int:
    """Index of the first place after the seed."""
    return bisect.bisect_right(places, seed)


def _lists(open_: DataFrame, seeds: int, length: int) -> DataFrame:
    """(run, s_ordinal, s_key, near): for the first rows of each run, the nearest open rows behind them."""
    first = Window.partitionBy("run").orderBy("ordinal", "key")
    taken = open_.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= seeds)
    packed = taken.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("ordinal", "key", "vector", "width"))).alias("seeds"))  # bounded by the number of seeds
    blocks = open_.groupBy("run", "block").agg(F.array_sort(F.collect_list(F.struct("ordinal", "key", "vector"))).alias("rows"))
    cells = blocks.join(packed, "run").select("run", "seeds", "rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, s, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = s[0]["width"]
                x, y = (unit_rows(padded([v["vector"] for v in side], width)) for side in (s, r))
                places = [(v["ordinal"], v["key"]) for v in r]
                ordinals, keys = np.array([o for o, _ in places], np.int64), np.array([k for _, k in places], object)
                for start in range(0, len(s), 256):
                    score = np.round(x[start : start + 256] @ y.T, 12)
                    for seed, own in zip(s[start : start + 256], score, strict=True):
                        behind = _behind(places, (seed["ordinal"], seed["key"]))
                        near = behind + np.argsort(-own[behind:], kind="stable")[:length]
                        if len(near):
                            n = len(near)
                            yield pa.RecordBatch.from_arrays([pa.array([run] * n), pa.array([seed["ordinal"]] * n, pa.int64()), pa.array([seed["key"]] * n), pa.array(ordinals[near]), pa.array(keys[near].tolist()), pa.array(own[near])], ["run", "s_ordinal", "s_key", "ordinal", "key", "similarity"])

    found = cells.mapInArrow(search, "run string, s_ordinal long, s_key string, ordinal long, key string, similarity double")
    best = Window.partitionBy("run", "s_ordinal", "s_key").orderBy(F.desc("similarity"), "ordinal", "key")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= length)
    near = ranked.groupBy("run", "s_ordinal", "s_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("near"))
    # the last row of a run has nothing behind it
    return taken.select("run", F.col("ordinal").alias("s_ordinal"), F.col("key").alias("s_key")).join(near, ["run", "s_ordinal", "s_key"], "left")


def _replayed(lists: DataFrame, size: int, length: int) -> DataFrame:
    """Decided groups of one round: (run, key, seed, position)."""

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out: list[tuple] = []
        seed = 0
        for run, key, near in frame.sort_values(["s_ordinal", "s_key"], kind="stable")[["run", "s_key", "near"]].itertuples(index=False):
            if key in taken:
                continue
            listed = [] if near is None else near
            free = [x for x in listed if x not in taken][: size - 1]
            if len(free) < size - 1 and len(listed) == length:
                break
            taken.update([key, *free])
            out += [(run, m, seed, p) for p, m in enumerate([key, *free])]
            seed += 1
        return pd.DataFrame(out, columns=["run", "key", "seed", "position"])

    return lists.groupBy("run").applyInPandas(replay, "run string, key string, seed int, position int")


def _large_runs(open_: DataFrame, size: int) -> DataFrame:
    """(run, key, group_index, position) of runs that no task has to hold, by rounds."""
    length = max(size * LIST, 2)
    open_ = written(open_, "greedy-open")
    rounds: list[DataFrame] = []
    seeds = FIRST_SEEDS
    while not open_.isEmpty():
        got = written(_replayed(_lists(open_, seeds, length), size, length).withColumn("round", F.lit(len(rounds))), "greedy-round")
        rounds.append(got)
        done = got.where("position = 0").groupBy("run").count().agg(F.avg("count")).first()[0]
        seeds = int(min(MOST_SEEDS, max(FIRST_SEEDS, 2 * done)))
        open_ = written(open_.join(got.select("run", "key"), ["run", "key"], "left_anti").select(open_.columns), "greedy-open")
    every = functools.reduce(DataFrame.unionByName, rounds)
    # groups are numbered on from round to round: a row for each run and round
    counts = every.where("position = 0").groupBy("run", "round").count()
    before = F.sum("count").over(Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(counts.select("run", "round", F.coalesce(before, F.lit(0)).alias("start")), "greedy-starts")
    numbered = every.join(F.broadcast(starts) if starts.count() <= BROADCAST_RUNS else starts, ["run", "round"])
    return numbered.select("run", "key", (F.col("start") + F.col("seed")).cast("int").alias("group_index"), "position")


def greedy_groups(rows: DataFrame, size: int = 40, by: list[str] | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """EM01/EM02: (keys, key, group_index, position) of the greedy groups of each run.

    ``rows``: the ``by`` columns (default run_id), ordinal, key, vector; keys
    are distinct within a run, equal ordinals are ordered by key.  A vector
    that is null or shorter than the run's longest has no direction and is
    equally far from all.  Runs of more than ``run_rows`` rows are grouped in
    rounds over all executors, with the same result.
    """
    by = by or ["run_id"]
    size = max(1, size)
    rows = rows.select(*by, F.col("ordinal").cast("long").alias("ordinal"), F.col("key").cast("string").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    run = F.to_json(F.struct(*by))  # a run by name, null keys included
    sizes = rows.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.size("vector"), F.lit(0))).alias("width"))
    large = written(sizes.where(F.col("n") > run_rows), "greedy-runs")
    few = large.count()
    if not few:
        return _small_runs(rows, by, size)
    if few <= BROADCAST_RUNS:
        large = F.broadcast(large)
    named = rows.withColumn("run", run)
    tagged = named.join(large, "run").select("run", "ordinal", "key", "vector", F.coalesce("width", F.lit(0)).alias("width"), F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).alias("block"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    grouped = _large_runs(tagged, size).withColumn("of", F.from_json("run", kinds)).select(*[F.col(f"of.{c}").alias(c) for c in by], "key", "group_index", "position")
    return _small_runs(named.join(large, "run", "left_anti").drop("run"), by, size).unionByName(grouped)
