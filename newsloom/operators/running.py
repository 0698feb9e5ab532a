"""Running counts whose steps depend on the count itself, over runs of any size: part of EM08.

A row counts always, or only while the count before it is below the row's
bound.  A stretch of rows turns the count that comes in into the count that
goes out.  That function never falls and rises by 0 or 1 from one count to the
next, so it is its value at 0 and the counts at which it stays level.  Two
passes find every row's count: each stretch is summed up as such a function,
the functions of a run are applied one after another, and each stretch is
replayed from the count that then comes in.  Stretches are range partitions,
so one run is as many tasks as Spark makes of it; only the chain reads a run
as a whole, one stretch at a time, by a binary search in each.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.workdir import written


def summed_up(sure: list[bool], bound: list[float]) -> tuple[int, list[int]]:
    """The stretch as a function: its value at 0, and the counts c with f(c + 1) = f(c), ascending.

    A bounded row raises f up to the first c with f(c) = bound, so f becomes
    level just before that: at the (bound - f(0))-th count that is not level
    yet.  ``bound`` is nan where a row has none.
    """
    start, level = 0, []
    for always, most in zip(sure, bound, strict=True):
        if always:
            start += 1
        elif most == most and most > start:
            nth = int(most) - start  # of the counts at which f still rises
            low, high = 0, len(level)
            while low < high:
                mid = (low + high) // 2
                if level[mid] - mid <= nth - 1:
                    low = mid + 1
                else:
                    high = mid
            level.insert(low, nth - 1 + low)
            start += 1
    return start, level


def applied(start: int, level: np.ndarray | list[int], count: int) -> int:
    """The value of a summed-up stretch at a count."""
    return start + count - (bisect.bisect_left(level, count) if isinstance(level, list) else int(np.searchsorted(level, count)))


def running_counts(rows: DataFrame, run: str = "run_id", place: str = "item_index") -> DataFrame:
    """(run, place, counts, before) of rows (run, place, sure, bound): whether each counts, and how many before it did.

    ``sure`` rows count always; others only if ``bound`` is not null and above
    the count so far.  Rows of a run are taken by place.
    """
    kind, at = (rows.schema[c].dataType.simpleString() for c in (run, place))
    narrow = rows.select(F.col(run).alias("run"), F.col(place).alias("place"), "sure", F.col("bound").cast("double").alias("bound"))
    dealt = narrow.repartitionByRange("run", "place").withColumn("stretch", F.spark_partition_id())
    dealt = written(dealt, "stretches")

    def sums(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "sure", "bound"], kind="stable")
        start, level = summed_up(frame["sure"].tolist(), frame["bound"].tolist())
        return pd.DataFrame({"run": [key[0]], "stretch": [key[1]], "start": [start], "level": [level]})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        for batch in batches:
            runs, stretches, starts, levels = batch.columns
            out = []
            for i in range(batch.num_rows):
                name = runs[i].as_py()
                if name != now:
                    now, count = name, 0
                out.append(count)
                count = applied(starts[i].as_py(), levels[i].values.to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_arrays([runs, stretches, pa.array(out, pa.int64())], ["run", "stretch", "before"])

    summed = dealt.groupBy("run", "stretch").applyInPandas(sums, f"run {kind}, stretch int, start long, level array<long>")
    starts = summed.repartition("run").sortWithinPartitions("run", "stretch").mapInArrow(chain, f"run {kind}, stretch int, before long")

    def replay(key: tuple, frame: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "sure", "bound"], kind="stable")
        count = int(first["before"].iloc[0])
        counts, before = [], []
        for always, most in zip(frame["sure"].tolist(), frame["bound"].tolist(), strict=True):
            hit = always or (most == most and most > count)
            counts.append(hit)
            before.append(count)
            count += hit
        return pd.DataFrame({run: frame["run"].tolist(), place: frame["place"].tolist(), "counts": counts, "before": before})

    return dealt.groupBy("run", "stretch").cogroup(starts.groupBy("run", "stretch")).applyInPandas(replay, f"{run} {kind}, {place} {at}, counts boolean, before long")
