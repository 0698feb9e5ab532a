"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target share of all words.  A document of a source starts
with the same fractional number of copies, target / source size.  The
fractional parts are rounded in pairs: mass moves between two documents, in a
random direction that keeps the expected copies and exactly keeps the words of
the pair, until one of the two is integral; the other goes on to the next
pair.  Buckets of a source are rounded apart, and the one document that stays
fractional in each goes on to the next level of a reduction tree, so a source
ends within one document of its target.

Randomness comes from hashes of source, level and bucket: reruns agree.
Nulls: a null text has size 0, a null source is a source of its own, last in
order.  Documents of size 0 take the whole part of their copies.  Repeated
rows are rounded each on their own.  An empty table gives an empty result.
There is one row for each source in one task when the targets are set.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
#: Rows rounded in one bucket, and residuals combined at once, on average.
BUCKET_ROWS, FAN = 2_000, 1000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, documents, weight and target.

    Sources by code point, null last, take the weights in turn.  Targets sum
    to all words and stop at ``most`` times the source's size; the level that
    the others share is found where capping all cheaper sources leaves it at
    or below the next one's cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("share", left / free)
    per = per.withColumn("share", F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "share"))).over(every)["share"])
    return per.select("source", "source_size", "documents", "weight", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def pivotal(part: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Fractional parts rounded in pairs, words kept; at most one stays fractional."""
    out = part.copy()
    open_ = -1
    for i in range(len(out)):
        x = out[i]
        if x <= 0.0 or x >= 1.0 or size[i] <= 0:
            continue
        if open_ < 0:
            open_ = i
            continue
        y, a, b = out[open_], size[open_], size[i]
        up, down = min((1 - y) * a, x * b), min(y * a, (1 - x) * b)
        if draw[i] * (up + down) < down:
            full, empty = (1 - y) * a <= x * b, x * b <= (1 - y) * a
            y, x = (1.0 if full else y + up / a), (0.0 if empty else x - up / b)
        else:
            empty, full = y * a <= (1 - x) * b, (1 - x) * b <= y * a
            y, x = (0.0 if empty else y - down / a), (1.0 if full else x + down / b)
        out[open_], out[i] = y, x
        if 0.0 < y < 1.0:
            continue
        open_ = i if 0.0 < x < 1.0 else -1
    return out


def _rounder(seed: int, level: int, last: bool):
    """The grouped function of one level; the last leaves nothing fractional."""

    def round_bucket(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row_key", "doc_id", "size"], kind="stable").reset_index(drop=True)
        size = frame["size"].to_numpy(float)
        state = int(frame["row_key"].min()) & (2**63 - 1)
        draw = np.random.Generator(np.random.PCG64([seed, level, state, int(key[1])])).random(len(frame) + 1)
        part = pivotal(frame["part"].to_numpy(float), size, draw)
        if last:
            rest = (part > 0) & (part < 1)
            part[rest] = np.where(draw[-1] < part[rest], 1.0, 0.0)
        part[size <= 0] = 0.0
        frame["copies"] += (part >= 1.0).astype("int64")
        frame["part"] = np.where(part >= 1.0, 0.0, part)
        frame["bucket"] //= FAN
        return frame

    return round_bucket


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """Per row: doc_id, source, size, row_key, source_size, target, copies.

    ``row_key`` hashes id, source and text, to find the row again.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_key"))
    sizes = scratch.save(sizes, "sizes")
    targets = scratch.save(source_targets(sizes, weights, most).withColumn("buckets", F.ceil(F.col("documents") / BUCKET_ROWS).cast("long")), "targets")
    # a source may hold most rows: both sides are salted
    salted = sizes.withColumn("salt", F.pmod("row_key", F.lit(16)))
    wide = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumnRenamed("source", "s")
    rows = salted.join(wide, (salted["salt"] == wide["salt"]) & salted["source"].eqNullSafe(wide["s"])).drop("salt", "s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).select("doc_id", "source", "size", "row_key", "source_size", "target", F.floor("ratio").cast("long").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("part"), F.pmod(F.xxhash64(F.lit(seed), "row_key"), "buckets").alias("bucket"))
    most_buckets = targets.agg(F.max("buckets")).first()[0] or 1
    levels = 1 + (math.ceil(math.log(most_buckets, FAN)) if most_buckets > 1 else 0)
    schema = rows.schema

    done, fractional = [], rows
    for level in range(levels):
        got = scratch.save(fractional.groupBy("source", "bucket").applyInPandas(_rounder(seed, level, level == levels - 1), schema), f"level{level}")
        done.append(got.where("part <= 0"))
        fractional = got.where("part > 0")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "row_key", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (not at all, or repeated); columns may have any names."""
    columns = docs.columns
    order = Window.partitionBy("row_key").orderBy(F.lit(0))
    taken = mix(docs, weights, most, seed).where("copies > 0").select("row_key", "copies")
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy(F.desc("copies"))))
    names = [f"c{i}" for i in range(len(columns))]
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64("doc_id", "source", "text").alias("row_key_of_mix")).toDF(*names, "row_key")
    rows = keyed.withColumn("nth", F.row_number().over(order))
    joined = rows.join(taken, ["row_key", "nth"])
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names).toDF(*columns)
