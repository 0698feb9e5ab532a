import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.running import applied, running_counts, summed_up


def plain(rows, count=0):
    out = []
    for sure, bound in rows:
        hit = sure or (bound is not None and bound > count)
        out.append((hit, count))
        count += hit
    return out, count


def test_a_stretch_is_its_function():
    for seed in range(200):
        rnd = random.Random(seed)
        rows = [(rnd.random() < 0.3, rnd.choice([None, rnd.randrange(-2, 25)])) for _ in range(rnd.randrange(30))]
        start, level = summed_up([s for s, _ in rows], [float("nan") if b is None else float(b) for _, b in rows])
        assert level == sorted(set(level))
        for count in range(40):
            assert applied(start, level, count) == plain(rows, count)[1]


@pytest.mark.parametrize("parts", [1, 5])
def test_counts_over_many_stretches(spark, parts):
    rnd = random.Random(parts)
    rows = [(run, i, rnd.random() < 0.2, rnd.choice([None, rnd.randrange(60)])) for run in ("a", "b", None) for i in range(150 if run != "b" else 3)]
    rnd.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.run_id, r.item_index): (r.counts, r.before) for r in running_counts(spark.createDataFrame(rows, "run_id string, item_index int, sure boolean, bound long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for run in ("a", "b", None):
        own = sorted(((i, s, b) for x, i, s, b in rows if x == run), key=lambda r: r[0])
        assert [got[run, i] for i, *_ in own] == plain([(s, b) for _, s, b in own])[0]


def test_no_rows(spark):
    assert running_counts(spark.createDataFrame([], "run_id string, item_index int, sure boolean, bound long")).collect() == []


def test_a_run_of_a_million_rows_is_many_tasks(spark):
    """One run, bounds that grow with the place: counts equal a plain loop at the end of it."""
    n = 1_000_000
    rows = spark.range(0, n, 1, 4).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("item_index"), (F.col("id") % 7 == 0).alias("sure"), F.when(F.col("id") % 3 == 1, F.col("id") % 1000 * 300).alias("bound"))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        out = running_counts(rows)
        got = out.agg(F.sum(F.col("counts").cast("long")), F.sum("before"), F.count(F.lit(1))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    made, count = plain((i % 7 == 0, i % 1000 * 300 if i % 3 == 1 else None) for i in range(n))
    assert tuple(got) == (count, sum(b for _, b in made), n)
