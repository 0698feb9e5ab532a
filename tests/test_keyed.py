import pytest
from pyspark.sql import functions as F

from newsloom.sources.keyed import KeyedTable

SCHEMA = "k string, v string, created_at long"


def rows(spark, *tuples):
    return spark.createDataFrame(list(tuples), SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "created_at", 8)
    assert held(table) == []
    table.upsert(rows(spark, *[(f"k{i}", "old", i) for i in range(60)], ("k1", "older", 0)))
    before = table.manifest()["buckets"]
    files = set(table.read().inputFiles())
    table.upsert(rows(spark, ("k3", "new", 1), ("k3", "newer", 2), ("x", None, 3)))
    after = table.manifest()["buckets"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2
    assert {f for f in files if not any(f"/bucket={b}/" in f for b in changed)} == set(table.read().inputFiles()) & files
    want = {f"k{i}": ("old", i) for i in range(60)} | {"k3": ("newer", 2), "x": (None, 3)}
    assert held(table) == sorted(((k, *v) for k, v in want.items()), key=str)


def test_a_failed_update_leaves_the_old_version(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "created_at", 4)
    table.upsert(rows(spark, ("a", "1", 1)))
    broken = rows(spark, ("a", "2", 2)).withColumn("v", F.when(F.col("k") == "a", F.raise_error(F.lit("stop"))).otherwise("x"))
    with pytest.raises(Exception, match="stop"):
        table.upsert(broken)
    assert held(table) == [("a", "1", 1)]
    table.upsert(rows(spark, ("b", "1", 1)))
    assert held(table) == [("a", "1", 1), ("b", "1", 1)]


def test_a_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "created_at", 4)
    assert table.upsert(rows(spark, ("a", "1", 1)), ("s", 0))
    assert not table.upsert(rows(spark, ("a", "again", 9)), ("s", 0))
    assert table.upsert(rows(spark), ("s", 1)) and table.upsert(rows(spark, (None, "null key", 1)), ("other", 0))
    assert held(table) == sorted([("a", "1", 1), (None, "null key", 1)], key=str)
