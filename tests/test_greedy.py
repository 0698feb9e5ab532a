import numpy as np
import pytest

from newsloom.operators import greedy

ROWS = "run_id string, ordinal long, key string, vector array<double>, run string, block int"


def rows(seed, n, centres, runs=("a", None)):
    """Clustered vectors with repeats, short, null and zero ones."""
    rnd = np.random.default_rng(seed)
    heads = rnd.normal(size=(centres, 6))
    out = []
    for run in runs:
        for i in range(n):
            v = (heads[rnd.integers(centres)] + rnd.normal(size=6) * rnd.choice([0, 0.1, 1])).round(3).tolist()
            if rnd.random() < 0.05:
                v = [None, [], [0.0] * 6, v[:3]][rnd.integers(4)]
            out.append((run, int(rnd.integers(n // 2)), f"k{i}", v, "own", 1))
    return out


def model(data, size):
    out = set()
    for run in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == run), key=lambda r: (r[1], r[2]))
        width = max(len(v[3] or []) for v in own)
        for g, members in enumerate(greedy.greedy_order(greedy.padded([v[3] for v in own], width), size)):
            out |= {(run, own[i][2], g, p) for p, i in enumerate(members)}
    return out


@pytest.mark.parametrize(("seed", "n", "centres", "size"), [(1, 150, 3, 10), (2, 90, 1, 7), (3, 40, 40, 40), (4, 25, 2, 1)])
def test_rounds_equal_the_sequential_order(spark, monkeypatch, seed, n, centres, size):
    monkeypatch.setattr(greedy, "BLOCK", 37)
    monkeypatch.setattr(greedy, "FIRST_SEEDS", 4)
    monkeypatch.setattr(greedy, "MOST_SEEDS", 16)
    monkeypatch.setattr(greedy, "LIST", 2)
    data = rows(seed, n, centres)
    df = spark.createDataFrame(data, ROWS)
    got = {tuple(r) for r in greedy.greedy_groups(df, size, run_rows=0).select("run_id", "key", "group_index", "position").collect()}
    assert got == model(data, size)


def test_small_and_large_runs_together(spark):
    data = rows(5, 60, 2, runs=("a",)) + rows(6, 20, 2, runs=("b",))
    got = {tuple(r) for r in greedy.greedy_groups(spark.createDataFrame(data, ROWS), 8, run_rows=30).select("run_id", "key", "group_index", "position").collect()}
    assert got == model(data, 8)


def test_no_rows(spark):
    assert greedy.greedy_groups(spark.createDataFrame([], ROWS)).collect() == []
