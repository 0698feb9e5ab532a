import math

import numpy as np

from newsloom.llm import topk


def brute(rows, k=20):
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=24).astype("float32").tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 24), (503, [float("inf")] * 24), (None, rows[0][1]), (520, [])]
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.exact_top_k(df).collect()))
    assert got == brute(rows)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.exact_top_k(df).collect())) == [(0, 1, 3, 64 * 32 - 128 * 64)]
    assert topk.exact_top_k(df.limit(0)).collect() == []


def test_large_components(spark):
    rows = [(0, [3e9, 2.0]), (1, [1.0, 5.0]), (2, [2.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.exact_top_k(df).collect())) == brute(rows)


def test_repeated_rows(spark):
    """Equal query rows ask once; equal candidates count each; an id with two vectors asks for both."""
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).astype("float32").tolist()) for i in range(1, 41)]
    got = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame([*rows, rows[19]], "vec_id long, embedding array<float>")).collect()))
    assert [x for x in got if x[0] == 20] == [x for x in brute(rows) if x[0] == 20]
    forty = [x for x in got if x[0] == 40]
    assert len(forty) == 20 and sum(x[2] == 20 for x in forty) in (0, 1, 2)
    two = spark.createDataFrame([*rows, (20, [9.0] * 6)], "vec_id long, embedding array<float>")
    assert sum(x.query_id == 20 for x in topk.exact_top_k(two).collect()) == 40
