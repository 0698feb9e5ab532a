import numpy as np

from newsloom.llm import mixing


def water(sizes, weights, most):
    """Targets by repeated resharing."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, mass = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / mass > most * sizes[i]]
        if not over:
            return [fixed.get(i, left * weights[i] / mass if mass else 0) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


def rows(seed, n=800):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        source = [None, "a", "b", "B", "ü", "zz"][r.choice(6, p=[0.1, 0.4, 0.02, 0.2, 0.08, 0.2])]
        out.append((i, " \t".join(["w"] * int(r.integers(0, 60))) or None, source))
    return [*out, out[3], out[3], (n, "long " * 3000, "a")]


def test_targets_and_rounding(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN", 4)
    data = rows(1)
    df = spark.createDataFrame([(*x, 7) for x in data], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    names = sorted({x[2] for x in data}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len((x[1] or "").split()) for x in data if x[2] == s) for s in names]
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 for r in own)
        assert all(0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - target) <= max(r.size for r in own) + 1e-6
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(tuple, map(lambda r: (r.doc_id, r.size, r.copies), got))) == sorted((r.doc_id, r.size, r.copies) for r in again)


def test_pivotal_keeps_words_and_expectation():
    r = np.random.default_rng(2)
    size = r.integers(1, 50, 40).astype(float)
    part = r.random(40)
    mean = np.zeros(40)
    for _ in range(3000):
        out = mixing.pivotal(part, size, r.random(41))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1
        mean += out / 3000
    assert np.abs(mean - part).max() < 0.05


def test_apply_repeats_rows(spark):
    df = spark.createDataFrame(rows(3, 100), "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect() if r.copies)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, n in want for _ in range(n))


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.target, r.copies) for r in got} == {(1, 0, 0.0, 0), (None, 0, 0.0, 0)}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(i, "a b", "s", 5, "n", 1) for i in range(4)], "doc_id long, text string, source string, row_key int, nth string, copies int")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and {(r.row_key, r.nth, r.copies) for r in out.collect()} == {(5, "n", 1)}
