import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import lbl
from newsloom.llm.scratch import Scratch


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(seed):
    r = random.Random(seed)
    a, b = ["a%d" % i for i in range(40)], ["b%d" % i for i in range(40)]
    rows = [(i, " ".join(r.choice(v) for _ in range(r.randint(1, 60)))) for i in range(250) for v in [r.choice([a, b])]]
    return [*rows, (900, None), (901, ""), (902, "UNSEEN É words \x1c here"), (None, "a1 a2"), (3, "a1")]


@pytest.mark.parametrize("remembered,units", [(200_000, 1500), (15, 8)])
def test_base_and_normalised_score(spark, remembered, units):
    rows = corpus(1)
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, word string, count int").repartition(3)
    out = lbl.score(df, units, 16, remembered).collect()
    assert len(out) == len(rows)
    counts = Counter()
    held = {}
    for i, t in rows:
        held[i] = zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
        if not held[i]:
            counts.update([*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held[i], len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), ""]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), ""]), 6)) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want
    test = [r for r in out if r.held_out]
    if units > 100:  # held-out text is better predicted
        assert sum(r.score for r in test) > sum(r.base_score for r in test)


@pytest.mark.parametrize("units", [1500, 8])
def test_score_equals_brute_force(spark, units):
    """Every token's probability from the vectors by plain softmax loops, words of a bucket by their counts."""
    rows = [r for r in corpus(2) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_tokens, round(r.score, 3)) for r in lbl.score(df, units, 16, 50, 6, 4).collect()}
    _, _, m, u, _, _ = lbl.fitted(df, Scratch(spark, "test"), units, 16, 6, 4, 50)
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    top = sorted(counts, key=lambda w: (-counts[w], w))[: u.top]
    n_units = u.top + 1 + 16

    def unit(w):
        return top.index(w) if w in top else u.top + 1 + lbl.bucket_of(w.encode(), 16)

    tail = [1.0] * 16
    for w, n in counts.items():
        if w not in top:
            tail[lbl.bucket_of(w.encode(), 16)] += n + 1

    def softmax(scores, i):
        most = max(scores)
        return scores[i] - most - math.log(sum(math.exp(x - most) for x in scores))

    def log_p(w, h1, h2):
        members = [x for x in range(n_units) if m.cls[x] == m.cls[w]]
        to_class = [float((m.first[h1] + m.second[m.group[h2]]) @ m.q_class[c] + m.b_class[c]) for c in range(len(m.q_class))]
        to_unit = [float(m.inner[m.cls[h1]] @ m.q_unit[x] + m.b_unit[x]) for x in members]
        return softmax(to_class, int(m.cls[w])) + softmax(to_unit, members.index(w))

    memo, want = {}, set()
    for i, t in rows:
        h1 = h2 = u.top
        total = 0.0
        for w in [*words(t), None]:
            x = u.top if w is None else unit(w)
            if (x, h1, h2) not in memo:
                memo[x, h1, h2] = log_p(x, h1, h2)
            total += memo[x, h1, h2] / math.log(10)
            if x > u.top:
                total += math.log10((counts[w] + 1) / tail[x - u.top - 1])
            h1, h2 = x, h1
        want.add((i, len(words(t)) + 1, round(total, 3)))
    assert {(i, n) for i, n, _ in got} == {(i, n) for i, n, _ in want}
    a, b = sorted(got), sorted(want)
    assert all(abs(x[2] - y[2]) <= 0.01 + 1e-4 * abs(y[2]) for x, y in zip(a, b, strict=True))


def test_model_is_normalised_and_learns():
    r = np.random.default_rng(0)
    v, n = 30, 60_000
    text = [0]
    for _ in range(n):
        text.append(int((text[-1] + r.integers(1, 4)) % v))
    text = np.array(text)
    target, before, second = text[2:], text[1:-1], text[:-2]
    found = np.zeros((v, v), np.int64)
    np.add.at(found, (target, before), 1)
    cls, group = lbl.clusters(found, 6), lbl.clusters(found, 3)
    c, g = cls.max() + 1, group.max() + 1
    counts = lbl.Counts(np.zeros((v, c), np.int64), np.zeros((c, v), np.int64), np.zeros((g, g, c), np.int64))
    np.add.at(counts.pairs, (before, cls[target]), 1)
    np.add.at(counts.inner, (cls[before], target), 1)
    np.add.at(counts.groups, (group[second], group[before], cls[target]), 1)
    m = lbl.train(counts, cls, group, 0, steps=150)
    every = np.arange(v)
    for h1, h2 in [(0, 0), (3, 17), (29, 5)]:
        assert math.isclose(float(np.exp(m.log_probability(every, np.full(v, h1), np.full(v, h2)).astype(float)).sum()), 1, abs_tol=1e-3)
    assert -m.log_probability(target, before, second).mean() < 0.75 * math.log(v)


def test_empty(spark):
    assert lbl.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = lbl.score(spark.createDataFrame([(2, "x y")], "doc_id long, text string")).collect()
    assert len(got) == 1 and math.isfinite(got[0].score)
