import random
import re

import numpy as np
import pytest

from newsloom.llm import ngram_join as nj


def brute(rows, k=5):
    sets = {}
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = root(a), root(b)
                    comp[max(x, y)] = min(x, y)
    for i in ids:
        out[i] = (len(sets[i]), root(i))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    passage = [r.choice(words) for _ in range(25)]
    rows = []
    for i in range(60):
        base = [r.choice(words) for _ in range(r.randint(1, 80))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.choice([1, 1, 1, 3, 8])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.2:
                w = w[: max(1, int(len(w) * 0.85))]
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n "), (len(rows) + 3, "one"), (len(rows) + 4, "ONE"), (len(rows) + 5, "long " * 3000)]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 2000), (2, 3)])
def test_components_equal_brute_force(spark, seed, group, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(nj, "GROUP_ROWS", group)
    monkeypatch.setattr(nj, "BLOCK_SETS", 3 if group == 3 else 128)
    monkeypatch.setattr(nj, "PAIRS_HELD", 5 if group == 3 else 200_000)
    if group == 3:  # every bucket frequent, so tokens are salted
        monkeypatch.setattr(nj, "order_levels", lambda c: (np.minimum(c, 200).astype(np.uint8), c.astype(np.int64)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, sid string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_jaccard_join(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(rows).collect() if r.n_shingles != 1)
    assert got == [(-1, 2, 4), (4, 2, 4), (4, 2, 4)]


def test_bounds_are_safe():
    r = np.random.default_rng(3)
    for _ in range(200):
        base = r.integers(0, 2**63, r.integers(1, 400), dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(r.choice(base, len(base))), np.unique(r.choice(base, len(base)))
        inter = len(np.intersect1d(a, b))
        assert nj.overlap_bound(nj.count_sketch(a), nj.count_sketch(b), len(a), len(b)) >= inter


def test_trie_links_span_all_links():
    r = np.random.default_rng(4)
    for _ in range(50):
        base = np.unique(r.integers(0, 2**63, 60, dtype=np.uint64))
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(40, 60), replace=False), r.integers(0, 2**63, r.integers(0, 6), dtype=np.uint64)])) for _ in range(12)]
        sizes = [len(s) for s in sets]
        want = list(range(12))

        def root(p, x):
            while p[x] != x:
                x = p[x]
            return x

        for i in range(12):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 10 * o >= 8 * (sizes[i] + sizes[j] - o):
                    a, b = root(want, i), root(want, j)
                    want[max(a, b)] = min(a, b)
        got = list(range(12))
        for i, j in nj.trie_links(sizes, sets, 8, 10):
            o = len(np.intersect1d(sets[i], sets[j]))
            assert 10 * o >= 8 * (sizes[i] + sizes[j] - o)
            a, b = root(got, i), root(got, j)
            got[max(a, b)] = min(a, b)
        assert [root(got, i) for i in range(12)] == [root(want, i) for i in range(12)]
