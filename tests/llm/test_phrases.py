import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import phrases
from newsloom.llm.phrases import collocations, multikey_quicksort

DOCS = "doc_id long, text string, lang string, source string, f long, phrase string, n int, key string, k int"


def model(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in (1, 2, 3):
                    if i + k <= len(ws):
                        f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in cands.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in cands.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(seed, n=150):
    rnd = random.Random(seed)
    words = ["the", "The", "Of", "a", "b\x0cc", "größe", "東京", "x#", "né", "\x01", "r\x00s", "q" * 3000]
    def one():
        return "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " "]) for _ in range(rnd.randrange(60)))
    rows = [(rnd.choice([None, "", " \t.;"]) if rnd.random() < 0.1 else one(), rnd.choice(["en", "en", "en", None, "", "fr"])) for _ in range(n)]
    return rows + rows[:9] + [("the of " * 4000, "en"), ("hot pair w%d. " % 0 + " ".join(f"hot pair w{i % 40}" for i in range(3000)), "fr")]


@pytest.mark.parametrize("chunk", [2_000_000, 900])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = texts(chunk)
    docs = spark.createDataFrame([(i, t, l, "s", 7, "own", 1, "own", 2) for i, (t, l) in enumerate(rows)], DOCS).repartition(5)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations(docs, top=60).collect())
    assert got == model(rows, 10, 60)


def test_empty_and_wordless_tables(spark):
    assert collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, None, 1, "", 1, "", 1), (2, " .\n", "en", None, 1, "", 1, "", 1)], DOCS)).collect() == []


def test_products_beyond_64_bits(spark):
    """The score's arithmetic is exact where 10^6 a^2 passes 64 bits."""
    from pyspark.sql import functions as F

    a, l, r = 3_000_000_019, 4_000_000_007, 5_000_000_029
    wide = lambda x: F.lit(x).cast("decimal(18,0)")
    got = spark.range(1).select(F.call_function("div", (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r)).alias("s")).first().s
    assert got == 1_000_000 * a * a // (l * r)


def test_quicksort_counts_equal_a_dictionary():
    for seed in range(20):
        rnd = np.random.default_rng(seed)
        keys = rnd.integers(1, [3, 5, 9][seed % 3] + 1, (rnd.integers(1, 400), 3))
        keys[rnd.random(len(keys)) < 0.2, 2] = 0
        keys[rnd.random(len(keys)) < 0.2, 1:] = 0
        n = rnd.integers(1, 4, len(keys))
        want = Counter()
        for row, w in zip(keys.tolist(), n.tolist(), strict=True):
            for k in (1, 2, 3):
                if row[k - 1]:
                    want[tuple(row[:k])] += w
        got = {tuple(keys[i, :d].tolist()): f for d, i, f in multikey_quicksort(keys, n, 1, 5)}
        assert got == {k: f for k, f in want.items() if f >= 5}


def test_common_pairs_are_dealt_by_the_third_word(spark):
    docs = spark.createDataFrame([(i, " ".join(f"hot pair w{i}x{j}" for j in range(30)), "en", "s", 7, "own", 1, "own", 2) for i in range(40)], DOCS)
    t = docs.select("lang", "text")
    assert ("en", "hot", "pair") in phrases.common_pairs(t, 40)
    got = {r.phrase: (r.a, r.l, r.r) for r in collocations(docs).collect()}
    assert got == {"hot pair": (1200, 1200, 1200)}
