import random
import re
from itertools import permutations

from newsloom.llm.filter_audit import FILTERS, audit, kernel_shares

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n int, same string, first boolean"
LABELS = "doc_id long, quality int, toxic int, source string"


def fails(rows):
    """Letters that each row fails, by the contract's words."""
    out = []
    for i, text, source in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A"} if len(ws) < 200 else set()
        f |= {"B"} if 100 * len(set(ws)) < 50 * len(ws) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append((source or "", i, f))
    return out


def model(rows, labels):
    out = {}
    all_fails = fails(rows)
    for part in {p for p, _, _ in all_fails}:
        own = [(i, f) for p, i, f in all_fails if p == part]
        total = dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(labels.get(i, (0, 0))[0] == 1 for i, _ in gone), sum(labels.get(i, (0, 0))[1] == 1 for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


def texts(seed):
    rnd = random.Random(seed)
    long = [" ".join(f"w{rnd.randrange(k)}" for _ in range(rnd.randrange(190, 260))) for k in (40, 9000, 9000)]
    pool = [None, "", " \t", "Short TEXT", "x" * 100_000, *long, long[0] + " A$", long[1].upper(), long[2] + " #", "a\x0bb\x0cc"]
    rows = [(rnd.choice([None, *range(60)]) if rnd.random() < 0.3 else i, rnd.choice(pool), rnd.choice([None, "", "s1", "s1", "s2"])) for i in range(90)]
    return rows + rows[:7]


def test_equals_the_replay_of_all_orders(spark):
    for seed in (1, 2):
        rows = texts(seed)
        labels = {i: (i % 2, i % 3 == 0) for i in range(0, 90, 2)}
        docs = spark.createDataFrame([(i, t, None, s, 0, "zz", 3, 4, "q", False) for i, t, s in rows], DOCS)
        marks = spark.createDataFrame([(i, q, int(t), "own") for i, (q, t) in labels.items()] + [(2, 0, 0, "again"), (None, 1, 1, "none"), (7, None, None, "null")], LABELS)
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit(docs, marks).collect()}
        assert got == model(rows, labels)


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(docs, marks).collect() == []
    one = spark.createDataFrame([(1, "A b", None, None, 0, "zz", 3, 4, "q", False)], DOCS)
    assert {(r.part, r.kept) for r in audit(one, marks).where("step = 5").collect()} == {("", 0)}


def test_shares_are_the_shapley_weights():
    """Coefficients equal the direct sum over orders."""
    direct = [[0] * 32 for _ in FILTERS]
    for order in permutations(range(5)):
        s = 0
        for i in order:
            direct[i][s | 1 << i] += 1
            direct[i][s] -= 1
            s |= 1 << i
    rows = kernel_shares()
    assert [r[1:] for r in rows] == [r[1:] for r in direct]  # no filter removes nothing
