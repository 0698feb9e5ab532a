import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import responses, vectors


def test_streamed_lines(spark):
    lines = [
        ("a", 1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), ("a", 0, ""), ("a", 2, 'data:{"choices":[{"delta":{"content":"lo"}}]}'), ("a", 3, 'data: {"choices":[]}'), ("a", 4, "data: [DONE]"), ("a", 5, 'data: {"choices":[{"delta":{"content":"late"}}]}'),
        ("b", 0, '{"plain":1}'), ("b", 1, "end"), ("c", 0, None), ("d", 0, "data: [DONE]"), ("e", 0, "data: {broken"),
    ]
    out = responses.reassembled(spark.createDataFrame(lines, "request_id string, pos int, line string")).collect()
    assert {(r.request_id, r.streamed, r.content) for r in out} == {("a", True, "Hello"), ("b", False, '{"plain":1}\nend'), ("c", False, None), ("d", False, None), ("e", True, "")}


def test_membership(spark):
    items = spark.createDataFrame([("r", i, f"t{i}", "p", "2026-07-07") for i in range(7)], "run_id string, item_index int, title string, platform string, scrape_date string")
    events = spark.createDataFrame([("r", "evt_20260707_0001")], "run_id string, event_id string")
    said = [(0, "assign", "evt_20260707_0001"), (1, "assign", "evt_20260707_0002"), (2, "assign", "evt_20260707_0002"), (3, "CREATE", None), (4, "assign", "evt_20260707_0009"), (5, None, None), (6, "assign", "evt_20260707_0004")]
    decisions = spark.createDataFrame([("r", i, d, m, "L" if i == 3 else None, None, None, None, "90", None) for i, d, m in said], "run_id string, item_index int, decision string, matched_event_id string, event_label string, event_summary string, event_type string, key_entities array<string>, confidence string, reason string")
    out, created, lost = responses.apply_membership(items, events, decisions)
    want = {0: "0001", 1: "0002", 2: "0002", 3: "0003", 4: "0004", 5: None, 6: "0004"}
    assert {r.item_index: r.event_id for r in out.collect()} == {i: n and f"evt_20260707_{n}" for i, n in want.items()}
    assert sorted((r.event_id[-1], r.event_label) for r in created.collect()) == [("2", "t1"), ("3", "L"), ("4", "t4")]
    assert [(r.item_index, r.stage, r.reason) for r in lost.collect()] == [(5, "event_membership", "LLM discarded during event matching")]


def model_seed_round(ids, v, at, said, k, hours):
    skipped, groups = set(), {}
    for s in ids:
        if s in skipped or s not in said:
            continue
        near = [e for e in ids if e != s and e not in skipped and (at[s] is None or at[e] is None or abs(at[s] - at[e]) <= dt.timedelta(hours=hours))]
        near.sort(key=lambda e: -float(v[s] @ v[e] / np.linalg.norm(v[s]) / np.linalg.norm(v[e])))
        got = set(near[:k]) & set(said[s])
        if got:
            groups[s] = sorted(got)
            skipped |= got
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_seed_round_equals_model(spark, seed):
    r, g = random.Random(seed), np.random.default_rng(seed)
    ids = [f"e{i:02d}" for i in range(30)]
    v = {i: g.normal(size=6) for i in ids}
    at = {i: None if r.random() < 0.1 else dt.datetime(2026, 7, 1) + dt.timedelta(hours=r.randint(0, 200)) for i in ids}
    said = {i: r.sample(ids, 12) for i in ids if r.random() < 0.7}
    events = spark.createDataFrame([("r", n, i, at[i], v[i].tolist()) for n, i in enumerate(ids)], "run_id string, ordinal int, event_id string, at timestamp, vector array<double>")
    named = spark.createDataFrame([("r", i, x) for i, x in said.items()], "run_id string, seed_id string, merge_event_ids array<string>")
    got = {x.merge_groups[0].target_event_id: list(x.merge_groups[0].source_event_ids) for x in responses.seed_round(events, named, 4, 72).collect()}
    assert got == model_seed_round(ids, v, at, said, 4, 72)


@pytest.mark.parametrize("blocks", [(2000, 500), (7, 3)])
def test_recall_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "EVENT_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[1])
    r, g = random.Random(3), np.random.default_rng(3)
    rows = [(f"e{i}", None if r.random() < 0.2 else dt.datetime(2026, 7, 1) + dt.timedelta(hours=r.randint(0, 300)), g.normal(size=4).round(1).tolist() if i % 9 else r.choice([None, [], [0.0] * 4, [1.0]]), i, r.choice(["a", "b"])) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id string, at timestamp, vector array<double>, ordinal int, scope string")
    queries = spark.createDataFrame([(i, *x[1:3], x[0], x[4]) for i, x in enumerate(rows)], "query_id int, at timestamp, vector array<double>, exclude_id string, scope string")

    def cosine(a, b):
        a, b = np.array(a or [], float), np.array(b or [], float)
        n = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) and len(a) else 0
        return float(a @ b / n) if n else 0.0

    want = set()
    for i, (own, at, v, _, scope) in enumerate(rows):
        near = [(-round(cosine(v, w), 9), o, e) for e, t, w, o, s in rows if s == scope and e != own and (at is None or t is None or abs(at - t) <= dt.timedelta(hours=72))]
        want |= {(i, n + 1, -s) for n, (s, _, _) in enumerate(sorted(near)[:5])}
    found = vectors.recall(queries, events).collect()
    assert {(x.query_id, x["rank"], round(x.similarity, 9)) for x in found} == want
    vector, own = {x[0]: x[2] for x in rows}, {i: x for i, x in enumerate(rows)}
    assert all(round(cosine(own[x.query_id][2], vector[x.event_id]), 9) == round(x.similarity, 9) and x.event_id != own[x.query_id][0] for x in found)


def test_pivot_cells_equal_brute_force_and_are_skipped(spark, monkeypatch):
    g = np.random.default_rng(11)
    centre = g.normal(size=(6, 8)) * 4
    rows = [("s", f"e{i % 290}", (centre[i % 6] + g.normal(size=8) * 0.2).tolist(), i) for i in range(300)]
    # a hot scope beside a small one, repeats, vectors that compare with nothing, other lengths
    rows += [("s", f"z{i}", v, 300 + i) for i, v in enumerate([None, [], [0.0] * 8, [1.0, 2.0], [None] * 8, [float("nan")] * 8, [1e200] * 8, rows[0][2], rows[0][2]])]
    rows += [("t", f"t{i}", g.normal(size=3).tolist(), i) for i in range(4)]
    events = spark.createDataFrame([(s, e, v, n, None) for s, e, v, n in rows], "scope string, event_id string, vector array<double>, ordinal int, at timestamp").repartition(3)
    queries = spark.createDataFrame([(s, n, v, e, None) for s, e, v, n in rows if n % 5 == 0 or n >= 300], "scope string, query_id int, vector array<double>, exclude_id string, at timestamp")

    def cosine(a, b):
        a, b = (np.array(x or [], float) for x in (a, b))
        ok = len(a) == len(b) and len(a) and all(np.isfinite(x @ x) and x @ x > 0 for x in (a, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b))) if ok else 0.0

    met = []
    inner = vectors._nearest

    def counted(q, e, key, k, hours):
        met.append((q.count(), e.select(*key).distinct().count()))
        return inner(q, e, key, k, hours)

    monkeypatch.setattr(vectors, "_nearest", counted)
    found = {}
    for x in vectors.nearest_anytime(queries, events, 4, 40).collect():
        found.setdefault((x.scope, x.query_id), []).append((x["rank"], round(x.similarity, 9)))
    want = {}
    for s, e, v, n in rows:
        if n % 5 == 0 or n >= 300:
            best = sorted((-round(cosine(v, w), 9), o) for t, f, w, o in rows if t == s and f != e)[:4]
            want[s, n] = [(i + 1, -x) for i, (x, _) in enumerate(best)]
    assert {x: sorted(y) for x, y in found.items()} == want
    (first, cells), (rest, _) = met
    live = sum(s == "s" and n % 5 == 0 and n < 300 for s, _, _, n in rows)
    assert cells > 8 and first + rest < 0.5 * live * cells  # clusters: most cells are skipped


def _random_sides(spark, n, seed=5):
    g = np.random.default_rng(seed)
    rows = [("s", f"e{i}", g.normal(size=16).tolist(), i, dt.datetime(2026, 7, 1)) for i in range(n)]
    events = spark.createDataFrame(rows, "scope string, event_id string, vector array<double>, ordinal int, at timestamp")
    return events.where("ordinal % 5 = 0").selectExpr("scope", "ordinal AS query_id", "at", "vector", "event_id AS exclude_id"), events


def test_cells_of_one_bucket_are_dealt_to_several_tasks(spark, monkeypatch):
    """All cells of a bucket were one task."""
    monkeypatch.setattr(vectors, "EVENT_BLOCK", 20)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        q, e = vectors._sides(*_random_sides(spark, 200))
        near = vectors._nearest(q, e, ["scope"], 3, 72)
        assert near.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_queries_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Where no cell is skipped each query was sent once to every cell."""
    monkeypatch.setattr(vectors, "COPIES", 4)
    sent = []
    inner = vectors._nearest
    monkeypatch.setattr(vectors, "_nearest", lambda q, e, *rest: sent.append(q.count()) or inner(q, e, *rest))
    q, e = _random_sides(spark, 200)
    found = {(x.query_id, x["rank"]): x.event_id for x in vectors.nearest_anytime(q, e, 3, 10).collect()}
    assert sum(sent) <= 2 * 4 * q.count()
    rows = {x.ordinal: np.array(x.vector) for x in e.collect()}
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in range(200)])
    for i in range(0, 200, 5):
        near = [j for j in np.argsort(-(unit @ unit[i]), kind="stable") if j != i][:3]
        assert [found[i, r] for r in (1, 2, 3)] == [f"e{j}" for j in near]


def test_seed_lists_do_not_grow_with_the_named_events(spark, monkeypatch):
    """Lists were as deep as the run's named events are many; too short ones go deeper."""
    deep = []
    inner = vectors.recall
    monkeypatch.setattr(vectors, "recall", lambda q, e, k, hours: deep.append(k) or inner(q, e, k, hours))
    monkeypatch.setattr(responses, "SLACK", 6)
    _, events = _random_sides(spark, 120)
    events = events.withColumnRenamed("scope", "run_id")
    v = {x.event_id: np.array(x.vector) for x in events.collect()}
    ids = [f"e{i}" for i in range(120)]
    at = dict.fromkeys(ids, dt.datetime(2026, 7, 1))
    for step in (1, 30):

        said = {i: [ids[(n + d * step) % 120] for d in range(1, 13)] for n, i in enumerate(ids) if n % 3 == 0}
        named = spark.createDataFrame([("s", i, x) for i, x in said.items()], "run_id string, seed_id string, merge_event_ids array<string>")
        got = {x.merge_groups[0].target_event_id: list(x.merge_groups[0].source_event_ids) for x in responses.seed_round(events, named, 4, 72).collect()}
        assert got == model_seed_round(ids, v, at, said, 4, 72)
    assert deep[0] == 10
