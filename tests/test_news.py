import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import rules
from newsloom.operators import documents, enrich, evidence, fold, greedy, runlog, sections, vectors
from newsloom.sources import feeds, sinks

EVENT = "report_date date, ordinal int, event_id string, event_label string, event_summary string, event_type string, key_entities array<string>, member_count int, platforms array<string>, latest_pubtime string, representative_titles array<string>, confidence string, source_news_ids array<int>"
DAY = dt.date(2026, 7, 7)


def one_event(spark):
    events = spark.createDataFrame([(DAY, 0, "evt_1", "OpenAI releases GPT model API", "OpenAI releases a new GPT model with API access", "model_release", ["OpenAI"], 1, ["openai"], "2026-07-06T08:00:00Z", ["OpenAI releases GPT model API"], "0.96", [])], EVENT)
    items = spark.createDataFrame([(DAY, 0, "openai", "OpenAI releases GPT model API", "https://openai.com/x", "evt_1")], "report_date date, item_index int, platform string, title string, url string, event_id string")
    return enrich.enrich(enrich.candidates(events, items))


def test_hand_computed_scores(spark):
    r = one_event(spark).first()
    assert (r.importance_score, r.source_score, r.freshness_score, r.relevance_score, r.actionability_score, r.novelty_score, r.risk_penalty) == (97, 90, 100, 88, 90, 88, 0)
    assert r.final_score == 93.28 and r.content_layer == "news" and r.verify_status == "verified"
    assert r.score_reason == "impact=97, source=90, freshness=100, relevance=88, actionability=90, novelty=88, risk_penalty=0"


def test_sections_and_documents(spark):
    out = sections.assign(one_event(spark))
    r = out.first()
    assert r.report_section == "top_news" and "top_news" in r.report_tags
    public = documents.documents(out).first()["document"]
    assert public.startswith("# AI 情报早报 - 2026-07-07\n\n## 一、今日重点新闻\n\n1. **OpenAI releases GPT model API**\n   - 简报：") and "[openai](https://openai.com/x)" in public and public.endswith("report_candidates.json。\n")
    debug = documents.documents(out, debug=True).first()["document"]
    assert "Debug：总分 93.3；" in debug


def model_top(rows, limit=8):
    out, kinds, entities, platforms, seen = [], {}, {}, {}, set()
    for r in rows:
        k, e, p = r["kind"], r["entity"], r["platform"]
        if r["id"] in seen or kinds.get(k, 0) >= sections.type_limit(k) or (e and entities.get(e, 0) >= 2) or (p and platforms.get(p, 0) >= 3):
            continue
        out.append(r["id"])
        seen.add(r["id"])
        kinds[k], entities[e], platforms[p] = kinds.get(k, 0) + 1, entities.get(e, 0) + 1, platforms.get(p, 0) + 1
        if len(out) == limit:
            break
    return out


def test_top_news_equals_unpruned_model(spark):
    r = random.Random(1)
    rows = []
    for day in range(12):
        for i in range(60):
            rows.append({"day": dt.date(2026, 1, 1 + day), "id": f"e{i}", "kind": r.choice(["model_release", "policy", "research", "funding", "x"]), "entity": r.choice(["", "a", "b", "c"]), "platform": r.choice(["", "p", "q", "s"]), "score": float(r.randint(60, 70)), "place": i + 1})
    df = spark.createDataFrame([(x["day"], x["id"], x["kind"], x["entity"], x["platform"], x["score"], 80.0, 80.0, 80.0, x["place"]) for x in rows], "report_date date, event_id string, normalized_event_type string, main_entity string, main_platform string, scores_top_news double, final_score double, importance_score double, source_score double, place int")
    got = {}
    for x in sections.top_news(df).orderBy("report_date", "position").collect():
        got.setdefault(x.report_date, []).append(x.event_id)
    for day in {x["day"] for x in rows}:
        own = sorted((x for x in rows if x["day"] == day), key=lambda x: (-x["score"], x["place"]))
        assert got[day] == model_top(own)


def test_extraction_and_first_claims(spark):
    items = spark.createDataFrame([("r", 0, "x", "Alpha raises round", "u", None, "2026-07-07"), ("r", 1, "y", "Alpha launches feature", "u", "2026-07-06T08:00:00Z", "2026-07-07"), ("r", 2, "x", "left out", "u", None, "2026-07-07"), ("r", 3, "x", "gone", "u", None, "2026-07-07")], "run_id string, item_index int, platform string, title string, url string, pubtime string, scrape_date string")
    first = '{"events":[{"event_label":"Alpha","event_type":"funding","confidence":92,"source_news_ids":[0,1,9],"key_entities":["Alpha"]},{"event_label":"Empty","source_news_ids":[1]}],"discards":[{"index":3,"reason":"no"},{"index":0,"reason":"both"}]}'
    second = 'noise {"events":[{"event_label":"Late","source_news_ids":[0]}],"suspects":[{"index":3,"reason":"again"}]}'
    responses = spark.createDataFrame([("r", 0, first), ("r", 1, second)], "run_id string, batch_index int, response string")
    out, events, discards = fold.apply_extraction(items, responses)
    e = events.collect()
    assert [(x.event_id, x.confidence, x.source_news_ids, x.platforms, x.event_type) for x in e] == [("evt_20260707_0001", 0.92, [0, 1], ["x", "y"], "funding")]
    assert {(x.item_index, x.stage) for x in discards.collect()} == {(3, "clustered_title_discard"), (0, "clustered_title_discard"), (2, "clustered_title_omitted")}
    assert {x.item_index: x.classification_decision for x in out.collect()} == {0: "assign", 1: "assign", 2: "discard", 3: "discard"}


def model_merge(ids, groups):
    gone, parent = set(), {}
    for target, sources in groups:
        if target not in ids or target in gone:
            continue
        for s in [s for s in sources if s in ids and s != target and s not in gone]:
            gone.add(s)
            parent.setdefault(s, target)
    def root(x):
        while x in parent:
            x = parent[x]
        return x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_edges_equal_model(spark, seed):
    r = random.Random(seed)
    ids = [f"e{i:02d}" for i in range(30)]
    groups = [(r.choice([*ids, "unknown"]), r.sample([*ids, "missing"], r.randint(1, 4))) for _ in range(25)]
    events = spark.createDataFrame([("r", i, x, x, None, "t", [x], 1, [f"p{i % 3}"], "2026-07-06T10:00:00Z", f"2026-07-{i % 9 + 1:02d}T09:00:00Z", [f"title {x}"], 0.01 * i, [i]) for i, x in enumerate(ids)], "run_id string, ordinal int, event_id string, event_label string, event_summary string, event_type string, key_entities array<string>, member_count int, platforms array<string>, latest_pubtime string, first_pubtime string, representative_titles array<string>, confidence double, source_news_ids array<int>")
    rows = [("r", n // 5, [(t, s, f"label {n}", None, "")]) for n, (t, s) in enumerate(groups)]
    packed = {}
    for run, b, g in rows:
        packed.setdefault((run, b), []).extend(g)
    merges = spark.createDataFrame([(a, b, g) for (a, b), g in packed.items()], "run_id string, batch_index int, merge_groups array<struct<target_event_id:string,source_event_ids:array<string>,event_label:string,event_summary:string,reason:string>>")
    out, _ = fold.apply_merges(events, merges)
    want = model_merge(ids, groups)
    got = {x.event_id: x.source_news_ids for x in out.collect()}
    members = {}
    for i, x in enumerate(ids):
        members.setdefault(want[x], []).append(i)
    assert got == members


def test_recall_window_and_order(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    events = spark.createDataFrame([("evt_old", t("2026-07-01T10:00:00"), [0.99, 0.01], 0), ("evt_near", t("2026-07-06T09:00:00"), [0.5, 0.5], 1), ("evt_strong", t("2026-07-06T08:30:00"), [1.0, 0.0], 2), ("undated", None, [0.0, 1.0], 3)], "event_id string, at timestamp, vector array<double>, ordinal int")
    queries = spark.createDataFrame([("q", t("2026-07-06T10:00:00"), [1.0, 0.0])], "query_id string, at timestamp, vector array<double>")
    got = [x.event_id for x in vectors.recall(queries, events, 2, 12).orderBy("rank").collect()]
    assert got == ["evt_strong", "evt_near"]


def test_greedy_groups_equal_plain_replay(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(57, 8))
    df = spark.createDataFrame([("r", i, str(i), v[i].tolist()) for i in range(57)], "run_id string, ordinal int, key string, vector array<double>")
    got = {}
    for x in greedy.greedy_groups(df, 10).orderBy("group_index", "position").collect():
        got.setdefault(x.group_index, []).append(int(x.key))
    pending, want = list(range(57)), []
    while pending:
        seed = pending.pop(0)
        near = sorted(pending, key=lambda i: -(v[seed] @ v[i]) / np.linalg.norm(v[seed]) / np.linalg.norm(v[i]))[:9]
        want.append([seed, *near])
        pending = [p for p in pending if p not in near]
    assert list(got.values()) == want


def test_evidence(spark):
    out = sections.assign(one_event(spark))
    pages = spark.createDataFrame([("https://openai.com/x/", "<p>OpenAI releases the GPT model with an API for all developers today.</p><script>x</script>", "text/html")], "url string, html string, content_type string")
    r = evidence.with_evidence(out, pages).first()
    assert (r.evidence_strength, r.fetched_source_count, r.domains, r.source_agreement) == ("strong", 1, ["openai.com"], "single_source")
    assert r.one_sentence.startswith("原文回溯显示，OpenAI releases GPT model API。系统已读取原始来源（openai.com）")
    missing = evidence.with_evidence(out, pages.limit(0)).first()
    assert missing.evidence_strength == "none" and missing.mismatch_flags == ["source_fetch_failed"] and missing.needs_review


def test_polish(spark):
    out = sections.assign(one_event(spark))
    results = spark.createDataFrame([(DAY, "evt_1", "succeeded", "New title", "  brief  text ", None, None)], "report_date date, event_id string, state string, title string, brief string, why_important string, reason string")
    r = evidence.apply_polish(out, results).first()
    assert (r.title, r.one_sentence) == ("New title", "brief text")
    r = evidence.apply_polish(out, results.withColumn("state", F.lit("blocked"))).first()
    assert r.warnings[-1] == "report_polish_blocked:unknown"


def test_pages_and_contract(spark):
    html = [
        (1, "https://a.org/news", '<a href="/news/x"><h3>Title</h3><time>Jul 1</time></a><a href="/news/x"><h3>Again</h3><time>Jul 2</time></a><a href="/other"><h3>No</h3><time>t</time></a>'),
        (2, "https://h.co/papers", "<div data-target='DailyPapers' data-props='{&quot;dailyPapers&quot;:[{&quot;paper&quot;:{&quot;id&quot;:&quot;7&quot;,&quot;title&quot;:&quot;P&quot;}}]}'>"),
        (3, "https://h.co/papers", '<a href="/papers/9"> <b>Nine</b> </a>'),
        (4, "https://h.co", "please solve the CAPTCHA"),
        (5, "https://h.co", None),
    ]
    rows = feeds.extract_pages(spark.createDataFrame(html, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.status) for r in rows if r.pos is None} == {(1, "listing"), (2, "structured"), (3, "links"), (4, "blocked"), (5, "empty")}
    assert {(r.url, r.title) for r in rows if r.pos is not None} == {("https://a.org/news/x", "Title"), ("https://h.co/papers/7", "P"), ("https://h.co/papers/9", "Nine")}
    good, bad = feeds.contract(spark.createDataFrame([("p", "t", "u", "d"), ("p", " ", None, "d")], "platform string, title string, url string, scrape_date string"))
    assert good.count() == 1 and bad.first()["missing"] == ["title", "url"]


def test_feed_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text("<rss><channel><item><title> A </title><link>u1</link><pubDate>Wed, 03 Jul 2024 09:46:40 GMT</pubDate></item><item><title>B</title><link>u2</link></item></channel></rss>")
    got = [(r.platform, r.title, r.url, r.pubtime) for r in feeds.read_rss(spark, str(tmp_path / "one.xml"), "2024-07-04", 5).collect()]
    assert got == [("one", "A", "u1", "2024-07-03T09:46:40+00:00"), ("one", "B", "u2", None)]
    (tmp_path / "hot.json").write_text('[{"title":" T ","url":"u","extra":{"date":1720000000000}},{"title":"S","url":"v","pubDate":"2024-07-03T17:46:40"}]')
    got = [(r.title, r.pubtime) for r in feeds.read_hot_lists(spark, str(tmp_path / "hot.json"), "2024-07-04").orderBy("pos").collect()]
    assert got == [("T", "2024-07-03T09:46:40+00:00"), ("S", "2024-07-03T09:46:40+00:00")]
    (tmp_path / "items.json").write_text('{"items":[{"platform":"p","title":"t","url":"u"}]}')
    assert [(r.platform, r.scrape_date) for r in feeds.read_items(spark, str(tmp_path / "items.json"), "d").collect()] == [("p", "d")]
    sinks.write_layer(spark.createDataFrame([("r", 1)], "run_id string, x int"), str(tmp_path / "out"), ["run_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_run_log(spark):
    tasks = spark.createDataFrame([("r", "s", "a", "succeeded", [], None), ("r", "s", "b", "failed", ["a"], "g"), ("r", "t", "c", "queued", ["a", "b"], "g"), ("r", "t", "d", "queued", ["zz"], "g")], "run_id string, step_id string, task_id string, state string, depends_on array<string>, task_group_id string")
    assert {(r.task_id, r.dependency_id, r.dependency_state) for r in runlog.dependency_blocks(tasks).collect()} == {("c", "b", "failed"), ("d", "zz", "missing")}
    assert {r.step_id: r.s for r in tasks.groupBy("step_id").agg(runlog.rolled_up().alias("s")).collect()} == {"s": "failed", "t": "queued"}
    assert runlog.missing_tasks(spark.createDataFrame([("r", ["a", "x"])], "run_id string, task_ids array<string>"), tasks).first()["task_id"] == "x"
    steps = spark.createDataFrame([("r", "ingest/rss", "succeeded"), ("r", "ingest/hot", "running"), ("r", "report", "succeeded")], "run_id string, step_id string, status string")
    declared = spark.createDataFrame([("ingest", [], ["ingest/"]), ("report", [], []), ("classify", [], [])], "pipeline_step string, ids array<string>, prefixes array<string>")
    assert {r.pipeline_step: r.status for r in runlog.pipeline_status(steps, declared).collect()} == {"ingest": "running", "report": "succeeded", "classify": "idle"}
    tries = spark.createDataFrame([("j", 1, False, "read timed out", False), ("j", 2, True, None, False), ("k", 1, False, "captcha", False), ("l", 1, False, "bad row", True)], "job_id string, attempt int, ok boolean, error string, contract boolean")
    assert {(r.job_id, r.state, r.code) for r in runlog.scrape_outcomes(tries, 3).collect()} == {("j", "succeeded", None), ("k", "skipped_unrepairable", "blocked"), ("l", "repairing", "contract_error")}


def test_rule_tables():
    assert len(rules.IMPORTANCE) == 17 and len(rules.EXTRACTION_TYPES) == 17 and abs(sum(rules.WEIGHTS.values()) - 1) < 1e-9


def test_decisions_without_broadcast_joins(spark):
    """A join on the discards, a union dealt by the join's key, failed: the other side had half its partitions."""
    from newsloom import queries

    wanted = sorted(queries.item_decisions(spark, "/root/testdata/sf0.001").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(queries.item_decisions(spark, "/root/testdata/sf0.001").collect()) == wanted
        assert len(wanted) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
