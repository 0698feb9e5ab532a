import json

import numpy as np

from newsloom.streaming import jobs, online


def drain(df, tmp_path, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def landed(tmp_path, rows, folder):
    at = tmp_path / folder
    at.mkdir()
    (at / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(at)


def test_log_jobs_equal_batch(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:{m:02d}:00Z", "type": "task.failed" if m % 3 == 0 else "task.started", "run_id": f"r{m % 2}", "state": f"s{m}"} for m in range(40)]
    at = landed(tmp_path, rows, "log")
    got = {r.run_id: (r.state, r.entries) for r in drain(jobs.latest_status(jobs.log_stream(spark, at)), tmp_path, "complete", "latest")}
    assert got == {"r0": ("s38", 20), "r1": ("s39", 20)}
    counts = drain(jobs.interval_counts(jobs.log_stream(spark, at)), tmp_path, "append", "counts")
    # windows that end by the last time less ten minutes are closed
    assert len({r.start for r in counts}) == 5 and sum(r.entries for r in counts) == 25 and sum(r.troubles for r in counts) == 9
    folded = jobs.folded_progress(jobs.log_stream(spark, at), ["state", "ts"])
    assert "progress_state" in folded.columns and "type" in folded.columns and folded.isStreaming


def test_first_of_url(spark, tmp_path):
    rows = [{"url": u, "at": f"2024-01-01T0{i}:00:00Z"} for i, u in enumerate(["http://a.org/x?1", "http://a.org/x/", "http://b.org"])]
    items = spark.readStream.schema("url string, at timestamp").json(landed(tmp_path, rows, "items"))
    assert sorted(r.url_key for r in drain(jobs.first_of_url(items), tmp_path, "append", "urls")) == ["http://a.org/x", "http://b.org"]


def test_assign_online(spark, tmp_path):
    rows = [
        {"item_id": "1", "at": "2024-01-01T00:00:00Z", "bucket": 0, "vector": [1.0, 0.0]}, {"item_id": "2", "at": "2024-01-02T00:00:00Z", "bucket": 0, "vector": [0.9, 0.1]}, {"item_id": "3", "at": "2024-01-02T01:00:00Z", "bucket": 0, "vector": [0.0, 1.0]},
        {"item_id": "4", "at": "2024-01-20T00:00:00Z", "bucket": 0, "vector": [1.0, 0.0]}, {"item_id": "5", "at": "2024-01-01T00:00:00Z", "bucket": 1, "vector": [1.0, 0.0]},
    ]
    items = spark.readStream.schema("item_id string, at timestamp, bucket int, vector array<double>").json(landed(tmp_path, rows, "online"))
    with online.rocksdb(spark):
        got = {r.item_id: (r.event_id, r.decision) for r in drain(online.assign_online(items), tmp_path, "append", "online")}
    assert got == {"1": ("evt_1", "create"), "2": ("evt_1", "assign"), "3": ("evt_3", "create"), "4": ("evt_4", "create"), "5": ("evt_5", "create")}


def replay(rows, threshold, hours):
    """Items one after the other against all events so far."""
    events, out = [], {}
    for item, at, v in rows:
        v = np.asarray(v) / np.linalg.norm(v)
        score = [(float(v @ e[2]), -i) for i, e in enumerate(events) if abs(e[1] - at) <= hours * 3600]
        best = max(score, default=(-2, 0))
        if best[0] >= threshold:
            e = events[-best[1]]
            e[1] = max(e[1], at)
            out[item] = (e[0], "assign")
        else:
            events.append([f"evt_{item}", at, v])
            out[item] = (f"evt_{item}", "create")
    return out


def test_assign_online_over_restarts_equals_a_replay(spark, tmp_path, monkeypatch):
    """Three runs over one state: events leave by their timers, blocks are split, decisions stay those of a replay."""
    monkeypatch.setattr(online, "BLOCK_EVENTS", 3)
    rnd = np.random.default_rng(5)
    at = tmp_path / "in"
    at.mkdir()
    rows = []
    for part in range(3):
        own = sorted((float(1_700_000_000 + part * 5 * 86_400 + rnd.integers(5 * 86_400)), f"i{part}x{i:03d}") for i in range(60))
        own = [(item, t, (rnd.normal(size=4) + [1.5, 0, 0, 0]).round(3).tolist()) for t, item in own]
        rows += own
        (at / f"{part}.json").write_text("\n".join(json.dumps({"item_id": i, "at": int(t), "bucket": 0, "vector": v}) for i, t, v in own))
        items = spark.readStream.schema("item_id string, at long, bucket int, vector array<double>").json(str(at))
        items = items.selectExpr("item_id", "timestamp_seconds(at) AS at", "bucket", "vector")
        with online.rocksdb(spark):
            query = online.assign_online(items, 0.9, 24).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination()
    got = {r.item_id: (r.event_id, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = replay(rows, 0.9, 24)
    assert got == want and len({e for e, _ in want.values()}) > 30


def test_twenty_thousand_open_events_in_a_bucket(spark, tmp_path):
    """No event leaves for want of room: the first item's event still takes its twin."""
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(20_001, 16)).round(3)
    v[-1] = v[0]
    rows = [{"item_id": f"{i:05d}", "at": 1_700_000_000 + i, "bucket": 0, "vector": x.tolist()} for i, x in enumerate(v)]
    at = landed(tmp_path, rows, "many")
    items = spark.readStream.schema("item_id string, at long, bucket int, vector array<double>").json(at).selectExpr("item_id", "timestamp_seconds(at) AS at", "bucket", "vector")
    with online.rocksdb(spark):
        got = {r.item_id: r for r in drain(online.assign_online(items, 0.999999), tmp_path, "append", "many")}
    assert len(got) == 20_001 and sum(r.decision == "create" for r in got.values()) == 20_000
    assert got["20000"].event_id == "evt_00000"


def test_log_tails(spark, tmp_path):
    at = tmp_path / "tails"
    at.mkdir()
    rnd = np.random.default_rng(7)
    rows = [{"ts": f"2024-01-01T{rnd.integers(24):02d}:00:00Z", "seq": i, "type": f"t{i % 3}", "run_id": f"r{i % 2}"} for i in range(80)]
    for part in range(2):
        (at / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part::2] if part or r["run_id"] == "r0"))
        log = spark.readStream.schema("ts timestamp, seq long, type string, run_id string").json(str(at))
        with online.rocksdb(spark):
            jobs.run_batches(online.log_tails(log, 7), str(tmp_path / "tails-out"), str(tmp_path / "tails-state"))
    last = spark.read.parquet(str(tmp_path / "tails-out"))
    got = jobs.last_batch(last, ["run_id"]).orderBy("run_id", "pos").collect()
    seen = rows[::2] + [r for r in rows[1::2]]
    for run in ("r0", "r1"):
        own = sorted((r["ts"], r["seq"]) for r in seen if r["run_id"] == run)[-7:]
        assert [r.seq for r in got if r.run_id == run] == [s for _, s in own]
