import datetime as dt

from newsloom.llm import url_lists as ul

D = dt.date


def test_as_of(spark):
    entries = spark.createDataFrame(
        [
            ("host", "a.org", D(2024, 1, 10), "block"), ("host", "a.org", D(2024, 2, 1), "allow"), ("prefix", "a.org/x", D(2024, 1, 1), "allow"), ("domain", "a.org", D(2024, 1, 5), "block"),
            ("host", None, D(2024, 1, 1), "block"), ("host", "b.org", None, "block"), ("host", "a.org", D(2024, 2, 1), "allow"), ("domain", "c.org", D(2024, 1, 1), "allow"), ("domain", "c.org", D(2024, 1, 1), "block"),
        ],
        "kind string, value string, day date, action string",
    )
    rows = [(1, "http://www.a.org/y", D(2024, 1, 9)), (2, "http://A.org:80/y", D(2024, 1, 10)), (3, "https://u@a.org/y", D(2024, 2, 1)), (4, "http://a.org/x/z", D(2024, 1, 20)), (5, "http://b.org/", D(2024, 3, 1)), (6, None, D(2024, 1, 1)), (7, "http://a.org", None), (8, "http://s.c.org", D(2024, 5, 5)), (9, "http://a.org/q", D(2024, 1, 1))]
    got = {r.page_id: (r.kind, r.action, r.valid_to) for r in ul.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetch_day date"), entries).collect()}
    assert got == {
        1: ("domain", "block", None), 2: ("host", "block", D(2024, 2, 1)), 3: ("host", "allow", None), 4: ("prefix", "allow", None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: ("domain", "block", None), 9: (None, None, None),
    }


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert ul.filter_captures(ul.demo_captures(pages), ul.demo_entries(pages)).collect() == []


def test_clashing_columns_repeats_and_long_urls(spark):
    entries = spark.createDataFrame([("domain", "b.co.uk", D(2024, 1, 1), "block"), ("domain", "co.uk", D(2024, 1, 1), "allow"), ("prefix", "a.org/" + "p" * 50_000, D(2024, 1, 1), "block")], "kind string, value string, day date, action string")
    rows = [(1, "http://x.b.co.uk/q", D(2024, 2, 1), "own", 7, "s"), (1, "http://x.b.co.uk/q", D(2024, 2, 1), "own", 7, "s"), (2, "http://a.org/" + "p" * 50_000 + "/z?" + "q" * 100_000, D(2024, 2, 1), None, None, None)]
    out = ul.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetch_day date, kind string, k int, salt string"), entries)
    assert out.columns == ["page_id", "url", "fetch_day", "k", "salt", "kind", "value", "action", "valid_from", "valid_to"]
    assert sorted((r.page_id, r.k, r.kind, r.value[:7], r.action) for r in out.collect() if r.page_id == 1) == [(1, 7, "domain", "b.co.uk", "block")] * 2
    assert [(r.kind, r.action) for r in out.collect() if r.page_id == 2] == [("prefix", "block")]


def test_captures_that_share_a_key(spark):
    entries = spark.createDataFrame([("host", "a.org", D(2024, 1, 1), "block")], "kind string, value string, day date, action string")
    rows = [(1, "http://a.org/", D(2024, 2, 1)), (1, "http://b.org/", D(2024, 2, 1)), (1, "http://a.org/", D(2023, 2, 1)), (None, "http://a.org/", D(2024, 2, 1)), (None, "http://b.org/", D(2024, 2, 1))]
    out = ul.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetch_day date"), entries).collect()
    assert sorted((str(r.page_id), r.url, r.fetch_day.year, r.action) for r in out if r.action) == [("1", "http://a.org/", 2024, "block"), ("None", "http://a.org/", 2024, "block")] and len(out) == 5
