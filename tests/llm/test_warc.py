import base64
import hashlib

import pytest

from newsloom.llm import warc


def rows():
    html = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "é🎉" * 2000, "<p>a</p>", "line\nhttp://a 0.0.0.0 20240101000000 text/html 5\nabcde"]
    return [(i * 3 + 1, None if i == 2 else f"http://h.org/a b?{i}", h) for i, h in enumerate(html)]


@pytest.mark.parametrize("version,limit,least", [(1, 100_000, 0), (2, 100_000, 0), (1, 0, 0), (2, 0, 3)])
def test_round_trip(spark, monkeypatch, version, limit, least):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", limit)
    if not limit:  # a record a chunk, two chunks a file
        monkeypatch.setattr(warc, "CHUNK", 1)
        monkeypatch.setattr(warc, "FILE_CHUNKS", 2)
    data = rows()
    df = spark.createDataFrame([(*r, "c") for r in data], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.row_id: r for r in warc.archive(df, least, version).collect()}
    assert len(got) == len(data)
    first = {}
    for i, _, h in sorted(data, key=lambda r: r[0]):
        body = (h or "").encode()
        f = first.setdefault(body, i) if len(body) >= least else i
        assert got[i].payload_bytes == len(body)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if f == i else ("revisit", f))


def test_arc_lines():
    v1 = warc.version_block(1, "f") + b"\n" + warc.arc_record(1, "http://a/b c", "20240102030405", b"hello", "f") + b"\n" + warc.arc_record(1, "-", "2024", b"", "f")
    got = list(warc.read_arc(v1))
    assert [(x["URL"], x["block"]) for x in got] == [("http://a/b%20c", b"hello"), ("-", b"")]
    v2 = warc.version_block(2, "f") + b"\nhttp://a/b c 1.2.3.4 20240102030405 text/html 200 - - 0 f 5\nhello\n"
    got = list(warc.read_arc(v2))
    assert got[0]["URL"] == "http://a/b c" and got[0]["Result-code"] == "200" and got[0]["block"] == b"hello"
    with pytest.raises(ValueError):
        list(warc.read_arc(v2[:-4]))
    assert warc.warc_date("20240102030405") == "2024-01-02T03:04:05Z" and warc.warc_date("2024") == "2024-01-01T00:00:00Z"


def test_records_agree_and_refer(spark):
    arc = {"URL": "http://a", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "block": b"HTTP/1.1 200 OK\r\nX-Row-Id: 1\r\nContent-Length: 2\r\n\r\nab"}
    other = arc | {"URL": "http://b", "block": arc["block"].replace(b"Id: 1", b"Id: 2")}
    data = warc.warc_record(arc, None) + warc.warc_record(other, ("1", "http://a"))
    (f1, b1), (f2, b2) = warc.read_warc(data)
    assert f1["warc-type"] == "response" and b1 == arc["block"]
    assert f2["warc-refers-to"] == f1["warc-record-id"] and b2.endswith(b"\r\n\r\n")


def test_null_ids_repeats_and_empty(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(None, "u", "x"), (5, "u", "x"), (5, "u", "x"), (5, "u", "y")], schema)
    got = sorted((r.row_id or -1, r.record_type, r.refers_to) for r in warc.archive(df).collect())
    assert got == [(-1, "revisit", 5), (5, "response", None), (5, "response", None), (5, "response", None)]
    assert warc.archive(spark.createDataFrame([], schema)).collect() == []
