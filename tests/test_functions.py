import hashlib
import html
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions import text as tx


def value(spark, column, **fields):
    """One value of an expression over one row of string fields."""
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("  快讯：  AI  news ", "AI news"), ("消息称 消息|x", "x"), ("　报道-a", "a"), ("plain", "plain")])
def test_normal_title(spark, raw, want):
    assert value(spark, tx.normal_title(F.col("a")), a=raw) == want


def test_text_rules(spark):
    assert value(spark, tx.compact(F.col("a")), a=" a \n b ") == "a b"
    assert value(spark, tx.mojibake(F.col("a")), a="鐨x鍙") and value(spark, tx.mojibake(F.col("a")), a="锟?") and not value(spark, tx.mojibake(F.col("a")), a="锟")
    assert value(spark, tx.mostly_english(F.col("a")), a="twelve letters x") and not value(spark, tx.mostly_english(F.col("a")), a="short one")
    assert value(spark, tx.quality(F.col("a"), F.col("b")), a=None, b=" ") == "missing"
    assert value(spark, tx.best_title(F.col("a"), F.col("b")), a="A long English title here", b=["中文标题更好", " "]) == "中文标题更好"
    assert value(spark, tx.best_title(F.col("a"), F.col("b")), a=" ", b=[]) == "Untitled event"
    assert value(spark, tx.short_sentence(F.col("a"), F.col("b")), a="x" * 130, b="f") == "x" * 119 + "..."
    assert value(spark, tx.tokens(F.col("a")), a="GPT-5.1 and gpt-5.1, abc abcd") == ["gpt-5.1", "abcd"]
    assert value(spark, tx.ensure_sentence(F.col("a")), a=" x ") == "x。"
    assert value(spark, tx.first_by_prefix(F.col("a")), a=["Ab", "aB", "c"]) == ["Ab", "c"]
    assert value(spark, tx.token_estimate(F.col("a")), a="abcdefgh中文") == int(8 / 4 + 2 / 1.7)
    assert value(spark, tx.polish_public(F.col("a"), 50), a="好消息。该内容证据强度不足。结束") == "好消息。结束。"
    long = "This sentence names gpt and codex here. Short one. Another sentence only names the gpt word. Nothing relevant is in this long one."
    assert value(spark, tx.key_sentences(F.col("a"), F.array(F.lit("gpt"), F.lit("codex"))), a=long) == ["This sentence names gpt and codex here.", "Another sentence only names the gpt word."]


@pytest.mark.parametrize("url,host,key", [("https://U@www.Example.com:80/a/b/?q#f", "example.com", "https://u@www.example.com:80/a/b"), ("x", "", ""), ("HTTP://a_b.com", "a_b.com", "http://a_b.com"), (None, "", "")])
def test_urls(spark, url, host, key):
    assert value(spark, tx.host(F.col("a")), a=url) == host
    assert value(spark, tx.url_key(F.col("a")), a=url) == key


@pytest.mark.parametrize("domain,want", [("openai.com", True), ("blog.openai.com", True), ("notopenai.com", False)])
def test_official(spark, domain, want):
    assert value(spark, tx.official(F.col("a")), a=domain) is want


def test_cache_keys(spark):
    text = 'a "b" \\ \n 中文'
    want = hashlib.sha256(json.dumps({"model": "m", "text": text}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert value(spark, tx.vector_key(F.lit("m"), F.col("a")), a=text) == want
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("a").alias("content")))
    body = {"task": "t", "model": "m", "temperature": 0.2, "messages": [{"role": "user", "content": text}]}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert value(spark, tx.response_key(F.lit("t"), F.lit("m"), F.lit("0.2"), messages), a=text) == want


@pytest.mark.parametrize("raw,report,classify", [("0.5", (0.5, []), 0.5), ("8", (0.8, ["confidence_scaled_from_10"]), 0.08), ("92", (0.92, ["confidence_scaled_from_100"]), 0.92), ("150", (1.0, ["confidence_out_of_range"]), 1.0), ("x", (0.0, ["confidence_missing_or_invalid"]), None), ("-1", (0.0, ["confidence_out_of_range"]), 0.0), (None, (0.0, ["confidence_missing_or_invalid"]), None)])
def test_confidence(spark, raw, report, classify):
    got = value(spark, tx.report_confidence(F.col("a")), a=raw)
    assert (round(got["value"], 9), got["warnings"]) == report
    assert value(spark, tx.classify_confidence(F.col("a")), a=raw) == classify


@pytest.mark.parametrize("raw,want", [("1720000000", 1720000000), ("1720000000000", 1720000000), ("2024-07-03T09:46:40Z", 1720000000), ("2024-07-03T17:46:40", 1720000000), ("2024-07-03 17:46:40", 1720000000), ("Wed, 03 Jul 2024 09:46:40 GMT", 1720000000), ("Wed, 03 Jul 2024 11:46:40 +0200", 1720000000), ("0", None), ("", None), ("soon", None), (None, None)])
def test_dates(spark, raw, want):
    assert value(spark, F.unix_seconds(dates.normal_date(F.col("a"))), a=raw) == want


def test_types_and_json(spark):
    assert value(spark, tx.report_type(F.col("a")), a=" Product Launch ") == "product_release"
    assert value(spark, tx.report_type(F.col("a")), a="model") == "model" and value(spark, tx.report_type(F.col("a")), a="") == "unknown"
    assert value(spark, tx.extraction_type(F.col("a")), a="Model") == "model" and value(spark, tx.extraction_type(F.col("a")), a="x") == "other"
    assert value(spark, tx.rescued_object(F.col("a"), "k int")["k"], a='text {"k": 3} more') == 3
    assert value(spark, tx.event_id(F.lit("2026-07-07"), F.lit(1)), a="") == "evt_20260707_0001"
    assert html.unescape("&amp;") == "&"


def test_starts_equal_those_of_the_whole_text(spark):
    """The view's summary and entities came from the whole text, cleaned; now from its start."""
    texts = [None, "", "  ", "one", "1 2 one", "one two three", "ab\ncd", "ä one-two", "a" * 5000, "\n" * 400 + "x y", "x" + " \t" * 300 + "y z", "é" * 200, "😀 a😀b c", "a b c d", "x " * 200, " lead in"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = F.slice(F.filter(F.split(F.regexp_replace("t", r"[^A-Za-z ]+", " "), " +"), lambda w: w != ""), 1, 2)
    start = F.substring(F.regexp_replace("t", r"\s+", " "), 1, 160)
    for r in rows.select("i", whole.alias("a"), tx.leading_words(F.col("t")).alias("b"), start.alias("c"), tx.compact_start(F.col("t"), 160).alias("d")).collect():
        assert r.a == r.b and r.c == r.d, texts[r.i]
