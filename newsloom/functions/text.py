"""Text, URL, hash and value expressions (TX, UR, HS, NM, EN, AR, JS rows of the survey).

All are Column to Column and run inside the JVM.  ``(?U)`` makes white space
Unicode-aware; keyword tests are substring tests in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import rules


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """TX02: runs of white space to one blank, trimmed; null is empty."""
    return strip(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def normal_title(c: Column) -> Column:
    """TX01: compact, then each news prefix (and a separator) off the front once, in order."""
    return reduce(lambda t, p: F.regexp_replace(t, rf"(?U)^{p}[:：|｜-]?\s*", ""), rules.TITLE_PREFIXES, compact(c))


def has_any(c: Column, words: Iterable[str]) -> Column:
    """TX08: any word is contained, both in lower case."""
    return any_in(F.lower(text_or_empty(c)), words)


def any_in(lowered: Column, words: Iterable[str]) -> Column:
    """As ``has_any`` for text in lower case already: one expression for the whole list."""
    return lowered.rlike("|".join(re.escape(w.lower()) for w in words))


def mojibake(c: Column) -> Column:
    """TX03: two broken-encoding markers, or one and a question mark."""
    t = text_or_empty(c)
    hits = reduce(lambda a, b: a + b, [F.contains(t, F.lit(m)).cast("int") for m in rules.MOJIBAKE])
    return (hits >= 2) | (F.contains(t, F.lit("?")) & (hits >= 1))


def mostly_english(c: Column) -> Column:
    """TX04: 12 ASCII letters or more, and over twice the CJK characters."""
    t = compact(c)
    letters, cjk = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return (letters >= 12) & (letters > cjk * 2)


def quality(*cs: Column) -> Column:
    """TX05: missing, bad or ok."""
    joined = F.concat_ws(" ", *[text_or_empty(c) for c in cs])
    return F.when(strip(joined) == "", "missing").when(mojibake(joined), "bad").otherwise("ok")


def best_title(label: Column, titles: Column) -> Column:
    """TX06: of the non-blank titles prefer sound, then non-English ones, then the shortest up to 110."""
    every = F.filter(F.transform(F.concat(F.array(label), F.coalesce(titles, F.array().cast("array<string>"))), compact), lambda t: t != "")
    sound = F.filter(every, lambda t: ~mojibake(t))
    pool = F.when(F.size(sound) > 0, sound).otherwise(every)
    native = F.filter(pool, lambda t: ~mostly_english(t))
    pool = F.when(F.size(native) > 0, native).otherwise(pool)
    least = F.array_min(F.transform(pool, lambda t, i: F.struct((F.length(t) > 110).alias("long"), F.length(t).alias("n"), i.alias("i"), t.alias("t"))))
    return F.coalesce(least["t"], F.lit("Untitled event"))


def short_sentence(c: Column, fallback: Column, most: int = 120) -> Column:
    """TX07: the text, or the fallback, cut with dots beyond ``most``."""
    t = F.when(compact(c) != "", compact(c)).otherwise(compact(fallback))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"(?U)\s+$", ""), F.lit("...")))


def clean(c: Column) -> Column:
    """TX09: trimmed, null if empty."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def clean_list(c: Column) -> Column:
    """TX09/TX10: trimmed non-empty members; null is empty."""
    return F.coalesce(F.filter(F.transform(c, lambda x: strip(x.cast("string"))), lambda x: x != ""), F.array().cast("array<string>"))


def int_list(c: Column) -> Column:
    """TX10: members that are whole numbers."""
    return F.coalesce(F.filter(F.transform(c, lambda x: x.cast("string").try_cast("int")), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def tokens(c: Column) -> Column:
    """TX11: distinct lower-case tokens of 4 characters or more."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9_.-]{2,})"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) >= 4), F.lower))


def leading_words(c: Column) -> Column:
    """The first two runs of ASCII letters; reads the text no further than their end."""
    first = F.regexp_extract(c, r"\A[^A-Za-z]*+([A-Za-z]++)", 1)
    second = F.regexp_extract(c, r"\A[^A-Za-z]*+[A-Za-z]++[^A-Za-z]++([A-Za-z]++)", 1)
    return F.when(c.isNotNull(), F.filter(F.array(first, second), lambda w: w != ""))


def compact_start(c: Column, most: int) -> Column:
    """The first characters of the text with each run of white space as one blank; reads it no further."""
    start = F.regexp_extract(c, rf"\A(?:\s++|\S){{0,{most}}}+", 0)
    return F.substring(F.regexp_replace(start, r"\s+", " "), 1, most)


def ensure_sentence(c: Column) -> Column:
    """TX14: with a stop at the end; a fixed sentence for no text."""
    t = strip(text_or_empty(c))
    return F.when(t == "", F.lit("该事件缺少标题信息。")).when(t.rlike("[。.!?！？]$"), t).otherwise(F.concat(t, F.lit("。")))


def first_by_prefix(c: Column, most: int = 120) -> Column:
    """TX15: members in order without those whose first characters, in lower case, came before."""
    seen = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        key = F.substring(F.lower(t), 1, most)
        known = F.array_contains(acc["keys"], key)
        return F.when(known, acc).otherwise(F.struct(F.array_append(acc["keys"], key).alias("keys"), F.array_append(acc["out"], t).alias("out")))

    return F.aggregate(c, seen, step, lambda acc: acc["out"])


def key_sentences(c: Column, words: Column, most: int = 2) -> Column:
    """TX16: sentences of 30 characters or more by the words that they hold, then by length."""
    parts = F.transform(F.split(text_or_empty(c), r"(?U)(?<=[.!?])\s+"), strip)
    scored = F.transform(F.filter(parts, lambda s: F.length(s) >= 30), lambda s, i: F.struct((-F.size(F.filter(words, lambda w: F.contains(F.lower(s), w)))).alias("hits"), (-F.length(F.substring(s, 1, 320))).alias("n"), i.alias("i"), F.substring(s, 1, 320).alias("s")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["hits"] < 0)), 1, most), lambda x: x["s"])


def polish_text(c: Column, most: int) -> Column:
    """TX17 (queued): compact and cut."""
    return F.regexp_replace(F.substring(compact(c), 1, most), r"(?U)\s+$", "")


def polish_public(c: Column, most: int) -> Column:
    """TX17 (sync): as queued at twice the length, background sentences off, punctuation trimmed, a stop added."""
    t = reduce(lambda x, p: F.regexp_replace(x, p, ""), rules.BACKGROUND, polish_text(c, most * 2))
    t = F.regexp_replace(compact(t), "^[ ，,。]+|[ ，,。]+$", "")
    t = F.when((t != "") & ~t.rlike("[。！？.!?]$"), F.concat(t, F.lit("。"))).otherwise(t)
    return F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+$", "")


def trend_text(c: Column, most: int = 520) -> Column:
    """TX18: compact, list dashes and replacement characters off, cut."""
    t = F.regexp_replace(compact(c), r"^[-\s]+|\x{FFFD}", "")
    return F.regexp_replace(F.substring(t, 1, most), r"(?U)\s+$", "")


def truncate(c: Column, most: int) -> Column:
    """TX19: cut with an ellipsis."""
    t = compact(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"(?U)\s+$", ""), F.lit("…")))


def rewrite(c: Column, table: list[tuple[str, str]]) -> Column:
    """TX20/TX21: the value of the first key that the text contains; null if none."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for key, value in reversed(table):
        out = F.when(F.contains(low, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def token_estimate(c: Column) -> Column:
    """TX24: ASCII characters / 4 and others / 1.7, rounded down, 1 at least."""
    t = text_or_empty(c)
    ascii_n = F.regexp_count(t, F.lit(r"[\x00-\x7F]"))
    return F.greatest(F.lit(1), F.floor(ascii_n / 4 + (F.length(t) - ascii_n) / 1.7).cast("int"))


def joined(sep: str, *parts: Column) -> Column:
    """TX25: the non-empty parts."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def netloc(url: Column) -> Column:
    """UR03: authority part in lower case."""
    return F.lower(F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    """UR01: without user, port and ``www.``."""
    h = F.regexp_extract(F.regexp_replace(netloc(url), "^.*@", ""), "^([^:]*)", 1)
    return F.regexp_replace(h, r"^www\.", "")


def url_key(url: Column) -> Column:
    """UR02: scheme, authority and path without trailing slashes; empty if there is no scheme or authority."""
    scheme = F.lower(F.regexp_extract(text_or_empty(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when((scheme == "") | (netloc(url) == ""), F.lit("")).otherwise(F.regexp_replace(F.concat(scheme, F.lit("://"), netloc(url), path), "/+$", ""))


def official(domain: Column) -> Column:
    """UR04: an official domain or one below it."""
    return domain.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in rules.OFFICIAL_DOMAINS) + ")$")


def json_text(c: Column) -> Column:
    """A JSON string literal, non-ASCII kept."""
    t = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for ch, esc in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        t = F.replace(t, F.lit(ch), F.lit("\\" + esc))
    return F.concat(F.lit('"'), t, F.lit('"'))


def vector_key(model: Column, text: Column) -> Column:
    """HS01: SHA-256 of the sorted JSON object of model and text."""
    return F.sha2(F.concat(F.lit('{"model": '), json_text(model), F.lit(', "text": '), json_text(text), F.lit("}")).cast("binary"), 256)


def response_key(task: Column, model: Column, temperature: Column, messages: Column) -> Column:
    """HS02: SHA-256 of the sorted JSON object; ``messages``: array of (role, content), temperature as JSON text."""
    one = F.transform(messages, lambda m: F.concat(F.lit('{"content": '), json_text(m["content"]), F.lit(', "role": '), json_text(m["role"]), F.lit("}")))
    body = F.concat(F.lit('{"messages": ['), F.array_join(one, ", "), F.lit('], "model": '), json_text(model), F.lit(', "task": '), json_text(task), F.lit(', "temperature": '), temperature, F.lit("}"))
    return F.sha2(body.cast("binary"), 256)


def event_id(scrape_date: Column, index: Column) -> Column:
    """ID01: evt_YYYYMMDD_0001."""
    return F.concat(F.lit("evt_"), F.replace(F.substring(scrape_date, 1, 10), F.lit("-"), F.lit("")), F.lit("_"), F.when(F.length(index.cast("string")) >= 4, index.cast("string")).otherwise(F.lpad(index.cast("string"), 4, "0")))


def rescued_object(c: Column, schema: str) -> Column:
    """JS01: the text as a JSON object, or the widest ``{...}`` in it; null if neither parses."""
    whole = F.when(strip(c).startswith("{"), F.from_json(c, schema))
    return F.coalesce(whole, F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema))


def report_confidence(c: Column) -> Column:
    """NM01: struct(value, warnings): up to 10 and up to 100 are scaled, others clamped with a warning."""
    v = c.cast("string").try_cast("double")
    bad = v.isNull() | F.isnan(v)
    value = F.when(bad, 0.0).when(v.between(0, 1), v).when((v > 1) & (v <= 10), v / 10).when((v > 10) & (v <= 100), v / 100).otherwise(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))))
    warning = F.when(bad, "confidence_missing_or_invalid").when(v.between(0, 1), F.lit(None)).when((v > 1) & (v <= 10), "confidence_scaled_from_10").when((v > 10) & (v <= 100), "confidence_scaled_from_100").otherwise("confidence_out_of_range")
    return F.struct(value.alias("value"), F.array_compact(F.array(warning)).alias("warnings"))


def classify_confidence(c: Column) -> Column:
    """NM02: between 1 and 100 divided by 100, clamped to 0..1; null if not a number."""
    v = c.cast("string").try_cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((v > 1) & (v <= 100), v / 100).otherwise(v))))


def clamp(c: Column) -> Column:
    """NM03: to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def cosine(a: Column, b: Column) -> Column:
    """NM04: 0 for empty or unequal lengths or a zero norm."""
    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), total(a, b) / norm).otherwise(0.0)


def lookup(c: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """A small fixed table as an expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def extraction_type(c: Column) -> Column:
    """EN01: one of the extraction types, else other."""
    t = F.lower(strip(text_or_empty(c.cast("string"))))
    return F.when(t.isin(rules.EXTRACTION_TYPES), t).otherwise("other")


def report_type(c: Column) -> Column:
    """EN02: alias of the text, of its lower case, or the lower case; unknown if empty."""
    raw = strip(text_or_empty(c))
    low = F.lower(raw)
    return F.coalesce(lookup(raw, rules.TYPE_ALIASES), lookup(low, rules.TYPE_ALIASES), F.when(low == "", "unknown").otherwise(low))


def platform_kind(c: Column) -> Column:
    """EN03: kind of a platform in lower case."""
    return lookup(c, {p: kind for kind, (_, names) in rules.PLATFORM_KINDS.items() for p in names}, F.lit("unknown"))


def platform_weight(c: Column) -> Column:
    """EN03: weight of a platform in lower case."""
    return lookup(c, {p: w for w, names in rules.PLATFORM_KINDS.values() for p in names}, F.lit(rules.OTHER_PLATFORM))


def lowered_set(c: Column) -> Column:
    """AR03: distinct trimmed lower-case members, blanks off."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != ""))


def first_lowered(c: Column) -> Column:
    """EN04: the first non-blank member in lower case, else empty."""
    every = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != "")
    return F.coalesce(F.get(every, 0), F.lit(""))


def top_titles(c: Column, most: int = 5) -> Column:
    """AR01: the shortest distinct titles, ties by text."""
    return F.transform(F.slice(F.array_sort(F.transform(F.array_distinct(c), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), 1, most), lambda x: x["t"])


def blocked_page(html: Column, markers: list[str] = rules.PAGE_MARKERS, first: int | None = None) -> Column:
    """SRC08: an access-block page, by marker words."""
    body = F.lower(text_or_empty(html))
    return any_in(F.substring(body, 1, first) if first else body, markers)
