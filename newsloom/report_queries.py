"""Queries of the report chain and their DuckDB SQL, which replays every choice of the sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import oracle
from newsloom.functions import rules
from newsloom.functions import text as tx
from newsloom.operators import documents, evidence, sections, vectors
from newsloom.plans import report
from newsloom.sources import feeds, workdir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_q, _in, _any, _case, _clamp, _compact = oracle._q, oracle._in, oracle._any, oracle._case, oracle._clamp, oracle._compact


def _query(sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return add


# ---------------------------------------------------------------- the same rules in SQL


def _english(t: str) -> str:
    """TX04 for a compact text."""
    letters = f"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    return f"({letters} >= 12 AND {letters} > 2 * length(regexp_replace({t}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')))"


def _mojibake(t: str) -> str:
    hits = "(" + " + ".join(f"CAST(contains({t}, {_q(m)}) AS INT)" for m in rules.MOJIBAKE) + ")"
    return f"({hits} >= 2 OR (contains({t}, '?') AND {hits} >= 1))"


def _short(t: str, fallback: str) -> str:
    c = f"(CASE WHEN {_compact(t)} <> '' THEN {_compact(t)} ELSE {_compact(fallback)} END)"
    return f"(CASE WHEN length({c}) <= 120 THEN {c} ELSE regexp_replace(substr({c}, 1, 119), '{oracle.WS}+$', '') || '...' END)"


def _rewrite(t: str, table: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({t}), {_q(k)}) THEN {_q(v)}" for k, v in table) + " END"


def _summaries() -> str:
    """CTEs that end in ``y``: z with title, one_sentence and why_important."""
    action = "CASE " + " ".join(f"WHEN regexp_matches(both_, {_q(p)}) THEN {_q(v)}" for p, v in rules.ACTIONS) + " ELSE '更新' END"
    details = "list_filter([" + ", ".join(f"CASE WHEN {_any('lower(both_)', words)} THEN {_q(v)} END" for words, v in rules.DETAILS) + "], lambda d: d IS NOT NULL)[1:3]"
    return f"""{oracle.scored()}, y1 AS (
  SELECT *, list_filter(list_transform(list_concat([label], titles), lambda t: {_compact("t")}), lambda t: t <> '') AS every FROM z
), y2 AS (
  SELECT *, CASE WHEN len(list_filter(every, lambda t: NOT {_mojibake("t")})) > 0 THEN list_filter(every, lambda t: NOT {_mojibake("t")}) ELSE every END AS sound FROM y1
), y3 AS (
  SELECT *, CASE WHEN len(list_filter(sound, lambda t: NOT {_english("t")})) > 0 THEN list_filter(sound, lambda t: NOT {_english("t")}) ELSE sound END AS pool FROM y2
), y4 AS (
  SELECT *, coalesce(list_sort(list_transform(pool, lambda t, i: {{'far': length(t) > 110, 'n': length(t), 'i': i, 't': t}}))[1].t, 'Untitled event') AS raw_title FROM y3
), y5 AS (
  SELECT *, coalesce({_rewrite("raw_title", rules.TITLE_REWRITES)}, raw_title) AS title FROM y4
), y6 AS (
  SELECT *, {_short("summary", "title")} AS plain_sentence FROM y5
), y7 AS (
  SELECT *, coalesce({_rewrite("(raw_title || ' ' || plain_sentence)", rules.SUMMARY_REWRITES)}, plain_sentence) AS sentence FROM y6
), y8 AS (
  SELECT *, sentence || ' ' || title AS both_, coalesce(list_filter(entities, lambda e: NOT {_english("e")})[1], entities[1], nullif(trim(regexp_extract(title, '^([A-Z][A-Za-z0-9.&-]*(?:\\s+[A-Z][A-Za-z0-9.&-]*){{0,2}})', 1)), ''), '相关机构') AS subject FROM y7
), y9 AS (
  SELECT *, {details} AS details FROM y8
), y AS (
  SELECT *, CASE WHEN NOT {_english(_compact("sentence"))} THEN sentence WHEN NOT {_english(_compact("title"))} THEN {_short("title", "title")}
    ELSE subject || {action} || {_case("kind", rules.TYPE_NOUNS, "'AI 动态'")} || CASE WHEN len(details) > 0 THEN '，重点涉及' || array_to_string(details, '、') ELSE '' END || '。' END AS one_sentence, {_case("kind", rules.WHY, _q(rules.WHY_OTHER))} AS why_important FROM y9
)"""


def _flags() -> str:
    """CTEs that end in ``v``: y with flags, section scores, candidates of each section and tags."""
    focus = list(rules.FOCUS_WORDS)
    strategic = f"least(7.0, {' + '.join(f'CASE WHEN {k} THEN 4.0 ELSE 0.0 END' for k in focus)})"
    scores = []
    for section, weights in rules.SECTION_WEIGHTS.items():
        x = " + ".join(f"{part}_score * CAST({w} AS DOUBLE)" for part, w in weights.items())
        if section == "watchlist":
            x = f"{x} + least(risk_penalty, 24.0) * CAST(0.08 AS DOUBLE) - greatest(risk_penalty - 24.0, 0.0) * CAST(0.5 AS DOUBLE)"
        else:
            x = f"{x} - risk_penalty * CAST({rules.SECTION_RISK[section]} AS DOUBLE)"
        x = f"{x} + strategic * CAST({rules.SECTION_STRATEGIC[section]} AS DOUBLE)"
        x += {"insight": " + CASE WHEN is_paper THEN 6.0 ELSE 0.0 END", "deep_asset": " + CASE WHEN is_reusable THEN 5.0 ELSE 0.0 END"}.get(section, "")
        scores.append(f"round({_clamp(x)}, 2) AS scores_{section}")
    flag = lambda c, name: f"CASE WHEN {c} THEN '{name}' END"
    tags = ["kind", "content_layer", "verify_status", flag("final_score >= 80", "high_score"), flag("actionability_score >= 70", "actionable"), flag("novelty_score >= 72", "novel"), flag("risk_penalty >= 12", "risk"), flag("source_score >= 80", "strong_source"), flag("n = 1", "single_platform"), flag("is_community", "community_only"), flag("is_asset", "asset_candidate"), flag("is_top", "top_news_candidate")]
    sourced = "verify_status IN ('verified', 'single_source')"
    may = {
        "top_news": "content_layer = 'news' AND is_top",
        "insight": f"{sourced} AND risk_penalty <= 18 AND ((content_layer = 'insight' AND final_score >= 58) OR (kind IN {_in(rules.PAPER_TYPES)} AND final_score >= 56) OR (is_paper AND final_score >= 50 AND source_score >= 70))",
        "deep_asset": f"is_asset AND {sourced} AND final_score >= 60",
        "watchlist": f"((verify_status = 'rumor' AND importance_score >= 55) OR (verify_status = 'single_source' AND final_score >= 74 AND importance_score >= 70) OR (is_community AND final_score >= 68 AND importance_score >= 70) OR (kind IN {_in(rules.WATCH_TYPES)} AND risk_penalty >= 12 AND final_score >= 65))",
    }
    hinted = " OR ".join(f"contains(p, '{h}')" for h in rules.COMMUNITY_HINTS)
    return f"""{_summaries()}, v1 AS (
  SELECT *, lower(title || ' ' || one_sentence || ' ' || kind || ' ' || array_to_string(entities, ' ')) AS short_text, lower(title || ' ' || one_sentence || ' ' || why_important || ' ' || kind || ' ' || array_to_string(entities, ' ')) AS long_text,
    coalesce(lower(entities[1]), '') AS main_entity, coalesce(lower(platforms[1]), '') AS main_platform, {strategic} AS strategic FROM y
), v2 AS (
  SELECT *, coalesce(list_has_any(platforms, {oracle._list(rules.PAPER_PLATFORMS)}), false) OR (kind IN {_in(rules.PAPER_TYPES)} AND {_any("short_text", rules.PAPER_WORDS)}) AS is_paper, list_contains(platforms, 'huggingface_papers_trending') AS is_trending, {_any("long_text", rules.REUSABLE_WORDS)} AS is_reusable,
    len(platforms) > 0 AND len(list_filter(platforms, lambda p: NOT ({hinted}))) = 0 AS is_community, verify_status <> 'rumor' AND final_score >= 72 AND risk_penalty <= 18 AS is_top FROM v1
), v3 AS (
  SELECT *, NOT {_any("short_text", rules.ASSET_EXCLUDE)} AND (kind IN {_in(rules.ASSET_TYPES)} OR content_layer IN ('insight', 'deep_asset')) AND ({_any("short_text", rules.ASSET_WORDS)} OR is_reusable OR link)
    AND (actionability_score >= 70 OR novelty_score >= 72 OR (is_paper AND final_score >= 52)) AND risk_penalty <= 18 AS is_asset FROM v2
), v AS (
  SELECT *, {", ".join(scores)}, {", ".join(f"verify_status <> 'needs_review' AND {c} AS may_{k}" for k, c in may.items())}, list_sort(list_distinct(list_filter([{", ".join(tags)}], lambda t: t IS NOT NULL))) AS tags FROM v3
)"""


def _best(section: str) -> str:
    return f"scores_{section} DESC, final_score DESC, importance_score DESC, source_score DESC, doc_id"


def _assigned() -> str:
    """CTEs that end in ``chosen``: report_date, doc_id, report_section and position."""
    row = lambda s: f"{{'id': doc_id, 'paper': is_paper, 'trending': is_trending, 'reusable': is_reusable, 'score': scores_{s}, 'final': final_score, 'imp': importance_score, 'src': source_score}}"
    limits = _case("x.kind", rules.TOP_TYPE_LIMITS, rules.OTHER_TYPE_LIMIT)
    parts = [f"""tc AS (
  SELECT report_date, doc_id, {{'id': doc_id, 'kind': kind, 'entity': main_entity, 'platform': main_platform}} AS x, row_number() OVER (PARTITION BY report_date ORDER BY {_best("top_news")}) AS pos FROM v WHERE may_top_news
), tg AS (
  SELECT report_date, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(id BIGINT, kind VARCHAR, entity VARCHAR, platform VARCHAR)[]) AS held FROM (SELECT DISTINCT report_date FROM v)
  UNION ALL
  SELECT tc.report_date, tc.pos, CASE WHEN len(held) < {rules.SECTION_SIZES["top_news"]} AND len(list_filter(held, lambda h: h.kind = x.kind)) < {limits} AND (x.entity = '' OR len(list_filter(held, lambda h: h.entity = x.entity)) < {rules.ENTITY_LIMIT})
    AND (x.platform = '' OR len(list_filter(held, lambda h: h.platform = x.platform)) < {rules.PLATFORM_LIMIT}) THEN list_append(held, x) ELSE held END
  FROM tg JOIN tc ON tc.report_date = tg.report_date AND tc.pos = tg.pos + 1
), s_top_news AS (
  SELECT report_date, list_transform(arg_max(held, pos), lambda h: h.id) AS ids FROM tg GROUP BY report_date
)"""]
    gone = "s_top_news"
    for section in ("insight", "deep_asset", "watchlist"):
        limit = rules.SECTION_SIZES[section]
        reusable = "x.reusable AND " if section == "deep_asset" else ""
        may = {"paper": f"x.paper AND {reusable}x.score >= 58", "trending": f"x.trending AND {'x.paper AND ' if section == 'deep_asset' else ''}{reusable}x.score >= 58"}
        parts.append(f"""o_{section} AS (
  SELECT v.report_date, {row(section)} AS x, row_number() OVER (PARTITION BY v.report_date ORDER BY {_best(section)}) AS pos, main_entity = '' OR row_number() OVER (PARTITION BY v.report_date, main_entity ORDER BY {_best(section)}) = 1 AS first
  FROM v JOIN {gone} USING (report_date) WHERE may_{section} AND NOT list_contains(ids, doc_id)
), l_{section} AS (
  SELECT report_date, list(x ORDER BY pos) AS open, (list(x ORDER BY pos) FILTER (WHERE first))[1:{limit}] AS held0 FROM o_{section} GROUP BY report_date
)""")
        held = "held0"
        if section != "watchlist":
            for n, kind in enumerate(("paper", "trending"), 1):
                source = f"l_{section}" if n == 1 else f"f{n - 1}_{section}"
                weakest = f"list_sort(list_transform({held}, lambda h, i: {{'paper': h.paper, 'score': h.score, 'i': i}}))[1].i"
                extra = f"list_filter(open, lambda x: {may[kind]})[1]"
                parts.append(f"""e{n}_{section} AS (SELECT *, {extra} AS extra{n} FROM {source}), f{n}_{section} AS (
  SELECT *, CASE WHEN extra{n} IS NULL OR len(list_filter({held}, lambda h: h.{kind} OR h.id = extra{n}.id)) > 0 THEN {held} WHEN len({held}) < {limit} THEN list_append({held}, extra{n})
    ELSE list_transform({held}, lambda h, i: CASE WHEN i = {weakest} THEN extra{n} ELSE h END) END AS held{n} FROM e{n}_{section}
)""")
                held = f"held{n}"
            ids = f"list_transform(list_sort(list_transform({held}, lambda h, i: {{'a': -h.score, 'b': -h.final, 'c': -h.imp, 'd': -h.src, 'i': i, 'id': h.id}}))[1:{limit}], lambda h: h.id)"
            source = f"f2_{section}"
        else:
            ids, source = "list_transform(held0, lambda h: h.id)", f"l_{section}"
        parts.append(f"s_{section} AS (SELECT report_date, {ids} AS ids FROM {source}), g_{section} AS (SELECT g0.report_date, list_concat(g0.ids, coalesce(s.ids, [])) AS ids FROM {gone} g0 LEFT JOIN s_{section} s USING (report_date))")
        gone = f"g_{section}"
    every = " UNION ALL ".join(f"SELECT report_date, '{s}' AS report_section, unnest(ids) AS doc_id, unnest(generate_series(1, len(ids))) AS position FROM s_{s} WHERE len(ids) > 0" for s in rules.SECTION_SIZES)
    return f"{_flags()}, {', '.join(parts)}, chosen AS ({every})"


_ALL = f"WITH RECURSIVE {_assigned()}"
SECTION_TABLE = f"""{_ALL}
SELECT CAST(v.report_date AS VARCHAR) AS report_date, report_section, CAST(position AS INT) AS position, event_id, final_score, array_to_string(list_sort(list_distinct(list_append(tags, report_section))), ',') AS tags, scores_top_news, scores_insight, scores_deep_asset, scores_watchlist
FROM chosen JOIN v ON v.report_date = chosen.report_date AND v.doc_id = chosen.doc_id
"""
REPORT_STATS = f"""{_ALL}
SELECT CAST(v.report_date AS VARCHAR) AS report_date, count(*) AS events, count(report_section) AS selected, count(*) FILTER (WHERE sources > 0) AS with_sources FROM v LEFT JOIN chosen USING (report_date, doc_id) GROUP BY v.report_date
"""


# ---------------------------------------------------------------- queries


@_query(f"WITH {_summaries()} SELECT event_id, md5(title) AS title, md5(one_sentence) AS sentence, md5(why_important) AS why FROM y")
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX06, TX20-TX23, SC10: title, sentence and reason of every event."""
    hashed = lambda c: F.md5(F.col(c).cast("binary"))
    return report.enriched(spark, sf_dir).select("event_id", hashed("title").alias("title"), hashed("one_sentence").alias("sentence"), hashed("why_important").alias("why"))


_MARKS = ["is_paper", "is_trending", "is_reusable", "is_community", "is_asset", "is_top", *[f"{x}_{s}" for x in ("may", "scores") for s in rules.SECTION_SIZES]]


@_query(f"WITH {_flags()} SELECT event_id, {', '.join(_MARKS)}, main_entity, main_platform, array_to_string(tags, ',') AS tags FROM v")
def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL04-FL10, MP01, SC08, SC09, AR02, TX28, ST04: flags, section scores, section candidates and tags of every event."""
    rows = sections.with_flags(sections.with_order(report.enriched(spark, sf_dir)))
    made, may = sections.section_scores(), sections.section_candidates()
    rows = rows.withColumns({f"scores_{k}": v for k, v in made.items()} | {f"may_{k}": F.coalesce(v, F.lit(False)) for k, v in may.items()} | {"tags": F.array_join(sections.tags(), ",")})
    return rows.select("event_id", *_MARKS, "main_entity", "main_platform", "tags")


@_query(f"""{_ALL}
SELECT CAST(v.report_date AS VARCHAR) AS report_date, v.event_id, final_score FROM v LEFT JOIN chosen USING (report_date, doc_id) WHERE report_section IS NULL AND verify_status <> 'needs_review' AND final_score >= 60
QUALIFY row_number() OVER (PARTITION BY v.report_date ORDER BY final_score DESC, importance_score DESC, source_score DESC, doc_id) <= 50
""")
def unselected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO03, RP04, JN11: of each day the first events of a high score that no section took."""
    return sections.unselected(report.assigned(spark, sf_dir)).select(F.col("report_date").cast("string").alias("report_date"), "event_id", "final_score")


@_query(f"WITH {oracle.scored()} SELECT CAST(report_date AS VARCHAR) AS report_date, event_id, verify_status FROM z WHERE verify_status = 'needs_review'")
def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL19: events to look at by hand."""
    return sections.review_queue(report.assigned(spark, sf_dir)).select(F.col("report_date").cast("string").alias("report_date"), "event_id", "verify_status")


def _watch_reason() -> str:
    everything = "lower(concat_ws(' ', title, one_sentence, why_important, kind, array_to_string(entities, ' '), array_to_string(platforms, ' ')))"
    return f"CASE WHEN verify_status = 'rumor' OR is_community THEN 0 WHEN {_any(everything, rules.COMPUTE_WORDS)} THEN 1 WHEN {_any(everything, rules.BIOMED_WORDS)} THEN 2 WHEN kind IN {_in(rules.POLICY_TYPES)} THEN 3 ELSE 4 END"


@_query(f"WITH {_flags()} SELECT event_id, CAST({_watch_reason()} AS INT) AS reason FROM v")
def watch_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL12: which reason each event would have on the watch list."""
    rows = report.assigned(spark, sf_dir)
    texts = ["来源更偏线索", "算力或芯片方向", "生物医药交叉", "政策或治理方向"]
    reason = sections.watch_reason()
    number = F.lit(4)
    for i, start in reversed(list(enumerate(texts))):
        number = F.when(F.startswith(reason, F.lit(start)), i).otherwise(number)
    return rows.select("event_id", number.cast("int").alias("reason"))


# ---------------------------------------------------------------- the public document


def _document() -> str:
    nl = "chr(10)"
    part = {s: f"{_q(f'## {title}')} || {nl} || {nl} || coalesce(max(block) FILTER (WHERE report_section = '{s}'), {_q(empty)} || {nl})" for s, title, empty in documents.SECTIONS}
    status = f"CASE WHEN report_section = 'watchlist' THEN '待观察' ELSE {_case('verify_status', rules.STATUS_LABELS, 'verify_status')} END"
    trend = f"'今天入选内容整体呈现出从产业基础设施到方法沉淀同步推进的特征：' || examples || ' 等事件说明，市场关注点正在从单点模型能力扩展到算力供给、部署成本、企业落地和可复用技术资产。从类型分布看，今天更集中的信号包括：' || topics || '；同时有 ' || research || ' 条内容来自研究、评测、论文或长期资源层，说明值得跟踪的不只是即时新闻，也包括后续可能影响产品路线和工程实践的方法类成果。'"
    tail = "> 说明：本报告面向群内阅读；评分、栏目分和标签等调试信息已单独写入 daily_report_debug.md 和 report_candidates.json。"
    return f"""{_ALL}, src AS (
  SELECT event_id, list({{'k': coalesce(u, platform), 'p': platform, 'u': u}} ORDER BY doc_id) AS its FROM (SELECT *, CASE WHEN doc_id % 3 < 2 THEN 'https://www.site' || doc_id % 50 || '.example.com/a/' || doc_id END AS u FROM items) GROUP BY event_id
), links AS (
  SELECT event_id, array_to_string(list_transform(list_filter(its, lambda x, i: list_position(list_transform(its, lambda y: y.k), x.k) = i)[1:3], lambda x: CASE WHEN x.u IS NOT NULL THEN '[' || x.p || '](' || x.u || ')' ELSE x.p END), ', ') AS sources_text FROM src
), sel AS (
  SELECT v.*, report_section, position, sources_text FROM chosen JOIN v USING (report_date, doc_id) JOIN links USING (event_id)
), entry AS (
  SELECT report_date, report_section, position, array_to_string([position || '. **' || title || '**', '   - 简报：' || one_sentence, '   - 为什么重要：' || why_important, '   - 来源：' || sources_text, '   - 状态：' || {status}, ''], {nl}) AS entry FROM sel
), block AS (
  SELECT report_date, report_section, string_agg(entry, {nl} ORDER BY position) AS block FROM entry GROUP BY ALL
), news AS (
  SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY {_best("top_news")}) AS best, row_number() OVER (PARTITION BY report_date ORDER BY final_score DESC, importance_score DESC, source_score DESC, doc_id) AS seen FROM sel WHERE report_section <> 'watchlist'
), topic AS (
  SELECT report_date, {_case("kind", rules.TOPIC_LABELS, "kind")} || ' ' || count(*) || ' 条' AS t, row_number() OVER (PARTITION BY report_date ORDER BY count(*) DESC, min(seen)) AS r FROM news GROUP BY report_date, kind
), trend AS (
  SELECT report_date, (SELECT string_agg(t, '、' ORDER BY r) FROM topic WHERE topic.report_date = news.report_date AND r <= 4) AS topics, string_agg('“' || title || '”', '、' ORDER BY best) FILTER (WHERE best <= 3) AS examples, count(*) FILTER (WHERE report_section IN ('insight', 'deep_asset')) AS research FROM news GROUP BY report_date
), days AS (SELECT DISTINCT report_date FROM v)
SELECT CAST(days.report_date AS VARCHAR) AS report_date, array_to_string(['# AI 情报早报 - ' || CAST(days.report_date AS VARCHAR) || {nl}, {part["top_news"]}, {part["insight"]}, {part["deep_asset"]}, '## 四、今日趋势观察' || {nl} || {nl} || coalesce({trend.replace("examples", "any_value(examples)").replace("topics", "any_value(topics)").replace("research", "any_value(research)")}, '今日入选内容不足，暂不生成趋势观察。') || {nl}, {part["watchlist"]}, {nl} || {_q(tail)}], {nl}) || {nl} AS document
FROM days LEFT JOIN block USING (report_date) LEFT JOIN trend USING (report_date) GROUP BY days.report_date
"""


DAILY_DOCUMENTS = _document()


# ---------------------------------------------------------------- evidence sources, keys and requests


@_query(r"""
WITH u AS (
  SELECT page_id, page_id // 6 AS event, page_id % 6 AS pos, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS netloc, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE regexp_matches(url, '^https?://')
), k AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':.*$', ''), '^www\.', '') AS domain, regexp_replace(scheme || '://' || netloc || path, '/+$', '') AS url_key, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS priority FROM u
), f AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY event, url_key ORDER BY priority, domain, pos) = 1
)
SELECT 'e' || event AS event_id, CAST(page_id AS INT) AS page_id, domain, CAST(row_number() OVER (PARTITION BY event ORDER BY priority, domain, pos) AS INT) AS nth FROM f QUALIFY nth <= 2
""")
def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN07: six pages an event as its sources: the first of each canonical URL, two an event by priority."""
    n = F.col("page_id")
    platform = F.when(n % 5 == 0, "arXiv daily").when(n % 5 == 1, "Wired").when(n % 5 == 2, "InfoQ").otherwise("a blog")
    one = F.struct((n % 6).alias("pos"), F.struct(platform.alias("platform"), F.lit("").alias("title"), "url", n.cast("int").alias("source_news_id")).alias("s"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    events = pages.groupBy(F.concat(F.lit("e"), F.floor(n / 6).cast("string")).alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("source_items")).withColumn("report_date", F.lit("2024-01-01"))
    return evidence.select_sources(events).select("event_id", F.col("source_news_id").alias("page_id"), "domain", "nth")


@_query(r"""
SELECT doc_id, coalesce(split_part(source, 'c', 2), '') AS main_entity, lang AS event_type, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[A-Za-z0-9][A-Za-z0-9_.-]{2,}'), lambda x: len(x) >= 4), lambda x: lower(x))))[1:8], ' '), '') AS title_key FROM documents
""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG06, TX11: the duplicate key of every document as an event."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.array(F.split_part("source", F.lit("c"), F.lit(2))).alias("entities"), F.col("lang").alias("normalized_event_type"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return rows.select("doc_id", evidence.duplicate_key().alias("k")).select("doc_id", "k.main_entity", "k.event_type", "k.title_key")


@_query("""
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD02: the similarity of every vector and the next."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(vectors.cosine_batches(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@_query("""
SELECT lang AS run_id, CAST(doc_id // 40 AS INT) AS group_index, count(*) AS size, string_agg(doc_id, ',' ORDER BY doc_id % 7, doc_id) AS ids, md5(string_agg(coalesce(source, 'none'), '|' ORDER BY doc_id % 7, doc_id)) AS platforms FROM documents GROUP BY ALL
""")
def extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM04, EM02: a JSON request for each group of documents, rows in group order, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("run_id"), F.col("doc_id").alias("key"), F.col("doc_id").alias("index"), F.col("source").alias("platform"))
    place = F.row_number().over(Window.partitionBy("run_id", F.floor(F.col("key") / 40)).orderBy(F.col("key") % 7, "key"))
    groups = docs.select("run_id", F.col("key").cast("string").alias("key"), F.floor(F.col("key") / 40).cast("int").alias("group_index"), place.alias("position"))
    asked = vectors.batches(docs, groups, ["index", "platform"])
    said = F.from_json("request", "array<struct<index:long,platform:string>>")
    return asked.select("run_id", "group_index", "size", F.array_join(F.transform(said, lambda x: x["index"].cast("string")), ",").alias("ids"), F.md5(F.array_join(F.transform(said, lambda x: F.coalesce(x["platform"], F.lit("none"))), "|").cast("binary")).alias("platforms"))


@_query("""
SELECT doc_id, md5(concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), nullif(split_part(coalesce(text, ''), chr(10), 1), ''))) AS said FROM documents
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX25: the non-empty parts of every document as one text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(tx.joined("\n", F.col("source"), F.col("lang"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).cast("binary")).alias("said"))


@_query("""
SELECT 'a' AS step, lang AS platform, doc_id AS id, CAST(NULL AS VARCHAR) AS url FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', lang, doc_id, NULL FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'c', NULL, page_id, url FROM pages
""")
def combined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, ST01: items of three ingest steps as one table, nothing dropped."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    parts = [docs.where(F.col("doc_id") % k == 0).select(F.lit(step).alias("step"), F.col("lang").alias("platform"), F.col("doc_id").alias("id")) for step, k in (("a", 2), ("b", 3))]
    return feeds.combined([*parts, pages.select(F.lit("c").alias("step"), F.col("page_id").alias("id"), "url")])


@_query("""
SELECT 'r' || user_id % 9 AS run_id, event_type AS step_id, max(event_id) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS finished, 'r' || user_id % 9 || '/' || event_type AS folder FROM events GROUP BY ALL
""")
def checkpoint_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14: checkpoint files in folders of run and step, read back oldest first."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.groupBy((F.col("user_id") % 9).alias("u"), "event_type").agg(F.max("ts").alias("finished_at"), F.max("event_id").alias("n"))
    at = f"{workdir.new_path(spark, 'checkpoints')}/tree"
    body = last.select(F.concat(F.lit("r"), F.col("u").cast("string")).alias("run"), F.col("event_type").alias("step"), F.to_json(F.struct(F.concat(F.lit("r"), F.col("u").cast("string")).alias("run_id"), F.col("event_type").alias("step_id"), "n", F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("finished_at"), F.concat_ws("/", F.concat(F.lit("r"), F.col("u").cast("string")), "event_type").alias("started_at"))).alias("value"))
    body.write.partitionBy("run", "step").text(at)
    rows = feeds.read_checkpoints(spark, at, "run_id string, step_id string, n long, started_at string, finished_at string", "*.txt")
    folder = F.concat_ws("/", F.regexp_extract("path", "/run=([^/]+)/", 1), F.regexp_extract("path", "/step=([^/]+)/", 1))
    return rows.select("run_id", "step_id", "n", F.substring("finished_at", 1, 19).alias("finished"), folder.alias("folder"))


@_query(f"""{_ALL}, sel AS (
  SELECT v.*, report_section FROM chosen JOIN v USING (report_date, doc_id) WHERE report_section <> 'watchlist'
), p AS (
  SELECT report_date, string_agg(report_section, ',' ORDER BY final_score DESC, importance_score DESC, source_score DESC, doc_id) AS sections, md5(string_agg(title || '|' || one_sentence || '|' || why_important || '|' || kind || '|' || array_to_string(entities, ','), chr(10) ORDER BY final_score DESC, importance_score DESC, source_score DESC, doc_id)) AS selected FROM sel GROUP BY report_date
), t AS (
  SELECT report_date, count(*) AS titles, md5(string_agg(title, chr(10) ORDER BY final_score DESC, importance_score DESC, source_score DESC, doc_id)) AS all_titles FROM v WHERE verify_status <> 'needs_review' GROUP BY report_date
)
SELECT CAST(report_date AS VARCHAR) AS report_date, sections, selected, titles, all_titles FROM p JOIN t USING (report_date)
""")
def trend_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM12: what each day's trend request says, read back from its JSON."""
    said = F.from_json("request", "selected_events array<struct<section:string,title:string,brief:string,why_important:string,type:string,entities:array<string>>>, all_titles array<string>")
    rows = evidence.trend_requests(report.assigned(spark, sf_dir)).withColumn("said", said)
    one = lambda e: F.concat_ws("|", e["title"], e["brief"], e["why_important"], e["type"], F.array_join(e["entities"], ","))
    return rows.select(
        F.col("report_date").cast("string").alias("report_date"), F.array_join(F.transform("said.selected_events", lambda e: e["section"]), ",").alias("sections"), F.md5(F.array_join(F.transform("said.selected_events", one), "\n").cast("binary")).alias("selected"),
        F.size("said.all_titles").cast("long").alias("titles"), F.md5(F.array_join("said.all_titles", "\n").cast("binary")).alias("all_titles"),
    )


@_query(f"""{_ALL}, st AS (
  SELECT event_id, array_to_string((list(title ORDER BY doc_id))[1:6], '|') AS source_titles FROM items GROUP BY event_id
)
SELECT CAST(v.report_date AS VARCHAR) AS report_date, v.event_id, md5(v.title || '|' || one_sentence || '|' || why_important) AS texts, kind AS event_type, report_section, verify_status AS status, array_to_string(entities[1:8], ',') AS entities, array_to_string(platforms[1:8], ',') AS platforms, md5(source_titles) AS source_titles
FROM chosen JOIN v USING (report_date, doc_id) JOIN st USING (event_id)
""")
def polish_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM11: what each selected event's polish request says, read back from its JSON."""
    rows = report.assigned(spark, sf_dir)
    items = evidence.select_sources(rows.where("should_include_report")).withColumns({"text": F.lit(""), "fetched": F.lit(False)})
    kind = "current_title string, current_brief string, current_why_important string, event_type string, report_section string, verify_status_for_internal_use_only string, entities array<string>, platforms array<string>, source_titles array<string>"
    said = evidence.polish_requests(rows, items).withColumn("s", F.from_json("request", kind))
    return said.select(
        F.col("report_date").cast("string").alias("report_date"), "event_id", F.md5(F.concat_ws("|", "s.current_title", "s.current_brief", "s.current_why_important").cast("binary")).alias("texts"), "s.event_type", "s.report_section", F.col("s.verify_status_for_internal_use_only").alias("status"),
        F.array_join("s.entities", ",").alias("entities"), F.array_join("s.platforms", ",").alias("platforms"), F.md5(F.array_join("s.source_titles", "|").cast("binary")).alias("source_titles"),
    )
