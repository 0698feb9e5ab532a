"""DuckDB SQL that gives the same rows as the queries, written on its own terms."""

from __future__ import annotations

from newsloom.functions import rules
from newsloom.operators.runlog import HISTORY
from newsloom.plans.news_view import PLATFORMS, TYPES

#: Unicode white space for RE2.
WS = r"[\t-\r\x{85}\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w.lower())})" for w in words) + ")"


def _case(column: str, table: dict, default) -> str:
    lit = lambda v: _q(v) if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"




def _compact(t: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({t}, ''), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


_NORMAL = {t: rules.TYPE_ALIASES.get(t, rules.TYPE_ALIASES.get(t.lower(), t.lower() or "unknown")) for t in TYPES}

VIEW = f"""
items AS (
  SELECT d.doc_id, d.text, CAST(e.ts AS DATE) AS report_date, e.ts, {_list(PLATFORMS)}[CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INT) % {len(PLATFORMS)} + 1] AS platform,
    substr(split_part(d.text, chr(10), 1), 1, 90) AS title, 'evt_' || (d.doc_id - d.doc_id % 2) AS event_id, d.doc_id % 11 <> 0 AS dated, date_trunc('second', e.ts) AS moment
  FROM documents d JOIN events e ON d.doc_id = e.event_id
)"""

def _text() -> str:
    return f"""
WITH t AS (SELECT doc_id, text, {_compact("text")} AS c FROM documents),
n AS (SELECT *, {_prefixes()} AS title,
  {" + ".join(f"CAST(contains(coalesce(text, ''), {_q(m)}) AS INT)" for m in rules.MOJIBAKE)} AS hits,
  length(regexp_replace(c, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(c, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS cjk,
  length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g')) AS plain FROM t)
SELECT doc_id, md5(title) AS title_md5, md5(c) AS compact_md5, hits >= 2 OR (contains(coalesce(text, ''), '?') AND hits >= 1) AS mojibake, letters >= 12 AND letters > cjk * 2 AS english,
  CASE WHEN c = '' THEN 'missing' WHEN hits >= 2 OR (contains(text, '?') AND hits >= 1) THEN 'bad' ELSE 'ok' END AS quality,
  CASE WHEN c = '' THEN 'none' WHEN length(c) <= 120 THEN c ELSE regexp_replace(substr(c, 1, 119), '{WS}+$', '') || '...' END AS short,
  {_any("lower(coalesce(text, ''))", ["license", "secret", "token"])} AS keyword, CAST(greatest(1, floor(plain / 4 + (length(coalesce(text, '')) - plain) / 1.7)) AS INT) AS tokens
FROM n
"""


def _prefixes() -> str:
    out = "c"
    for p in rules.TITLE_PREFIXES:
        out = f"regexp_replace({out}, '^{p}[:：|｜-]?{WS}*', '')"
    return out


TOKENS = r"""
WITH t AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_.-]{2,}'), lambda x: len(x) >= 4), lambda x: lower(x))) AS a,
  list_distinct(list_transform(list_filter(regexp_extract_all(split_part(coalesce(text, ''), chr(10), 1), '[A-Za-z0-9][A-Za-z0-9_.-]{2,}'), lambda x: len(x) >= 4), lambda x: lower(x))) AS b FROM documents)
SELECT doc_id, len(a) AS tokens, coalesce(array_to_string(list_sort(b)[1:8], ' '), '') AS title_key FROM t
"""

URLS = rf"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS netloc, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (SELECT page_id, netloc, regexp_replace(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':.*$', ''), '^www\.', '') AS host, CASE WHEN scheme = '' OR netloc = '' THEN '' ELSE regexp_replace(scheme || '://' || netloc || path, '/+$', '') END AS url_key FROM u)
SELECT page_id, host, netloc, url_key, regexp_matches(host, '(^|\.)({"|".join(d.replace(".", chr(92) + ".") for d in rules.OFFICIAL_DOMAINS)})$') AS official, page_id = min(page_id) OVER (PARTITION BY url_key) AS is_first FROM k
"""

DATES = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 5 = 3 THEN 28800 ELSE 0 END AS read_seconds, event_id % 5 AS form FROM events"

CAPS = r"""
WITH d AS (SELECT source AS platform, doc_id, CASE WHEN CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 3 <> 0 THEN 'live' ELSE 'cache' END AS origin FROM documents)
SELECT platform, doc_id, origin FROM d QUALIFY row_number() OVER (PARTITION BY platform ORDER BY doc_id) <= 20
"""

FOLD = f"""
WITH {VIEW}, t AS (SELECT event_id, title, row_number() OVER (PARTITION BY event_id ORDER BY length(title), title) AS n FROM (SELECT DISTINCT event_id, title FROM items))
SELECT i.event_id, array_to_string(list_sort(list_distinct(list(platform))), ',') AS platforms, (SELECT string_agg(t.title, '|' ORDER BY n) FROM t WHERE t.event_id = i.event_id AND n <= 5) AS titles,
  string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS member_count,
  strftime(min(moment) FILTER (WHERE dated), '%Y-%m-%dT%H:%M:%S+00:00') AS first_pubtime, strftime(max(moment) FILTER (WHERE dated), '%Y-%m-%dT%H:%M:%S+00:00') AS latest_pubtime
FROM items i GROUP BY i.event_id
"""

CLAIMS = """
WITH c AS (SELECT CAST(user_id % 7 AS VARCHAR) AS run_id, hour(ts) AS batch_index, user_id AS event_pos, event_id AS pos, event_id * event_id % 2003 AS item_index FROM events),
f AS (SELECT c.* FROM c WHERE item_index IN (SELECT doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY run_id, item_index ORDER BY batch_index, event_pos, pos) = 1),
n AS (SELECT run_id, batch_index, event_pos, row_number() OVER (PARTITION BY run_id ORDER BY batch_index, event_pos) AS number FROM (SELECT DISTINCT run_id, batch_index, event_pos FROM f))
SELECT f.run_id, CAST(f.item_index AS INT) AS item_index, CAST(f.batch_index AS INT) AS batch_index, f.event_pos, CAST(n.number AS INT) AS number FROM f JOIN n USING (run_id, batch_index, event_pos)
"""

OMITTED = "SELECT CAST(doc_id AS INT) AS item_index, source AS platform, 'clustered_title_omitted' AS stage FROM documents WHERE doc_id NOT IN (SELECT event_id * event_id % 2003 FROM events)"

RECALL = """
WITH v AS (SELECT m.vec_id, CASE WHEN m.vec_id % 17 <> 0 THEN e.ts END AS at, CAST(m.embedding AS DOUBLE[]) AS v FROM embeddings m LEFT JOIN events e ON e.event_id = m.vec_id),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS ev, list_cosine_similarity(q.v, e.v) AS s FROM v q JOIN v e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id WHERE q.at IS NULL OR e.at IS NULL OR abs(epoch_us(q.at) - epoch_us(e.at)) <= 72 * 3600000000),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ev) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, CAST(ev AS VARCHAR) AS event_id, round(s, 6) AS similarity FROM r WHERE rank <= 5
"""

UNDATED = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS ev, list_cosine_similarity(q.v, e.v) AS s FROM v q JOIN v e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ev) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, CAST(ev AS VARCHAR) AS event_id, round(s, 6) AS similarity FROM r WHERE rank <= 5
"""

DEDUPE = f"""
WITH {VIEW}, e AS (SELECT report_date, doc_id, length(text) AS n, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS main_entity FROM items),
f AS (SELECT *, row_number() OVER (PARTITION BY report_date, main_entity ORDER BY n DESC, doc_id) AS nth FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY n DESC, doc_id) AS position FROM f WHERE nth = 1 OR main_entity = '')
SELECT CAST(report_date AS VARCHAR) AS report_date, CAST(position AS INT) AS position, CAST(doc_id AS INT) AS item_index, main_entity FROM g WHERE position <= 10
"""

_TYPE = f"{_list(TYPES)}[CAST(floor(doc_id / 2) AS INT) % {len(TYPES)} + 1]"

TOPICS = f"""
WITH {VIEW}, e AS (SELECT report_date, doc_id, {_TYPE} AS raw FROM items WHERE doc_id % 2 = 0), k AS (SELECT *, {_case("raw", _NORMAL, "raw")} AS topic FROM e),
p AS (SELECT report_date, topic, count(*) AS n, min(doc_id) AS seen FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY n DESC, seen) AS rank FROM p)
SELECT CAST(report_date AS VARCHAR) AS report_date, CAST(rank AS INT) AS rank, topic, n FROM r WHERE rank <= 4
"""

CACHE = """
WITH w AS (SELECT doc_id, sha256('{"model": "m", "text": ' || CAST(to_json(split_part(text, chr(10), 1)) AS VARCHAR) || '}') AS cache_key FROM documents),
c AS (SELECT cache_key, max(doc_id) AS created_at FROM w WHERE doc_id % 2 = 0 GROUP BY cache_key)
SELECT w.doc_id, w.cache_key, coalesce(c.created_at, -1) AS created_at FROM w LEFT JOIN c USING (cache_key)
"""

_STATES = ["succeeded", "failed", "queued", "running", "blocked", "skipped", "waiting"]
TASKS = f"tasks AS (SELECT event_id AS id, CAST(event_id AS VARCHAR) AS task_id, CAST(user_id AS VARCHAR) AS run_id, event_type AS step_id, {_list(_STATES)}[(event_id * 13 + user_id) % 7 + 1] AS state, 'g' || (user_id % 10) AS task_group_id FROM events)"

GROUPS = f"""
WITH {TASKS}, s AS (SELECT task_group_id, state, count(*) AS n FROM tasks GROUP BY ALL)
SELECT task_group_id, CAST(sum(n) AS BIGINT) AS total, '{{' || string_agg('"' || state || '":' || n, ',' ORDER BY state) || '}}' AS by_state,
  CAST(coalesce(sum(n) FILTER (WHERE state IN ('queued', 'waiting', 'running')), 0) AS BIGINT) AS active, CAST(coalesce(sum(n) FILTER (WHERE state IN ('succeeded', 'failed', 'blocked', 'cancelled', 'skipped')), 0) AS BIGINT) AS terminal,
  CAST(coalesce(sum(n) FILTER (WHERE state = 'succeeded'), 0) AS BIGINT) AS succeeded, CAST(coalesce(sum(n) FILTER (WHERE state IN ('failed', 'cancelled')), 0) AS BIGINT) AS failed, CAST(coalesce(sum(n) FILTER (WHERE state = 'blocked'), 0) AS BIGINT) AS blocked
FROM s GROUP BY task_group_id
"""

RUNS = f"""
WITH {TASKS}
SELECT run_id, step_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'blocked') THEN 'blocked' WHEN bool_or(state = 'running') THEN 'running' WHEN bool_or(state IN ('queued', 'waiting')) THEN 'queued' WHEN bool_and(state = 'succeeded') THEN 'succeeded' ELSE 'partial' END AS status, count(*) AS tasks
FROM tasks GROUP BY run_id, step_id
"""

BLOCKS = f"""
WITH {TASKS}, d AS (SELECT id, task_id, 0 AS pos, CAST(id - id % 5 AS VARCHAR) AS dependency_id FROM tasks WHERE id % 5 <> 0 UNION ALL SELECT id, task_id, 1, CAST(id * 7 AS VARCHAR) FROM tasks WHERE id % 5 <> 0),
b AS (SELECT d.task_id, d.pos, d.dependency_id, coalesce(p.state, 'missing') AS dependency_state FROM d LEFT JOIN tasks p ON p.task_id = d.dependency_id)
SELECT task_id, 'dependency' AS kind, dependency_id, dependency_state FROM b WHERE dependency_state IN ('missing', 'failed', 'blocked', 'cancelled') QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY pos) = 1
"""

RELATIVES = f"""
WITH {TASKS}, d AS (SELECT dep, count(*) AS n FROM (SELECT CAST(id - id % 5 AS VARCHAR) AS dep FROM tasks WHERE id % 5 <> 0 UNION ALL SELECT CAST(id * 7 AS VARCHAR) FROM tasks WHERE id % 5 <> 0) GROUP BY dep),
c AS (SELECT CAST(id // 2 AS VARCHAR) AS parent, count(*) AS n FROM tasks WHERE id % 4 = 0 GROUP BY parent)
SELECT t.task_id, coalesce(d.n, 0) AS dependents, coalesce(c.n, 0) AS children, count(*) OVER (PARTITION BY t.task_group_id) AS group_members FROM tasks t LEFT JOIN d ON d.dep = t.task_id LEFT JOIN c ON c.parent = t.task_id
"""

ATTEMPTS = f"""
SELECT user_id AS task_id, event_id AS seq, {_list([*HISTORY, "other.a", "other.b"])}[event_id % 13 + 1] AS type, CAST(row_number() OVER w AS INT) AS nth, coalesce(CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT), -1) AS since
FROM events WHERE event_id % 13 < 11 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""

LOOKUP = "SELECT doc_id, source FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(source), 'license'))"

SOURCES = """
WITH o AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS nation FROM supplier),
m AS (SELECT coalesce(o.id, c.c_custkey) AS id, coalesce(o.name, c.c_name) AS name, coalesce(o.nation, c.c_nationkey) AS nation FROM o FULL JOIN customer c ON o.id = c.c_custkey)
SELECT id, name, nation FROM m WHERE id NOT IN (SELECT id FROM o WHERE id % 3 = 0) UNION ALL SELECT id, 'new ' || name, coalesce(nation, -1) FROM o WHERE id % 3 = 0
"""

STREAM = """
WITH c AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS type, count(*) AS entries FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, type, entries FROM c
"""


EXTRACTION = """
d AS (SELECT lang AS run_id, doc_id, substr(split_part(text, chr(10), 1), 1) AS title FROM documents),
e AS (SELECT a.run_id, a.doc_id, b.doc_id AS other, row_number() OVER (PARTITION BY a.run_id ORDER BY a.doc_id) AS number FROM d a LEFT JOIN d b ON b.run_id = a.run_id AND b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
i AS (SELECT run_id, doc_id, number FROM e UNION ALL SELECT run_id, other, number FROM e WHERE other IS NOT NULL)
"""

EXTRACTED = f"""
WITH {EXTRACTION} SELECT run_id, 'evt_20240101_' || lpad(CAST(number AS VARCHAR), CAST(greatest(4, length(CAST(number AS VARCHAR))) AS INT), '0') AS event_id, CAST(CASE WHEN other IS NULL THEN 1 ELSE 2 END AS BIGINT) AS member_count,
  CAST(doc_id AS VARCHAR) || coalesce(',' || other, '') AS ids, round((doc_id % 90 + 10) / 100.0, 6) AS confidence, 'model' AS event_type FROM e
"""

DISCARDS = f"""
WITH {EXTRACTION} SELECT d.run_id, CAST(d.doc_id AS INT) AS item_index, CASE WHEN d.doc_id % 7 = 0 THEN 'clustered_title_discard' ELSE 'clustered_title_omitted' END AS stage, CASE WHEN d.doc_id % 7 = 0 THEN 'off topic' ELSE 'LLM omitted item from clustered extraction response' END AS reason
FROM d LEFT JOIN i ON i.run_id = d.run_id AND i.doc_id = d.doc_id WHERE d.doc_id % 7 = 0 OR i.doc_id IS NULL
"""

DECISIONS = f"""
WITH {EXTRACTION} SELECT d.run_id, CAST(d.doc_id AS INT) AS item_index, CASE WHEN i.doc_id IS NULL THEN 'discard' ELSE 'assign' END AS classification_decision,
  coalesce('evt_20240101_' || lpad(CAST(number AS VARCHAR), CAST(greatest(4, length(CAST(number AS VARCHAR))) AS INT), '0'), '') AS event_id, CASE WHEN i.doc_id IS NULL THEN -1 ELSE 90 END AS relevance_score
FROM d LEFT JOIN i ON i.run_id = d.run_id AND i.doc_id = d.doc_id
"""

_CODES = "CASE {n} % 5 WHEN 1 THEN 'network_error' WHEN 2 THEN 'blocked' WHEN 4 THEN 'blocked' ELSE CASE WHEN {n} % 2 = 0 THEN 'contract_error' ELSE 'parse_error' END END"

FLAGS = f"""
WITH {TASKS} SELECT task_id, CASE WHEN id % 9 = 0 OR state = 'waiting' THEN 'scheduled' WHEN state = 'running' AND id % 3 + 1 > 1 THEN 'running' WHEN id % 4 > 0 OR state IN ('failed', 'cancelled', 'blocked') THEN 'attempted' ELSE 'idle' END AS retry,
  greatest(id % 3 + 1 - id % 4, 0) AS remaining, state = 'blocked' OR id % 5 <> 0 AS blocked, id % 2 = 0 AS safe_to_skip, {_CODES.format(n="id")} AS code, {_CODES.format(n="id")} = 'network_error' AS retryable FROM tasks
"""

SCRAPES = f"""
WITH a AS (SELECT user_id AS job_id, count(*) AS attempts, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY user_id), c AS (SELECT *, {_CODES.format(n="last")} AS code, last % 4 = 0 AS ok FROM a)
SELECT job_id, CAST(attempts AS INT) AS attempts, CASE WHEN ok THEN 'succeeded' WHEN code = 'network_error' AND attempts < 50 THEN 'retrying' WHEN code IN ('blocked', 'network_error') THEN 'skipped_unrepairable' ELSE 'repairing' END AS state, CASE WHEN ok THEN '' ELSE code END AS code FROM c
"""


def _kinds() -> dict[str, str]:
    return {p: kind for kind, (_, names) in rules.PLATFORM_KINDS.items() for p in names}


def _candidates() -> str:
    weights = {p: w for w, names in rules.PLATFORM_KINDS.values() for p in names}
    return f"""
{VIEW}, g AS (
  SELECT event_id, list_sort(list_distinct(list(platform))) AS names, list(title ORDER BY doc_id) FILTER (WHERE title <> '') AS titles, list(url IS NOT NULL) AS links, count(*) AS sources
  FROM (SELECT *, CASE WHEN doc_id % 3 < 2 THEN 'x' END AS url FROM items) GROUP BY event_id
), e AS (
  SELECT i.report_date, i.doc_id, i.event_id, i.title AS label, substr(regexp_replace(i.text, '[\\t-\\r ]+', ' ', 'g'), 1, 160) AS summary, {_TYPE.replace("doc_id", "i.doc_id")} AS raw,
    list_filter(regexp_split_to_array(regexp_replace(i.text, '[^A-Za-z ]+', ' ', 'g'), ' +'), lambda w: w <> '')[1:2] AS entities, CAST(i.doc_id % 6 + 1 AS INT) AS member_count, CASE WHEN i.doc_id % 4 = 0 THEN [i.platform] ELSE g.names END AS platforms,
    CASE WHEN i.dated THEN i.moment END AS latest, CASE WHEN i.doc_id % 8 = 2 THEN 0.95 ELSE least(1.0, (i.doc_id % 60 + 45) / 100.0) END AS confidence, i.doc_id % 8 <> 2 AND i.doc_id % 60 + 45 > 100 AS out_of_range, coalesce(g.titles[1:5], []) AS titles, list_contains(g.links, true) AS link, g.sources
  FROM items i JOIN g USING (event_id) WHERE i.doc_id % 2 = 0
), h AS (
  SELECT *, {_case("raw", _NORMAL, "raw")} AS kind, lower(concat_ws(' ', label, summary, raw, array_to_string(titles, ' '), array_to_string(entities, ' '))) AS hay, lower(concat_ws(' ', label, summary, array_to_string(titles, ' '), array_to_string(entities, ' '))) AS plain,
    list_transform(platforms, lambda p: {_case("p", _kinds(), "'unknown'")}) AS kinds, list_max(list_transform(platforms, lambda p: {_case("p", weights, rules.OTHER_PLATFORM)})) AS weight, len(platforms) AS n FROM e
)"""


def scored() -> str:
    """CTEs that end in ``z``: every candidate event with its scores, layer and status."""
    focus = {k: _any("hay", v) for k, v in rules.FOCUS_WORDS.items()}
    boost = lambda part: " + ".join(f"CASE WHEN {k} THEN {v[part]} ELSE 0 END" for k, v in rules.FOCUS_BOOSTS.items())
    plus = lambda c, p: f"CASE WHEN {c} THEN {p} ELSE 0 END"
    has = lambda k: f"list_contains(kinds, '{k}')"
    a, b = focus
    single = "least(weight, CASE " + " ".join(f"WHEN {has(k)} THEN {v}" for k, v in rules.SINGLE_CAPS.items()) + " ELSE 62.0 END)"
    age = "greatest(0, (epoch_us(CAST(report_date AS TIMESTAMP)) + 28800000000 - epoch_us(latest)) / 3.6e9)"
    paper_boost = {"importance": "5", "relevance": "6", "novelty": "5", "actionability": f"CASE WHEN {_any('hay', rules.PAPER_CODE_WORDS)} THEN 8 ELSE 3 END"}
    boosted = ", ".join(f"CASE WHEN paper THEN {_clamp(f'{k} + {v}')} ELSE {k} END AS {k}_score" for k, v in paper_boost.items())
    final = " + ".join(f"{k}_score * CAST({w} AS DOUBLE)" for k, w in rules.WEIGHTS.items())
    return f"""{_candidates()}, f AS (
  SELECT *, {", ".join(f"{v} AS {k}" for k, v in focus.items())}, coalesce(list_has_any(platforms, {_list(rules.PAPER_PLATFORMS)}), false) OR (kind IN {_in(rules.INSIGHT_TYPES)} AND {_any("hay", rules.PAPER_SIGNAL_WORDS)}) AS paper FROM h
), s AS (
  SELECT *, {_clamp(f'''{_case("kind", rules.IMPORTANCE, 45.0)} + CASE WHEN n >= 2 THEN least(8.0, 3.0 * n) ELSE 0 END + {plus(f"kind IN {_in(rules.HIGH_IMPACT_TYPES)} AND confidence >= 0.9", 5)} + {plus("member_count >= 4", 4)} + {boost("importance")} + {plus(f"{a} AND {b}", 3)} - {plus("confidence < 0.7", 10)}''')} AS importance,
    CASE WHEN n = 0 THEN 25.0 WHEN n <= 1 THEN {single} ELSE {_clamp(f"weight + least(12.0, (n - 1) * 4.0) + {plus(has('official'), 4)}")} END AS source_score,
    CASE WHEN latest IS NULL THEN 20.0 WHEN {age} <= 24 THEN 100.0 WHEN {age} <= 72 THEN 82.0 WHEN {age} <= 168 THEN 62.0 WHEN {age} <= 720 THEN 34.0 ELSE 12.0 END AS freshness_score,
    {_clamp(f"CASE WHEN {_any('hay', rules.AI_WORDS)} THEN 88 WHEN {a} OR {b} THEN 82 ELSE 52 END + {boost('relevance')}")} AS relevance,
    {_clamp(f"45 + {plus(f'kind IN {_in(rules.ACTIONABLE_TYPES)}', 22)} + {plus(_any('hay', rules.ACTIONABLE_WORDS), 18)} + {plus(f'kind IN {_in(rules.PRACTICAL_TYPES)}', 8)} + {boost('actionability')} + {plus('link', 5)}")} AS actionability,
    {_clamp(f"58 + {plus(f'kind IN {_in(rules.NOVEL_TYPES)}', 14)} + {plus(_any('hay', rules.NOVELTY_WORDS), 16)} + {boost('novelty')} - {plus(_any('hay', rules.FOLLOW_UP_WORDS), 14)} + {plus('member_count >= 5', 4)}")} AS novelty,
    least(40.0, {plus(f"n <= 1 AND NOT {has('official')}", 2)} + {plus(f"n <= 1 AND {has('community')}", 3)} + {plus("confidence < 0.7", 8)} + {plus("latest IS NULL", 6)}) AS risk_penalty,
    CASE WHEN kind = 'rumor' THEN 'noise' WHEN kind IN {_in(rules.NEWS_TYPES)} THEN 'news' WHEN kind IN {_in(rules.INSIGHT_TYPES)} OR {_any("(plain || ' ' || kind)", rules.INSIGHT_WORDS)} THEN 'insight'
      WHEN kind IN {_in(rules.ASSET_LAYER_TYPES)} OR {_any("(plain || ' ' || kind)", rules.ASSET_LAYER_WORDS)} THEN 'deep_asset' ELSE 'news' END AS content_layer,
    CASE WHEN latest IS NULL OR out_of_range THEN 'needs_review' WHEN {_any("plain", rules.RUMOR_WORDS)} THEN 'rumor' WHEN {has("community")} AND n = 1 THEN 'single_source' WHEN {has("official")} THEN 'verified' WHEN n >= 2 AND ({has("authority_media")} OR {has("chinese_media")}) THEN 'verified' ELSE 'single_source' END AS verify_status
  FROM f
), b AS (SELECT *, {boosted} FROM s), z AS (SELECT *, round({_clamp(f"{final} - risk_penalty")}, 2) AS final_score FROM b)"""


def _flagship() -> str:
    return f"""
WITH {scored()}, o AS (SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY final_score DESC, importance_score DESC, source_score DESC, doc_id) AS place FROM z)
SELECT CAST(report_date AS VARCHAR) AS report_date, CAST(place AS INT) AS place, event_id, kind AS normalized_event_type, content_layer, importance_score, source_score, freshness_score, relevance_score, actionability_score, novelty_score, risk_penalty, final_score,
  verify_status, 'ok' AS text_quality, array_to_string(platforms, ',') AS platforms, CAST(sources AS INT) AS sources, member_count, round(confidence, 6) AS confidence
FROM o WHERE place <= 10
"""


def _source_scores() -> str:
    return f"WITH {_candidates()} SELECT event_id, kind AS normalized_event_type, array_to_string(platforms, ',') AS platforms, weight, list_contains(kinds, 'official') AS official, false AS mismatch FROM h"


_NAMED = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _unescaped(t: str) -> str:
    for name, sign in _NAMED.items():
        t = f"replace({t}, {_q(name)}, {_q(sign)})"
    return t


READABLE = rf"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '<>', 'g'), '<[^>]*>'), lambda x: trim({_unescaped("x")}, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 2) AS parts FROM pages)
SELECT page_id, trim(regexp_replace({_unescaped("array_to_string(parts, ' ')")}, '{WS}+', ' ', 'g')) AS text FROM p
"""


MERGED = f"""
WITH {VIEW}, e AS (SELECT * FROM items WHERE doc_id % 2 = 0),
t AS (SELECT e.*, coalesce(r.doc_id, e.doc_id) AS root FROM e LEFT JOIN e r ON r.doc_id = e.doc_id - e.doc_id % 8 AND r.report_date = e.report_date)
SELECT CAST(report_date AS VARCHAR) AS run_id, 'evt_' || root AS event_id, CAST(count(*) AS INT) AS members, coalesce(array_to_string(list_sort(list_distinct(list(platform) FILTER (WHERE doc_id % 4 = 0))), ','), '') AS platforms,
  strftime(max(moment) FILTER (WHERE dated), '%Y-%m-%dT%H:%M:%SZ') AS latest_pubtime, CAST(round(max(CASE WHEN doc_id % 8 = 2 THEN 0.95 ELSE doc_id % 60 + 45 END), 6) AS DOUBLE) AS confidence
FROM t GROUP BY report_date, root
"""

PAGE_STATUS = f"""
SELECT page_id, CASE WHEN {_any("lower(coalesce(html, ''))", list(rules.PAGE_MARKERS))} THEN 'blocked' ELSE 'empty' END AS status, CAST(0 AS BIGINT) AS rows FROM pages
"""


def sql() -> dict[str, str]:
    """SQL by query name; the others are tested against small models instead."""
    return {
        "flagship": _flagship(), "text_rules": _text(), "token_rules": TOKENS, "url_rules": URLS, "date_forms": DATES, "source_caps": CAPS, "item_fold": FOLD, "first_claims": CLAIMS, "omitted_items": OMITTED, "similarity_recall": RECALL, "undated_recall": UNDATED, "entity_dedupe": DEDUPE, "topic_counts": TOPICS,
        "cache_lookup": CACHE, "group_summary": GROUPS, "run_states": RUNS, "dependency_blocks": BLOCKS, "task_relatives": RELATIVES, "attempt_history": ATTEMPTS, "keyword_lookup": LOOKUP, "merged_sources": SOURCES, "stream_counts": STREAM, "source_scores": _source_scores(),
        "extracted_events": EXTRACTED, "extraction_discards": DISCARDS, "item_decisions": DECISIONS, "task_flags": FLAGS, "scrape_outcomes": SCRAPES, "readable_pages": READABLE, "merge_fold": MERGED, "page_status": PAGE_STATUS,
    }
