"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every 20th id."""
    from newsloom.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e AS ask, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, ask ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from newsloom.llm.style_tree import extract

    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of every page, by way of ARC files."""
    from newsloom.llm.warc import archive

    return archive(_table(spark, sf_dir, "pages")).withColumnRenamed("row_id", "page_id")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(generate_series(1, 40), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', hex[i])]), '') AS bits FROM p
), d AS (
  SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    CAST(1 + list_sum(list_transform(generate_series(1, 5), lambda j: CASE WHEN bits[5 * i + j] = '1' THEN 2 ** (5 - j) ELSE 0 END)) AS BIGINT)]), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM b
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


def op5_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list entry that decides on every capture at its fetch day."""
    from newsloom.llm import url_lists

    pages = _table(spark, sf_dir, "pages")
    return url_lists.filter_captures(url_lists.demo_captures(pages), url_lists.demo_entries(pages))


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetch_day,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g'), '^www\.', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1) AS segment
  FROM pages
), a AS (
  SELECT page_id, fetch_day, 0 AS rank, 'domain' AS kind, regexp_extract(host, '([^.]+\.(?:(?:ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}|[^.]+))$', 1) AS value FROM u
  UNION ALL SELECT page_id, fetch_day, 1, 'host', host FROM u
  UNION ALL SELECT page_id, fetch_day, 2, 'prefix', host || segment FROM u
), k AS (
  SELECT DISTINCT kind, value, md5(kind || '|' || value) AS h FROM a WHERE value <> ''
), d AS (
  SELECT kind, value, (ascii(h[1]) * 7 + ascii(h[2]) * 13) % 200 AS d1, 20 + ascii(h[3]) % 60 AS g2, 20 + ascii(h[4]) % 60 AS g3, ascii(h[6]) % 2 = 0 AS again
  FROM k WHERE ascii(h[5]) % 3 < 2
), e AS (
  SELECT kind, value, DATE '2024-01-01' + CAST(d1 AS INTEGER) AS day, 'block' AS action FROM d
  UNION ALL SELECT kind, value, DATE '2024-01-01' + CAST(d1 + g2 AS INTEGER), 'allow' FROM d
  UNION ALL SELECT kind, value, DATE '2024-01-01' + CAST(d1 + g2 + g3 AS INTEGER), 'block' FROM d WHERE again
), i AS (
  SELECT kind, value, action, day AS valid_from, lead(day) OVER (PARTITION BY kind, value ORDER BY day) AS valid_to FROM e
), m AS (
  SELECT a.page_id, a.rank, i.*, row_number() OVER (PARTITION BY a.page_id ORDER BY a.rank DESC) AS n
  FROM a JOIN i USING (kind, value) WHERE a.fetch_day >= i.valid_from AND (i.valid_to IS NULL OR a.fetch_day < i.valid_to)
)
SELECT u.page_id, u.url, u.fetch_day, m.kind, m.value, m.action, m.valid_from, m.valid_to
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.n = 1
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    from newsloom.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    out = decode(ids, path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and log-bilinear score of every document."""
    from newsloom.llm.lbl import score

    return score(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    from newsloom.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    from newsloom.llm.line_rules import line_rules

    return line_rules(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d WHERE len(ws) > 7)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g) WHERE n > 1
  ) GROUP BY doc_id
), l AS (
  SELECT doc_id, source, t, key, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM (
    SELECT doc_id, source, t, md5(concat_ws(':', doc_id, md5(t))) AS key, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS lw
    FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
), w AS (
  SELECT source, key, norm, any_value(n) AS n, count(*) AS times FROM l GROUP BY source, key, norm
), f AS (
  SELECT source, norm, count(*) AS docs FROM w GROUP BY source, norm HAVING count(*) > 100
), a AS (
  SELECT w.source, w.key, w.norm, w.n * w.times AS words, f.docs FROM w JOIN f ON f.source IS NOT DISTINCT FROM w.source AND f.norm = w.norm
), z AS (
  SELECT source, key, sum(n * times) AS n FROM w GROUP BY source, key
), y AS (
  SELECT a.source, a.key FROM a JOIN z ON z.source IS NOT DISTINCT FROM a.source AND z.key = a.key GROUP BY a.source, a.key, z.n HAVING sum(a.words) * 100 > z.n * 75
), o AS (
  SELECT a.source, a.norm FROM a JOIN y ON y.source IS NOT DISTINCT FROM a.source AND y.key = a.key GROUP BY a.source, a.norm, a.docs HAVING count(*) * 100 >= a.docs * 90
), s AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id
), x AS (
  SELECT l.doc_id, sum(l.n) AS lost_words FROM l JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source IS NOT DISTINCT FROM l.source AND o.norm = l.norm) GROUP BY l.doc_id
), b AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(s.n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(x.lost_words, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words * 100 <= n_words * 75 AS kept, lost_words
FROM b
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    from newsloom.llm import secrets

    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    every, base = F.col("found"), secrets.base_only(F.col("found"))
    return found.select("doc_id", *secrets.counted(every, secrets.BASE), F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"), secrets.written(every).alias("spans"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and link component of every document."""
    from newsloom.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """Each rule's matches with their places, from the texts between them."""
    from newsloom.llm import secrets

    parts = []
    for rank, r in enumerate(secrets.BASE + secrets.MORE):
        p = "'" + r.pattern.replace("'", "''") + "'"
        found = f"SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {r.group}) AS vs, regexp_split_to_array(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})"
        place = "CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT)"
        parts.append(f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {place} AS a, {place} + length(ms[i]) AS b FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM ({found})) WHERE length(vs[i]) >= {r.least}")
    n = lambda k: f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}), s AS (
  SELECT doc_id, {", ".join(n(r.kind) for r in secrets.BASE)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE rank < {len(secrets.BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), k AS (
  SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * o >= 80 * (u.n + v.n - o)
), e AS (
  SELECT x, y FROM k UNION ALL SELECT y, x FROM k
), c AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, e.y FROM c JOIN e ON e.x = c.r
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    from newsloom.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, generate_series(1, 3) AS s(k)) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10
), s AS (
  SELECT lang, c.phrase, a, cut, l.f AS l, r.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c) c JOIN g l USING (lang) JOIN g r USING (lang)
  WHERE l.phrase = array_to_string(ws[1:cut], ' ') AND r.phrase = array_to_string(ws[cut + 1:], ' ')
), w AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s
), x AS (
  SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL
), o AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank FROM w LEFT JOIN x ON x.lang = w.lang AND x.phrase = w.phrase WHERE i = 1 AND 100 * coalesce(longest, 0) < 50 * a
)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five filters for every source, order and step."""
    from newsloom.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), f AS (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, strpos('ABCDE', filter_order[step]) AS i, list_transform(list_filter(string_split(left(filter_order, step - 1), ''), lambda y: y <> ''), lambda y: strpos('ABCDE', y)) AS earlier FROM o, generate_series(1, 5) AS g(step)
), r AS (
  SELECT part, filter_order, step, i, sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND own THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND own THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN own AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND own THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND own THEN bad ELSE 0 END) AS toxic_lost
  FROM (SELECT *, fails[i] AS own, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone FROM c, s) GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from newsloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_bpe": op2_bpe,
        "op3_style_tree": op3_style_tree,
        "op4_arc_to_warc": op4_arc_to_warc,
        "op5_temporal_lists": op5_temporal_lists,
        "op6_log_bilinear": op6_log_bilinear,
        "op7_mixing": op7_mixing,
        "op8_line_rules": op8_line_rules,
        "op9_secret_scan": op9_secret_scan,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_phrases": op11_phrases,
        "op12_filter_audit": op12_filter_audit,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": OP1_SQL,
        "op4_arc_to_warc": OP4_SQL,
        "op5_temporal_lists": OP5_SQL,
        "op8_line_rules": OP8_SQL,
        "op9_secret_scan": _op9_sql(),
        "op10_ngram_jaccard_join": OP10_SQL,
        "op11_phrases": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
    }
