"""Readers of landed feeds, pages and job files: SRC01-SRC17, SRC20, UD01, WN01, ST01, FL14-FL16."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, rules
from newsloom.functions import text as tx

ITEM = "platform string, title string, url string, pubtime string, scrape_date string, event_id string, event_label string, event_confidence double"
HOT_ROW = "title string, url string, mobile_url string, pubDate string, date string, time string, publishTime string, publishedAt string, timestamp string, extra struct<pubDate:string,date:string,time:string,publishTime:string,publishedAt:string,timestamp:string>"


def capped(df: DataFrame, by: list[str], order: Column, most: int) -> DataFrame:
    """WN01: the first ``most`` rows of each source in feed order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("nth") <= most).drop("nth")


def _owner(folder: str, name: str) -> Column:
    """The value of a partition folder in a file's path, else a part of its name."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, rf"/{folder}=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, name, 1))


def read_rss(spark: SparkSession, path: str, scrape_date: str, most: int = 20) -> DataFrame:
    """SRC01: landed RSS or Atom files; a ``feed=`` folder or else the file's name is the feed id."""
    rss = spark.read.format("xml").option("recursiveFileLookup", True).option("rowTag", "item").schema("title string, link string, pubDate string, updated string").load(path)
    atom = spark.read.format("xml").option("recursiveFileLookup", True).option("rowTag", "entry").schema("title string, link struct<_href:string>, published string, updated string").load(path)
    feed = _owner("feed", r"([^/]+?)(?:\.[^./]*)?$")
    rows = rss.select(feed.alias("platform"), F.monotonically_increasing_id().alias("pos"), "title", F.col("link").alias("url"), F.coalesce(F.nullif("pubDate", F.lit("")), "updated").alias("at"))
    more = atom.select(feed.alias("platform"), F.monotonically_increasing_id().alias("pos"), "title", F.col("link._href").alias("url"), F.coalesce(F.nullif("published", F.lit("")), "updated").alias("at"))
    first = capped(rows.unionByName(more), ["platform"], F.col("pos"), most)
    # feed readers take naive dates as UTC
    zoned = F.when(F.col("at").rlike(r"(?:Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2})$"), F.col("at")).otherwise(F.concat("at", F.when(F.col("at").rlike(r"^\d{4}-"), "Z").otherwise(" +0000")))
    return first.select("platform", tx.strip(tx.text_or_empty(F.col("title"))).alias("title"), tx.text_or_empty(F.col("url")).alias("url"), dates.iso_utc(dates.normal_date(zoned)).alias("pubtime"), F.lit(scrape_date).alias("scrape_date"))


def read_items(spark: SparkSession, path: str, scrape_date: str | None = None) -> DataFrame:
    """SRC02/SRC10/SRC16: ``[...]`` or ``{"items": [...]}`` files; ``scrape_date`` fills gaps."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    row = f"struct<{ITEM.replace(' ', ':', 1).replace(', ', ',')}>"
    row = "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ") for x in ITEM.split(", "))) + ">"
    items = F.coalesce(F.from_json("value", f"items array<{row}>")["items"], F.from_json("value", f"array<{row}>"))
    out = text.select("file", F.posexplode(items).alias("item_index", "r")).select("file", "item_index", "r.*")
    return out.withColumn("scrape_date", F.coalesce("scrape_date", F.lit(scrape_date)))


def contract(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FL16: (valid rows, rejects with the names of their missing fields)."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(tx.strip(F.col(c)), F.lit("")) == "", F.lit(c)) for c in ("platform", "title", "url", "scrape_date")]))
    marked = items.withColumn("missing", missing)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def read_hot_lists(spark: SparkSession, path: str, scrape_date: str, most: int = 50) -> DataFrame:
    """SRC03/DT02: aggregator files, ``{"items": [...]}`` or ``[...]``; a ``source=`` folder or the file's name is the source id."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(_owner("source", r"([^/]+?)\.json$").alias("platform"), "value")
    row = "struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in re.split(r",\s*(?![^<]*>)", HOT_ROW)) + ">"
    items = F.coalesce(F.from_json("value", f"items array<{row}>")["items"], F.from_json("value", f"array<{row}>"))
    rows = capped(text.select("platform", F.posexplode(items).alias("pos", "r")), ["platform"], F.col("pos"), most)
    at = dates.first_date(*[F.col(f"r.{f}") for f in dates.DATE_FIELDS], *[F.col(f"r.extra.{f}") for f in dates.DATE_FIELDS])
    return rows.select("platform", "pos", tx.strip(tx.text_or_empty(F.col("r.title"))).alias("title"), tx.text_or_empty(F.col("r.url")).alias("url"), dates.iso_utc(at).alias("pubtime"), F.lit(scrape_date).alias("scrape_date"))


def live_or_cached(live: DataFrame, cached: DataFrame, asked: DataFrame, source: str = "platform") -> tuple[DataFrame, DataFrame]:
    """SRC04: (live rows, and cached ones of sources without live rows; errors of such sources)."""
    have, held = live.select(source).distinct(), cached.select(source).distinct()
    rows = live.unionByName(cached.join(have, source, "left_anti"), allowMissingColumns=True)
    down = asked.select(source).join(have, source, "left_anti").join(held.withColumn("cached", F.lit(True)), source, "left")
    return rows, down.select(source, F.when(F.col("cached"), "live failed, used cache").otherwise("live failed").alias("error"))


class _Anchors(HTMLParser):
    """Links with the headings, times and all text inside them."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[dict] = []
        self.open: list[dict] = []
        self.tags: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in a:
            self.open = [{"href": a["href"].strip(), "title": {}, "time": "", "text": ""}]
            self.links.append(self.open[0])
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.tags.append((tag, a.get("class", "").lower()))

    def handle_endtag(self, tag):
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i][0] == tag:
                del self.tags[i:]
                break
        if tag == "a":
            self.open = []

    def handle_data(self, data):
        for link in self.open:
            link["text"] += data
            for tag, cls in self.tags:
                if tag in ("h1", "h2", "h3", "h4"):
                    link["title"][tag] = link["title"].get(tag, "") + data
                elif "title" in cls:
                    link["title"]["z"] = link["title"].get("z", "") + data
                if tag == "time":
                    link["time"] += data


def _listing(html: str, base: str) -> list[tuple[str, str, str]]:
    reader = _Anchors()
    reader.feed(html or "")
    out: dict[str, tuple[str, str, str]] = {}
    for link in reader.links:
        path = urlparse(link["href"]).path.rstrip("/")
        titles = [" ".join(link["title"][k].split()) for k in sorted(link["title"])]
        title, when = next((t for t in titles if t), ""), " ".join(link["time"].split())
        if path.startswith(("/news/", "/policy-")) and title and when:
            url = urljoin(base, link["href"])
            out.setdefault(url, (url, title, when))
    return list(out.values())


def _papers(html: str, base: str) -> list[tuple[str, str, str]] | None:
    m = re.search(r"""<div\b[^>]*data-target=["']DailyPapers["'][^>]*data-props=(["'])(.*?)\1""", html or "", re.I | re.S)
    if not m:
        return []
    try:
        entries = json.loads(unescape(m[2])).get("dailyPapers") or []
    except (ValueError, AttributeError):
        return None
    out: dict[str, tuple[str, str, str]] = {}
    for e in entries:
        paper = e.get("paper") if isinstance(e, dict) else None
        if isinstance(paper, dict) and str(paper.get("id") or "").strip():
            title = str(paper.get("title") or e.get("title") or "").strip()
            url = urljoin(base, f"/papers/{str(paper['id']).strip()}")
            if title:
                out.setdefault(url, (url, title, str(paper.get("publishedAt") or e.get("publishedAt") or "")))
    return list(out.values())


def _paper_links(html: str, base: str) -> list[tuple[str, str, str]]:
    out: dict[str, tuple[str, str, str]] = {}
    for m in re.finditer(r"""<a\b[^>]*href=["'](/papers/[^"']+)["'][^>]*>(.*?)</a>""", html or "", re.I | re.S):
        title = " ".join(unescape(re.sub(r"<[^>]+>", " ", m[2])).split())
        url = urljoin(base, m[1])
        if title:
            out.setdefault(url, (url, title, ""))
    return list(out.values())


def extract_pages(pages: DataFrame, most: int = 100) -> DataFrame:
    """SRC05-SRC08, SRC20, UD01: item rows and one status row for each page.

    ``pages``: page_id, url, html.  A page's rows are its article list, else
    its embedded papers, else its paper links; a page without rows is blocked,
    a parse error or empty.  ``pos`` is null in the status rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, url, raw in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                papers = _papers(raw, url or "")
                rows, how = _listing(raw, url or ""), "listing"
                if not rows and papers:
                    rows, how = papers, "structured"
                if not rows:
                    rows, how = _paper_links(raw, url or ""), "links"
                low = (raw or "").lower()
                status = how if rows else "blocked" if any(x in low for x in blocked) else "parse_error" if papers is None else "empty"
                out.append((page, None, None, None, None, status))
                out += [(page, i, *r, status) for i, r in enumerate(rows[:most])]
            yield pd.DataFrame(out, columns=["page_id", "pos", "url", "title", "published", "status"]).astype({"pos": "Int64"})

    blocked = list(rules.PAGE_MARKERS)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, pos long, url string, title string, published string, status string")


def source_rows(raw: DataFrame) -> DataFrame:
    """SRC09: source definitions with defaults."""
    text = lambda c: tx.strip(tx.text_or_empty(F.col(c)))
    return raw.select(text("id").alias("id"), F.coalesce(F.nullif(text("name"), F.lit("")), text("id")).alias("name"), text("url").alias("url"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce(F.nullif("content_type", F.lit("")), F.lit("news")).alias("content_type"))


def enabled_sources(sources: DataFrame, columns: list[str], include_all: bool = False, requested: DataFrame | None = None) -> DataFrame:
    """FL14: enabled sources without a redirect, of the allowed columns, that were asked for."""
    rows = sources.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("redirect", F.lit("")) == ""))
    rows = rows if include_all else rows.where(F.col("column").isin(columns))
    return rows if requested is None else rows.join(requested.select("id"), "id", "left_semi")


def merged_sources(seed: DataFrame, own: DataFrame, key: str = "id") -> DataFrame:
    """ST02/ST08: seed and own rows, own values first."""
    a, b = own.alias("a"), seed.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in own.columns])


def upsert_sources(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """ST06: new rows replace those of their key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def lookup_rows(rows: DataFrame, equal: dict[str, str] | None = None, keyword: str | None = None) -> DataFrame:
    """FL15: rows with the given field values whose JSON holds the keyword in any case."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    return rows if not keyword else rows.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(keyword.lower())))


def page_of(rows: DataFrame, order: list[Column], offset: int, most: int | None) -> DataFrame:
    """SO04: a page of the ordered rows."""
    out = rows.orderBy(*order).offset(max(0, offset))
    return out if most is None else out.limit(max(0, most))


def read_log(spark: SparkSession, path: str, schema: str, tail: int | None = None) -> DataFrame:
    """SRC13/SO07: JSON lines, malformed ones dropped; the last ``tail`` by time."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return rows if tail is None else rows.orderBy(F.desc("ts")).limit(tail)


def read_checkpoints(spark: SparkSession, path: str, schema: str, names: str = "checkpoint.json") -> DataFrame:
    """SRC14: every checkpoint file below a folder, oldest first."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path, multiLine=True)
    return rows.withColumn("path", F.col("_metadata.file_path")).orderBy("finished_at", "started_at", "path")


def resumed(snapshot: DataFrame, items: DataFrame) -> DataFrame:
    """SRC17: the snapshot's rows of runs that stopped at a stage that can resume, else the plain items."""
    live = snapshot.where(F.col("stage").isin("started", "after_clustered_event_extraction"))
    return live.unionByName(items.join(live.select("run_id").distinct(), "run_id", "left_anti"), allowMissingColumns=True)


def combined(parts: list[DataFrame]) -> DataFrame:
    """SRC12/ST01: all ingest steps' items, nothing dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
