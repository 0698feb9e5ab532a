"""Main text of HTML pages with a site style tree.

The DOMs of a host's pages are merged whole by path (tag and class names from
the body down, at any depth, menus and articles alike).  Each path is a node of
the site's tree with the pages on which it holds text, its presentations
(sequences of child tags) and its contents, which are its runs of text: each is
a feature of its own, so a list that differs in an entry from page to page is
still template.  With m pages, a run found on k of them has importance
1 - log k / log m; a node's importance is ``GAMMA`` times the mean over its
runs, each as often as pages show it, plus ``1 - GAMMA`` times the entropy of
its presentations.  What recurs from page to page and never varies in look is
template.  An inner node has no importance but its nodes': it leaves when all
that stand below it leave.

Few pages say little, so importance is shrunk towards a prior as if ``PRIOR_PAGES``
more pages had shown it: 0.5 for plain branches, 0.1 below names that are
ambiguous (``review``, ``banner``, ``widget`` and the like).  Nodes with
shrunk importance below ``THRESHOLD`` leave, at every size of host by the same
formula; a host of one page keeps them.  Branches that say they are what is
never main text (nav, footer, aside, form, advert, notice, comments; a header
outside the article) have no importance whatever their content, because lists
of links, adverts and comments differ from page to page as articles do.

* If all of an article or main element is of low importance, all of it stays:
  pages of one host may share an article.
* Articles or mains are taken for the whole of the content if they hold half
  of the text that is left at least; beside a shorter one (a teaser) all
  branches stand on their importance.
* Blocks are content nodes of their own: a block repeated on most of the pages
  that have its node (shrunk importance below ``BLOCK_THRESHOLD``) leaves,
  unless that would take over half of the page's text, for then these pages
  are copies of one another.
* If nothing would be left, all branches that may be main text stay.

Text rules: the blocks of the kept branches in page order; character
references decoded; white space inside a block one blank; trimmed; joined by
one newline; empty blocks dropped.  Null html is empty; a null or hostless URL
belongs to a site of its own kind (empty host).  Very long pages and unclosed
or stray tags are read to the end.  Ties do not arise: a branch at the
threshold stays.  Repeated rows count as pages each and get equal results.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch
from newsloom.llm.url_lists import host

THRESHOLD, BLOCK_THRESHOLD, GAMMA = 0.25, 0.1, 0.9
#: Importance before any page is seen, for plain and for ambiguous names, and the pages that it counts for.
PLAIN, AMBIGUOUS, PRIOR_PAGES = 0.5, 0.1, 4
#: Pages of a host handled together, on average, where its nodes are joined.
RUN_PAGES = 500
#: Nodes of low importance held in a broadcast at most (16 bytes each and their host); beyond it they are joined.
BROADCAST_NODES = 50_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[A-Za-z][^>]*(?:>|$)|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes svg".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption xmp".split())
_NOISE_TAG = frozenset("nav footer aside form script style noscript template iframe svg button select input textarea dialog menu head title object embed canvas audio video".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: A class or id says noise if one of its names is such a word, or one with a word for a part of a page before or after it.
_NOISE_WORD = r"ads?|advert(?:s|isements?|ising|orial)?|adsense|sponsor(?:s|ed)?|promos?|promotions?|promoted|nav|navbar|navigation|menus?|menubar|breadcrumbs?|masthead|footer|sidebar|aside|notices?|cookies?|consent|gdpr|newsletter|subscribe|comments?|commentlist|disqus|replies|respond|(?:user|reader|customer)-?reviews|related|recommend(?:ed|ations?|s)?|share|sharing|social|pagination|pager"
_PART = r"bars?|box(?:es)?|list|items?|links?|wrap|wrapper|container|inner|outer|area|block|section|widget|main|top|bottom|left|right|primary|secondary|slot|unit|banner|text|content|panel|rows?|cols?|column|header|head|title|form|count|buttons?|icons?|posts?|articles?|stories|story|news|reading|thread|body|media|group|nav|menu|footer|sidebar|ads?|policy|popup|modal|overlay|signup|\d+"
_NOISE_NAME = re.compile(rf"(?:^|[\s_-])(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?:{_NOISE_WORD})(?:[_-]?(?:{_PART}))*(?:$|\s)|(?:^|\s)(?:(?:site|page|top|main|global)[_-]?)?header(?:$|\s)", re.I)
#: Names that text may still stand under where a page has no other.
_SOFT_NAME = re.compile(r"(?:^|[\s_-])(?:promo\w*|notices?|related|recommend\w*|share|sharing|social|subscribe|newsletter)(?:$|[\s_-]|\d)", re.I)
#: Articles that are none: a class of theirs says so as a whole.
_NO_ARTICLE = re.compile(r"(?:^|\s)(?:comments?|ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*)(?:$|\s)", re.I)
_UNSURE_NAME = re.compile(r"(?:^|[\s_-])(?:header|banner|side|widget|alert|popup|modal|overlay|signup|login|reviews?|toolbar|copyright|disclaimer|skip)(?:$|[\s_-]|\d)", re.I)
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES |= {b: ("p",) for b in _BLOCK - {"li", "p", "dt", "dd", "tr", "td", "th", "html", "body"}}


class Block:
    """A run of text without a block boundary, with the element that it stands in."""

    __slots__ = ("content", "element", "main", "noise", "text")

    def __init__(self, text: str, element: int, noise: int, main: bool):
        self.text, self.element, self.noise, self.main = text, element, noise, main
        self.content = xxhash.xxh3_64_intdigest(text.lower()) - 2**63


class _Ends:
    """Where branches end, from one search of the page for each tag."""

    def __init__(self, html: str):
        self.html = html
        self.found: dict[str, tuple[list[int], list[int]]] = {}

    def past(self, tag: str, at: int) -> int | None:
        """Where the branch opened at ``at`` ends, if it plainly does."""
        if tag not in self.found:
            close, opens = _edges(tag)
            self.found[tag] = [m.start() for m in close.finditer(self.html)], [m.start() for m in opens.finditer(self.html)]
        closes, opens = self.found[tag]
        i = bisect.bisect_left(closes, at)
        if i == len(closes) or bisect.bisect_left(opens, at) < bisect.bisect_left(opens, closes[i]):
            return None
        end = self.html.find(">", closes[i])
        return end + 1 if end >= 0 else len(self.html)

    def raw(self, tag: str, at: int) -> int | None:
        """Where raw text that begins at ``at`` ends; None if it never does."""
        key = "\0" + tag
        if key not in self.found:
            self.found[key] = [m.start() for m in re.finditer(rf"</{re.escape(tag)}[\s/>]", self.html, re.I)], []
        closes = self.found[key][0]
        i = bisect.bisect_left(closes, at)
        if i == len(closes):
            return None
        end = self.html.find(">", closes[i])
        return end + 1 if end >= 0 else len(self.html)


@cache
def _edges(tag: str) -> tuple[re.Pattern, re.Pattern]:
    """An end tag, and a start tag that keeps a branch from being passed over."""
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I), re.compile(rf"<(?:{re.escape(tag)}|article|main)(?=[\s/>])", re.I)


#: How an element is noise: by its tag, role or state, or by its name alone, or by a name that text may still stand under.
BY_TAG, BY_NAME, SOFT = 1, 2, 3


def read_page(html: str, whole: bool = False) -> tuple[list[Block], list[tuple[int, bool]], list[tuple[int, int, bool]]]:
    """The blocks of a page in order; of each element how it looks and whether its name is ambiguous; and its path, parent's number and whether it is in main text.

    Branches that say they are no main text are passed over where their end
    is plain, unless the ``whole`` page is asked for.

    A small forgiving reader: unclosed paragraphs, list items and cells end
    where HTML ends them; an end tag closes up to its own start tag, or
    nothing if there is none.  Time and memory grow with the page, however
    deep its elements stand.
    """
    # an open element: tag, number, noise, in main, hash of its child tags, ambiguous name
    root = ["", -1, 0, False, 7, False]
    stack = [root]
    open_tags: dict[str, int] = {}
    elements: list[tuple[int, int, bool]] = []
    blocks: list[Block] = []
    nodes: list[tuple[int, bool]] = []
    held: list[str] = []
    ends_of = _Ends(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, top[1], top[2], top[3]))

    def close(at: int) -> None:
        if any(e[0] in _BLOCK for e in stack[at:]):
            flush()
        while len(stack) > at:
            e = stack.pop()
            open_tags[e[0]] -= 1
            nodes[e[1]] = e[4], e[5]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        token = m[0]
        at = m.end()
        if token[0] != "<" or len(token) == 1:
            if not (stack[-1][2] and not stack[-1][3] and not token.strip()):
                held.append(token)
            continue
        if token[1] in "!?":
            continue
        named = _NAME.match(token)
        tag = named[1].lower()
        if token[1] == "/":
            if open_tags.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in _RAW:
            if not token.endswith("/>"):
                past = ends_of.raw(tag, at)
                at = end if past is None else past
            continue
        if tag in _BLOCK:
            flush()
        ends = _CLOSES.get(tag, ())
        if any(open_tags.get(e) for e in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "body", "blockquote", "td", "th", "main"):
                    break
        if tag == "br":
            held.append(" ")
            continue
        above = stack[-1]
        names, role, hidden = "", "", False
        if " " in token or "\n" in token or "\t" in token:
            for a, v in _ATTRIBUTE.findall(token[len(named[0]) :]):
                a, v = a.lower(), v.strip("\"'")
                if a in ("class", "id"):
                    names += " " + v
                elif a == "role":
                    role = v.lower()
                elif a == "hidden" or (a == "aria-hidden" and v.lower() == "true") or (a == "style" and re.search(r"display\s*:\s*none", v, re.I)):
                    hidden = True
        path = xxhash.xxh3_64_intdigest(f"{elements[above[1]][0] if above[1] >= 0 else 0}>{tag}{' '.join(sorted(names.split()))}") - 2**63
        above[4] = (above[4] * 1000003 + hash_of(tag)) & 0x7FFFFFFFFFFFFFFF
        if tag in _VOID:
            continue
        body = tag in ("html", "body")
        own = tag in ("article", "main")
        main = above[3] or own or role in ("main", "article")
        named_noise = bool(names) and not own and not (above[3] and "header" in names.lower()) and bool(_NOISE_NAME.search(names))
        by_name = (SOFT if _SOFT_NAME.search(names) else BY_NAME) if named_noise else 0
        by_tag = BY_TAG if hidden or tag in _NOISE_TAG or (tag == "header" and not above[3]) or role in _NOISE_ROLE else 0
        noise = 0 if body else above[2] if above[2] in (BY_TAG, BY_NAME) else by_tag or (by_name if by_name == BY_NAME else above[2] or by_name)
        if own and not above[3]:
            noise = (above[2] or (BY_NAME if names and _NO_ARTICLE.search(names) else 0)) if tag == "article" else 0
        if noise and not whole and (past := ends_of.past(tag, at)) is not None:
            at = past
            continue
        elements.append((path, above[1], main))
        unsure = not own and not body and (above[5] or (bool(names) and bool(_UNSURE_NAME.search(names))))
        nodes.append((7, unsure))
        stack.append([tag, len(elements) - 1, noise, main, 7, unsure])
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if token.endswith("/>") and tag not in _BLOCK:
            stack.pop()
            open_tags[tag] -= 1
    flush()
    close(1)
    return blocks, nodes, elements


def hash_of(tag: str) -> int:
    return xxhash.xxh3_64_intdigest(tag) >> 2


#: What a row of features counts pages of.
HAS, LOOK, BLOCK = range(3)


def features(pages: DataFrame) -> DataFrame:
    """host (hash), path, kind, feature, pages, unsure: pages of the host by node with text, presentation and run of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, int, bool], int] = {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) if held else [[], [], [], [], []]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
            out = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(list(held.values()), pa.int64())], ["host", "path", "kind", "feature", "unsure", "pages"])
            held.clear()
            return out

        for batch in batches:
            for own, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, nodes, elements = read_page(html or "")
                seen = set()
                for b in blocks:
                    if b.element >= 0 and not b.noise:
                        path, (look, unsure) = elements[b.element][0], nodes[b.element]
                        seen.add((own, path, HAS, 0, unsure))
                        seen.add((own, path, LOOK, look, False))
                        seen.add((own, path, BLOCK, b.content, False))
                for x in seen:
                    held[x] = held.get(x, 0) + 1
                if len(held) > 200_000:
                    yield flush()
        yield flush()

    rows = pages.select("host", "html").mapInArrow(run, "host long, path long, kind int, feature long, unsure boolean, pages long")
    return rows.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("pages"), F.bool_or("unsure").alias("unsure"))


def _shrunk(importance: Column, pages: Column, unsure: Column) -> Column:
    prior = F.when(unsure, AMBIGUOUS).otherwise(PLAIN)
    return (prior * PRIOR_PAGES + importance * pages) / (pages + PRIOR_PAGES)


def importance(found: DataFrame) -> DataFrame:
    """host, path, block (null: the node itself), importance in 0..1 and its shrunk value, from the merged counts.

    A node's figures are sums over its rows, so they combine before the
    shuffle whatever the node's size.  Blocks on so few pages that no number of
    pages of their path could put them below ``BLOCK_THRESHOLD`` are left out.
    """
    kind, n = F.col("kind"), F.col("pages").cast("double")
    of_kind = lambda k, x: F.sum(F.when(kind == k, x).otherwise(0.0))
    nodes = found.groupBy("host", "path").agg(
        F.max(F.when(kind == HAS, F.col("pages"))).alias("m"), F.bool_or(F.when(kind == HAS, F.col("unsure"))).alias("named"),
        of_kind(BLOCK, n).alias("runs"), of_kind(BLOCK, n * F.log(n)).alias("run_logs"), of_kind(LOOK, n).alias("looks"), of_kind(LOOK, n * F.log(n)).alias("look_logs"),
    )
    m = F.col("m").cast("double")
    base = F.log(F.greatest(m, F.lit(2.0)))
    content = 1 - F.col("run_logs") / (F.col("runs") * base)
    look = F.least((F.col("looks") * F.log(m) - F.col("look_logs")) / (m * base), F.lit(1.0))
    of_node = nodes.select("host", "path", F.lit(None).cast("long").alias("block"), "m", "named", (GAMMA * content + (1 - GAMMA) * look).alias("importance"))
    least = PLAIN * PRIOR_PAGES / BLOCK_THRESHOLD - PRIOR_PAGES
    blocks = found.where((kind == BLOCK) & (F.col("pages") > least)).join(nodes.select("host", "path", "m"), ["host", "path"])
    of_block = blocks.select("host", "path", F.col("feature").alias("block"), "m", F.lit(False).alias("named"), (1 - F.log(n) / base).alias("importance"))
    return of_node.unionByName(of_block).select("host", "path", "block", "importance", _shrunk(F.col("importance"), F.col("m"), F.col("named")).alias("shrunk"))


def main_text(html: str | None, low: set[int] | frozenset[int], blocks_low: set[tuple[int, int]] | frozenset[tuple[int, int]] = frozenset()) -> str:
    """The kept blocks of a page; ``low`` and ``blocks_low``: its site's paths, and its blocks by path, of low importance."""
    blocks, _, elements = read_page(html or "")
    size = lambda found: sum(len(b.text) for b in found)
    # the outermost main element of each, or -1
    outer: list[int] = []
    for i, (_, parent, main) in enumerate(elements):
        outer.append((outer[parent] if parent >= 0 and outer[parent] >= 0 else i) if main else -1)
    fine = [path not in low for path, _, _ in elements]
    told = {outer[b.element] for b in blocks if b.main and not b.noise and fine[b.element]}

    def stays(b: Block) -> bool:
        return b.element < 0 or fine[b.element] or (b.main and outer[b.element] not in told)

    able = [b for b in blocks if not b.noise]
    if not able:  # text under a soft name is better than none
        again, _, _ = read_page(html or "", whole=True)
        return "\n".join(b.text for b in again if b.noise == SOFT)
    left = [b for b in able if stays(b)] or able
    fresh = [b for b in left if (elements[b.element][0] if b.element >= 0 else 0, b.content) not in blocks_low]
    main = [b for b in left if b.main]
    if main and 2 * size(main) >= size([b for b in fresh if not b.main]) + size(main):
        left, fresh = main, [b for b in fresh if b.main]
    if 2 * size(fresh) >= size(left):
        left = fresh
    return "\n".join(b.text for b in left)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url and text of every page."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "style-tree")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(F.coalesce(host(F.col("url")), F.lit(""))).alias("host"), "html")
    least = F.when(F.col("block").isNull(), threshold).otherwise(BLOCK_THRESHOLD)
    found = scratch.save(features(pages), "features")
    known = scratch.save(importance(found).where(F.col("shrunk") < least).select("host", "path", "block"), "low")
    scratch.drop(found)
    schema = "page_id long, url string, text string"

    def sets(rows) -> tuple[set[int], set[tuple[int, int]]]:
        return {p for p, b in rows if b is None}, {(p, b) for p, b in rows if b is not None}

    def run(batches: Iterator[pa.RecordBatch], held: dict[int, tuple[set, set]]) -> Iterator[pa.RecordBatch]:
        none: tuple[set, set] = (set(), set())
        for batch in batches:
            hosts, htmls = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            low = [held.get(h, none) for h in hosts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h, *x) for h, x in zip(htmls, low, strict=True)], pa.string())], ["page_id", "url", "text"])

    if known.count() <= BROADCAST_NODES:
        rows: dict[int, list] = {}
        for r in known.collect():
            rows.setdefault(r["host"], []).append((r["path"], r["block"]))
        shared = spark.sparkContext.broadcast({h: sets(x) for h, x in rows.items()})
        return pages.mapInArrow(lambda batches: run(batches, shared.value), schema)
    # a host may have most pages: they are dealt out in runs, and its nodes go once to each of them
    runs = pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / RUN_PAGES).alias("runs"))
    nodes = known.join(runs, "host").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))).select("host", "run", "path", "block")
    dealt = pages.join(runs.where("runs > 1"), "host", "left").withColumn("run", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("runs", F.lit(1)))).drop("runs")

    def one_run(key: tuple[pa.Scalar, ...], own: pa.Table, low: pa.Table) -> pa.Table:
        found = sets(list(zip(low.column("path").to_pylist(), low.column("block").to_pylist(), strict=True)))
        return pa.table([own.column("page_id"), own.column("url"), pa.array([main_text(h, *found) for h in own.column("html").to_pylist()], pa.string())], ["page_id", "url", "text"])

    return dealt.groupBy("host", "run").cogroup(nodes.groupBy("host", "run")).applyInArrow(one_run, schema)
