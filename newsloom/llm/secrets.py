"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression the driver derives a Boolean query: an OR
of conjunctions of trigrams (in lower case) that every match must contain.
One pass over each text posts, for the trigrams that any query names, the
documents that hold them; the postings of each conjunction are intersected by
counting, and only the documents left run the rule's expression.  A rule
without mandatory trigrams (a bare character class) runs over every text.
The candidates (ids and rules) go to the texts, which stay where they are, as
long as they are few by count; beyond that both sides are shuffled.

Spans are in code points, end exclusive.  Matches are leftmost and do not
overlap within a kind; those that fail the rule's length test are dropped
after matching.  Null texts are empty and hold nothing.  Rows without a
doc_id cannot be posted and run all rules.  Repeated rows get equal results;
rows that share a doc_id share candidates, which only costs time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, group that is measured and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Added by the method.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

_MOST_STRINGS = 64
#: Values that one running result is appended over, and characters of a piece that spans are cut from.
RUN, PIECE = 512, 4096
#: Candidate documents that are broadcast at most (an id and a few rule numbers each).
BROADCAST_CANDIDATES = 500_000


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The OR of trigram conjunctions that a match of ``pattern`` implies.

    Every branch of the expression gives one conjunction; an empty list means
    that some branch has no mandatory trigram.
    """
    parser = re._parser  # the standard library's own reading of the expression

    def walk(items) -> list[tuple[str | None, ...]]:
        """Each way through, as literal characters and None for anything else."""
        ways: list[tuple[str | None, ...]] = [()]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                step = [(chr(arg).lower(),)]
            elif name == "SUBPATTERN":
                step = walk(arg[3])
            elif name == "BRANCH":
                step = [w for branch in arg[1] for w in walk(branch)]
            elif name == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
                step = [(c,) for c in sorted({chr(a).lower() for _, a in arg})]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                once = walk(inner)
                if (low, high) == (0, 1):
                    step = [(), *once]
                elif low >= 1 and len(once) == 1 and None not in once[0]:
                    step = [once[0] * min(low, 3) + ((None,) if high != low or low > 3 else ())]
                else:
                    step = [(None,)]
            else:
                step = [(None,)]
            # beyond the limit a part counts as anything, and what stands before it is kept
            ways = [a + b for a, b in product(ways, step if len(ways) * len(step) <= _MOST_STRINGS else [(None,)])]
        return ways

    found = []
    for way in walk(parser.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in way).split("\0")
        found.append(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if not all(found):
        return []
    return [x for x in dict.fromkeys(found) if not any(y < x for y in found)]


def _any_of(strings: list[str]) -> str:
    """A look-ahead for strings of equal length, branching by first character."""
    heads = sorted({t[0] for t in strings})
    return "(?=(" + "|".join(re.escape(h) + "(?:" + "|".join(re.escape(t[1:]) for t in strings if t[0] == h) + ")" for h in heads) + "))"


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): indexes of the rules whose query the document satisfies."""
    queries = [(i, c, sorted(conj)) for i, r in enumerate(rules) for c, conj in enumerate(trigram_query(r.pattern))]
    trigrams = sorted({t for *_, conj in queries for t in conj})
    posted = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(trigrams)), F.lit(1)))
    postings = docs.where("doc_id is not null").select("doc_id", F.explode(posted).alias("trigram"))
    uses = [x for t in trigrams for x in (F.lit(t), F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(c).alias("conj"), F.lit(len(conj)).alias("need")) for i, c, conj in queries if t in conj]))]
    named = postings.select("doc_id", "trigram", F.explode(F.element_at(F.create_map(*uses), F.col("trigram"))).alias("q"))
    # rows that share an id share their postings, each trigram once
    held = named.groupBy("doc_id", "q.rule", "q.conj", "q.need").agg(F.size(F.collect_set("trigram")).alias("hits")).where("hits >= need")
    return held.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, add) -> Column:
    """Running results of an array of whole numbers: ``add`` of each to what came before, from 0.

    Appending to an array copies it, so it is done within runs of ``RUN``
    values and for the runs' last results, not for the array as a whole.
    """

    def appended(array: Column) -> Column:
        return F.aggregate(array, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def joined(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / RUN).cast("int") - 1, F.lit(0))), lambda i: appended(F.slice(xs, i * RUN + 1, RUN)))
        return _bound(runs, lambda rs: _bound(appended(F.transform(rs, lambda r: F.element_at(r, -1))), lambda before: F.flatten(F.zip_with(rs, F.slice(before, 1, F.size(rs)), lambda r, b: F.transform(F.slice(r, 2, F.size(r)), lambda x: add(b, x))))))

    return _bound(F.transform(values, lambda x: x.cast("long")), joined)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches that pass its length test, in time linear in the matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    parts = F.struct(whole.alias("w"), value.alias("v"), gaps.alias("g"))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["g"], 1, F.size(x["w"])), x["w"], lambda g, w: F.length(g) + F.length(w))
        ends = F.zip_with(running(sizes, lambda a, b: a + b), F.zip_with(x["w"], x["v"], lambda w, v: F.struct(F.length(w).alias("w"), F.length(v).alias("v"))), lambda end, m: F.struct((end - m["w"]).cast("int").alias("start"), end.cast("int").alias("end"), m["v"].alias("v")))
        return F.transform(F.filter(ends, lambda m: m["v"] >= rule.least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    return _bound(parts, placed)


def _named(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """The rows with numbered columns (their names are the second result) and their sorted spans as ``spans``."""
    scanned_fully = [not trigram_query(r.pattern) for r in rules]
    scratch = Scratch(docs.sparkSession, "secrets")
    wanted = scratch.save(candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules).toDF("posted_id", "posted_rules"), "candidates")
    if wanted.count() <= BROADCAST_CANDIDATES:
        wanted = F.broadcast(wanted)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = names[docs.columns.index("doc_id")], F.coalesce(names[docs.columns.index("text")], F.lit(""))
    joined = plain.join(wanted, plain[key] == wanted["posted_id"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        may = F.lit(True) if scanned_fully[i] else F.col(key).isNull() | F.array_contains("posted_rules", F.lit(i))
        own = F.when(may & text.rlike(r.pattern), spans(text, r)).otherwise(none)
        parts.append(F.transform(own, _named(i, r.kind)))
    return joined.select(*names, F.array_sort(F.concat(*parts)).alias("spans")), names


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with ``found``: an array of (start, kind order, end, kind), sorted.

    A column of ``docs`` of that name is replaced, all others stay, whatever
    their names.
    """
    found, names = _scanned(docs, rules)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != "found"], F.col("spans").alias("found"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, found: Column, mask: str) -> Column:
    """The text with the spans' union replaced, a mask for each stretch of it.

    A span starts a stretch if it begins where all earlier ones have ended.
    What lies between is cut out of pieces of ``PIECE`` characters, so no cut
    walks through the whole text.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(ps: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        tail = lambda i, at: F.substring(F.get(ps, i), at - i * PIECE + 1, F.lit(PIECE))
        head = lambda i, to: F.substring(F.coalesce(F.get(ps, i), F.lit("")), F.lit(1), to - i * PIECE)
        far = F.concat(tail(first, a), F.array_join(F.slice(ps, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), head(last, b))
        return F.when(b <= a, F.lit("")).when(first == last, F.substring(F.get(ps, first), a - first * PIECE + 1, b - a)).otherwise(far)

    def built(x: Column) -> Column:
        reached = F.concat(F.array(F.lit(0).cast("long")), running(F.transform(x["s"], lambda s: s["end"]), F.greatest))  # where all spans so far have ended
        each = F.zip_with(x["s"], F.slice(reached, 1, F.size(x["s"])), lambda s, at: F.struct(s["start"].alias("start"), at.cast("int").alias("at")))
        starts = F.filter(each, lambda s: s["start"] >= s["at"])
        end = F.array_max(F.transform(x["s"], lambda s: s["end"]))
        out = F.transform(starts, lambda s: F.concat(between(x["p"], s["at"], s["start"]), F.lit(mask)))
        return F.concat(F.array_join(out, ""), between(x["p"], end, F.length(x["t"])))

    return _bound(F.struct(pieces.alias("p"), found.alias("s"), text.alias("t")), built)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; ``n_chars`` follows.

    All other columns stay, whatever their names; repeated rows stay repeated.
    """
    found, names = _scanned(docs, rules)
    text = F.col(names[docs.columns.index("text")])
    done = F.when(F.size("spans") > 0, _masked(text, F.col("spans"), mask)).otherwise(text)
    out = found.withColumn(names[docs.columns.index("text")], done).select(*names).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def counted(found: Column, kinds: tuple[Rule, ...]) -> list[Column]:
    """The number of spans of each kind."""
    return [F.size(F.filter(found, _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in kinds]


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def base_only(found: Column) -> Column:
    """The spans of the base kinds."""
    return F.filter(found, lambda s: reduce(lambda a, b: a | b, [s["kind"] == r.kind for r in BASE]))
