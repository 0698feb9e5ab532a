"""URL filter with dated lists: an as-of join of captures and list entries.

A list entry says from which day on a value (a registered domain, a host or a
host with its first path segment) is blocked or allowed.  Entries of a value
become validity intervals, each ending where the next begins, so at any day at
most one interval of a value holds.  Every capture is compared, by value, with
the intervals that hold at its fetch day; the most specific kind decides.

Entries with a null value, day or action are void; of several entries of a
value on one day the last action in order counts (block after allow).  A
capture without URL or day matches nothing.  Repeated captures get equal
results.  Extra columns of captures are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From the least to the most specific; a later kind overrules an earlier one.
KINDS = ("domain", "host", "prefix")
SALTS = 16
#: Second-level labels under which two-letter countries register domains.
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")


def host(url: Column) -> Column:
    """Host in lower case, without user, port and ``www.``; empty if there is none."""
    net = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(net, r"^.*@|:[0-9]*$", ""), r"^www\.", "")


def values(url: Column) -> dict[str, Column]:
    """The list values that a URL falls under, by kind."""
    own = host(url)
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    return {"domain": F.regexp_extract(own, rf"([^.]+\.(?:(?:{'|'.join(SECOND)})\.[a-z]{{2}}|[^.]+))$", 1), "host": own, "prefix": F.concat(own, segment)}


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, action, valid_from, valid_to (null: open) from dated entries."""
    one = entries.where("kind is not null and value is not null and day is not null and action is not null")
    one = one.groupBy("kind", "value", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("kind", "value").orderBy("day")
    return one.select("kind", "value", "action", F.col("day").alias("valid_from"), F.lead("day").over(order).alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with kind, value, action, valid_from and valid_to of the deciding entry.

    ``key`` spreads the work; captures that share it are told apart by URL and
    day, and rows that are equal in all three get the same entry.  A host may
    have most captures: intervals are repeated for each salt and captures are
    dealt by it.  Columns of captures named as the result's five are replaced.
    """
    by_kind = values(F.col(f"`{url}`"))
    asked = captures.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("u"), F.col(f"`{day}`").alias("at"), F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), by_kind[kind].alias("value")) for i, kind in enumerate(KINDS)])).alias("x"))
    asked = asked.select("k", "u", "at", "x.*", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)).alias("salt")).where("value <> ''")
    held = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = asked.join(held, ["kind", "value", "salt"]).where("at >= valid_from and (valid_to is null or at < valid_to)")
    best = found.groupBy("k", "u", "at").agg(F.max(F.struct("rank", "kind", "value", "action", "valid_from", "valid_to")).alias("best"))
    columns, names = captures.columns, [f"c{i}" for i in range(len(captures.columns))]
    plain = captures.toDF(*names)
    own = {c: plain[names[columns.index(c)]] for c in (key, url, day)}
    joined = plain.join(best, own[key].eqNullSafe(best["k"]) & (own[url] == best["u"]) & (own[day] == best["at"]), "left")
    made = ("kind", "value", "action", "valid_from", "valid_to")
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True) if c not in made], *[F.col(f"best.{c}").alias(c) for c in made])


def demo_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the table has no fetch time, so the id fixes a day of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetch_day"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the values of the pages' own URLs, fixed by each value's MD5.

    A value's digest says whether and when it is listed, delisted and listed
    again, so the list grows with the table.
    """
    by_kind = values(F.col("url"))
    every = pages.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), by_kind[k].alias("value")) for k in KINDS])).alias("x")).select("x.*").where("value <> ''").distinct()
    code = [F.ascii(F.substring(F.md5(F.concat_ws("|", "kind", "value")), i, 1)) for i in range(1, 7)]
    first = (code[0] * 7 + code[1] * 13) % 200
    second = first + 20 + code[2] % 60
    third = second + 20 + code[3] % 60
    listed = every.where(code[4] % 3 < 2).withColumns({"d1": first, "d2": second, "d3": third, "again": code[5] % 2 == 0})
    dated = F.array(F.struct(F.col("d1").alias("d"), F.lit("block").alias("action")), F.struct(F.col("d2").alias("d"), F.lit("allow").alias("action")), F.struct(F.when(F.col("again"), F.col("d3")).alias("d"), F.lit("block").alias("action")))
    out = listed.select("kind", "value", F.explode(dated).alias("e")).where("e.d is not null")
    return out.select("kind", "value", F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.d").cast("int")).alias("day"), "e.action")
