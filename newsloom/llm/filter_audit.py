"""Filter interaction audit: what each of five text filters removes, alone and among the others.

A coalition is a set of filters, written as a bit mask; its worth is the
number of documents that fail any of its filters.  Documents shrink to counts
by part and mask of failed filters, so 32 numbers a part hold all there is to
know.  A filter's share is the Shapley value of its removals, found as the
solution of the kernel-weighted least squares fit to all 32 worths under the
constraint that the shares add up to the worth of all filters.  The normal
equations are solved in rationals once; the solution is linear in the worths,
and 120 times it has whole coefficients, which Spark applies to every part.
The counts of a step in an order are differences of two coalitions' worths.

Defined cases: a null text is empty and fails A only (no word can repeat, no
character is upper case); equal texts fail E by doc_id alone, rows of one
doc_id never fail E against each other, and a row without doc_id neither
fails E nor makes others fail it.  A null source is the part with the empty
string, together with sources that are empty strings.  Repeated rows count as
often as they occur.  A label row is found by doc_id; if there are several,
quality or toxic holds when any of them says 1.  An empty table gives no
rows.  Further columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SPACE = r"[\x20\x09-\x0D]+"


def kernel_shares() -> list[list[int]]:
    """For each filter, the whole coefficients that turn the 32 worths into its share times 120.

    Minimises the sum over proper coalitions S of weight(|S|) * (worth(S) -
    sum of shares in S)^2 subject to the sum of all shares = worth(ALL).
    With a Lagrange multiplier this is one linear system; its right side is
    linear in the worths, so each worth's unit vector is solved for.
    """
    n = len(FILTERS)
    choose = [1]
    for k in range(n):
        choose.append(choose[-1] * (n - k) // (k + 1))
    weight = {s: Fraction(n - 1, choose[k] * k * (n - k)) for s in range(1, ALL) for k in [s.bit_count()]}
    left = [[sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction()) for j in range(n)] + [Fraction(1)] for i in range(n)] + [[Fraction(1)] * n + [Fraction()]]
    right = [[weight.get(s, Fraction()) * (s >> i & 1) for s in range(ALL + 1)] for i in range(n)] + [[Fraction(s == ALL) for s in range(ALL + 1)]]
    rows = [a + b for a, b in zip(left, right, strict=True)]
    for i in range(n + 1):  # Gauss-Jordan
        at = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    orders = len(list(permutations(FILTERS)))
    out = [[x * orders for x in rows[i][n + 1 :]] for i in range(n)]
    if any(x.denominator != 1 for row in out for x in row):
        raise ArithmeticError("shares over all orders are whole")
    return [[int(x) for x in row] for row in out]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(ws: Column) -> Column:
        fails = [F.size(ws) < 200, 100 * F.size(F.array_distinct(ws)) < 50 * F.size(ws), 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(words), bits)[0]  # words are bound once


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of failed filters, and the documents, good and toxic ones of each.

    Texts travel as digests.  The smallest id of each text is an aggregate
    (copies are combined before the shuffle); it is joined back by text and
    id together, a key that only repeated rows share, and those are counted
    first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), text_failures(text).alias("fails"))
    rows = rows.groupBy("id", "part", "same", "fails").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    first = rows.where("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeats = F.col("id").isNotNull() & F.col("first").isNull()
    found = rows.join(marks, "id", "left").join(first, ["same", "id"], "left")
    mask = F.col("fails") + F.when(repeats, 1 << 4).otherwise(0)
    n = F.col("n")
    return found.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("bad", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step in it."""
    counts = failure_counts(docs, labels)
    cells = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 of them
    nothing = F.lit(0).cast("long")
    hit = lambda s, c: lambda sum_, x: sum_ + F.when(x["mask"].bitwiseAND(s) != 0, x[c]).otherwise(0)
    worth = lambda c: F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.aggregate("cells", nothing, hit(s, c)))
    parts = cells.select("part", "total", worth("n").alias("worth"), worth("good").alias("good"), worth("toxic").alias("toxic"))
    shares = [F.aggregate(F.zip_with("worth", F.lit(row), lambda x, y: x * y), nothing, lambda sum_, x: sum_ + x) for row in kernel_shares()]
    parts = parts.withColumn("shares", F.array(*shares))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            steps.append(f"{''.join(order)} {step} {i} {before} {before | 1 << i}")
            before |= 1 << i
    # 600 fixed rows as one short text, taken apart by Spark
    at = parts.select("*", F.explode(F.split(F.lit(",".join(steps)), ",")).alias("x")).withColumn("x", F.split("x", " ")).select("*", *[F.col("x")[k].cast("int").alias(c) for k, c in ((1, "step"), (2, "i"), (3, "before"), (4, "after"))])
    alone = F.pow(F.lit(2), F.col("i")).cast("int")
    won = lambda c: F.col(c)[F.col("after")] - F.col(c)[F.col("before")]
    return at.select(
        "part", F.col("x")[0].alias("filter_order"), "step", (F.col("total") - F.col("worth")[F.col("after")]).alias("kept"), won("worth").alias("removed"), (F.col("worth")[alone] - won("worth")).alias("redundant"),
        (F.col("worth")[ALL] - F.col("worth")[F.lit(ALL) - alone]).alias("unique_fails"), won("good").alias("good_lost"), won("toxic").alias("toxic_lost"), F.col("shares")[F.col("i")].alias("shapley"),
    )
