"""N-gram Jaccard join by prefix tree.

Every document is the set of its distinct k-word shingles (64-bit hashes).
Sets are put in one global order, rarest shingles first, so that two sets of
Jaccard similarity t share an element among their first ``n - ceil(t*n) + 1``.
Those prefixes are the upper branches of the tree and are dealt out by token;
lengths, positions and bucket counts bound what lies below a branch, and the
sets that remain meet in blocks, where a trie over the ordered elements is
traversed once for all of a block's sets.

Steps, all over the whole corpus:

1. Count all shingles in a sketch of fixed size.  It only fixes the order, so
   its collisions cost time and never results.
2. Make the sets; equal sets become one class (copies never meet in pairs).
3. Deal prefix tokens out.  Tokens that the sketch calls frequent are dealt
   with a salt, so no group outgrows a task.
4. First round: compare each member of a group with one leader, which joins
   the bulk of a group of near copies in linear work.
5. Second round: of groups that still hold several components, compare all
   pairs of members from different components, in cells of bounded size.
   Pairs inside a component cannot change a component and are left out, and of
   a group of many cells the largest component is not crossed with itself.
6. Components by repeated minimum labels with pointer jumping.

Rounds 1 and 2 together see every link between different components, so the
components are exact up to 64-bit hash collisions.

Nulls: null or wordless texts have the empty set, link with nothing and are
their own component.  Rows with a null ``doc_id`` are kept; they make no links
of their own, and their component_id is that of a document with the same set,
else null.  Repeated rows are copies.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch, added_up
from newsloom.llm.words import mix, slices, text_shingles

SKETCH_BITS = 20
#: Rows of one token group or side of a cell, and sets of one block, at most on average.
GROUP_ROWS, BLOCK_SETS = 2000, 128
#: Distinct pairs that a task holds before it passes them on (16 bytes each, twice that until they are made distinct).
PAIRS_HELD = 500_000
#: Largest Bloom filter for the documents whose sets a round needs, in bits.
BLOOM_BITS = 1 << 26
_ROUND = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 1 << 12, dtype=np.uint64)


def _strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


# ---------------------------------------------------------------- the order


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.int64)
    yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all shingles in 2**SKETCH_BITS buckets, summed in a tree of tasks.

    Only the fixed-size sum reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            held, size = [], 0
            for s in text_shingles(_strings(batch.column(0)), k):
                held.append(s)
                size += len(s)
                if size > 1 << 19:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                    held, size = [], 0
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    found = added_up(docs.select("text").mapInArrow(count, "counts binary"), _sum_counts, "counts binary").collect()
    return np.frombuffer(zlib.decompress(bytes(found[0][0])), np.int64) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def order_levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: a level (0 for rare, then half-octaves) and the count over the noise."""
    noise = float(np.median(counts))
    over = np.maximum(counts - noise, 0)
    hot = counts > noise + 6 * np.sqrt(noise) + 20
    level = np.where(hot, 1 + np.floor(2 * np.log2(np.maximum(over, 1))), 0).astype(np.uint8)
    return level, np.where(hot, over, 0).astype(np.int64)


# ---------------------------------------------------------------- the sets


def set_id(s: np.ndarray) -> int:
    """A 64-bit id of a set: equal sets, and only they, share it but for collisions."""
    parts = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)), len(s)], np.uint64)
    parts = mix(parts)
    return int(mix(parts[:1] + parts[1:2] * np.uint64(3) + parts[2:] * np.uint64(5)).view(np.int64)[0])


def _buckets(n: int) -> int:
    """Buckets of the count sketch of a set of n: about four elements each."""
    return 1 << max(3, int(max(n, 1) - 1).bit_length() - 2)


def count_sketch(s: np.ndarray) -> bytes:
    """How many elements fall in each bucket, one byte each.

    Buckets are the top bits, so a finer sketch folds into a coarser one.
    Where a bucket passes 255 the sketch is empty, which bounds nothing.
    """
    m = _buckets(len(s))
    got = np.bincount((s >> np.uint64(65 - m.bit_length())).astype(np.int64), minlength=m)
    return b"" if len(got) and got.max() > 255 else got.astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """An upper bound for the common elements of sets of n and m elements."""
    if not a or not b:
        return min(n, m)
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def _need(n: int, m: int, num: int, den: int) -> int:
    """Common elements that two sets need: ceil(t/(1+t) * (n+m))."""
    return -(-num * (n + m) // (num + den))


SET_SCHEMA = "doc_id long, sid long, n_shingles long, heat double, prefix binary, sketch binary"


def document_sets(docs: DataFrame, k: int, num: int, den: int, level) -> DataFrame:
    """Per document: set id, size, prefix in the global order and count sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = level.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                sid, size, heat, prefix, sketch = [], [], [], [], []
                for s in text_shingles(_strings(batch.column(1).slice(first, 512)), k):
                    s = np.unique(s)
                    n = len(s)
                    size.append(n)
                    if not n:
                        sid.append(None)
                        heat.append(0.0)
                        prefix.append(b"")
                        sketch.append(b"")
                        continue
                    own = lv[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    o = s[np.argsort(own, kind="stable")] if own.any() else s
                    sid.append(set_id(s))
                    heat.append(float(own.mean()))
                    prefix.append(o[: n - -(-num * n // den) + 1].tobytes())
                    sketch.append(count_sketch(s))
                yield pa.record_batch(
                    [batch.column(0).slice(first, 512), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(heat, pa.float64()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())],
                    ["doc_id", "sid", "n_shingles", "heat", "prefix", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, SET_SCHEMA)


def prefix_rows(sets: DataFrame, counts) -> DataFrame:
    """One narrow row for each prefix token of each class.

    ``deal`` holds the token's salts (upper half) and this row's salt, ``at``
    the set's size (upper half) and the token's position, ``heat`` how common
    the set's elements are.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = counts.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                tokens = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                if not tokens:
                    continue
                each = np.array([len(x) for x in tokens])
                token = np.concatenate(tokens)
                sid = np.repeat(part.column(0).to_numpy(), each)
                salts = np.maximum(1, -(-over[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // GROUP_ROWS)).astype(np.int64)
                salt = (mix(token ^ mix(sid.view(np.uint64))) % salts.view(np.uint64)).astype(np.int64)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each)
                columns = [token.view(np.int64), salts << 32 | salt, sid, np.repeat(part.column(1).to_numpy(), each) << 32 | pos, np.repeat((part.column(2).to_numpy() * 256).astype(np.int16), each)]
                yield pa.record_batch([pa.array(x) for x in columns], ["token", "deal", "sid", "at", "heat"])

    return sets.select("sid", "n_shingles", "heat", "prefix").mapInArrow(expand, "token long, deal long, sid long, at long, heat short")


def _close(n, m, num: int, den: int):
    """Sizes that allow the similarity."""
    return (F.least(n, m) * den) >= (F.greatest(n, m) * num)


def _reachable(n, i, m, j, num: int, den: int):
    """Enough elements remain if positions i and j hold the first common one."""
    return (F.least(n - i, m - j) * (num + den)) >= ((n + m) * num)


# ---------------------------------------------------------------- comparing


def trie_links(sizes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's sets, by one trie traversal.

    Elements held by the same sets of the block become one weighted atom; a
    set is its atoms in the common order.  The trie shares the overlaps of a
    path among all sets below it; a branch ends where the overlap so far and
    the longest remainder below it cannot reach what any set needs.
    """
    k = len(sets)
    size = np.array(sizes, np.int64)
    cat = np.concatenate(sets)
    owner = np.repeat(np.arange(k), size)
    by = np.argsort(cat, kind="stable")
    cat, owner = cat[by], owner[by]
    first = np.flatnonzero(np.r_[True, cat[1:] != cat[:-1]])
    held = np.diff(np.r_[first, len(cat)])
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) * _ROUND[0])
    sign, at, weight = np.unique(np.add.reduceat(salt[owner], first), return_index=True, return_counts=True)
    rank = np.lexsort((at, held[at]))
    at, weight = at[rank], weight[rank]
    atoms = len(at)
    has = np.zeros((atoms, k), bool)
    rows = np.repeat(np.arange(atoms), held[at])
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(held[at]) - held[at], held[at])
    has[rows, owner[np.repeat(first[at], held[at]) + inner]] = True
    paths = [np.flatnonzero(has[:, i]) for i in range(k)]

    parent = list(range(k))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links: list[tuple[int, int]] = []
    need = -(-num * (size[:, None] + size[None, :]) // (num + den))

    def ends(i: int, overlap: np.ndarray) -> None:
        for j in np.flatnonzero(overlap >= need[i]):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, int(j)))

    # members of a branch, the depth reached, the overlaps of the path and its weight
    stack = [(list(range(k)), 0, np.zeros(k, np.int64), 0)]
    while stack:
        members, depth, overlap, spent = stack.pop()
        if len(members) == 1:
            i = members[0]
            ends(i, overlap + weight[paths[i][depth:]] @ has[paths[i][depth:]] if depth < len(paths[i]) else overlap)
            continue
        left = size[members].max() - spent
        if not ((overlap + left) >= need[members].min(axis=0)).any():
            continue
        branches: dict[int, list[int]] = {}
        for i in members:
            if depth == len(paths[i]):
                ends(i, overlap)
            else:
                branches.setdefault(int(paths[i][depth]), []).append(i)
        for atom, below in branches.items():
            stack.append((below, depth + 1, overlap + weight[atom] * has[atom], spent + int(weight[atom])))
    return links


def compared(scratch: Scratch, docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, num: int, den: int, name: str) -> DataFrame:
    """The links (a, b) among candidate pairs (hub, other), enough to span them."""
    spark = docs.sparkSession
    sketches = sets.select("sid", "n_shingles", "sketch")
    joined = pairs.join(sketches.toDF("hub", "n", "x"), "hub").join(sketches.toDF("other", "m", "y"), "other").select("hub", "other", "n", "m", "x", "y")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, other, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(n)) if overlap_bound(x[i], y[i], n[i], m[i]) >= _need(n[i], m[i], num, den)]
            yield batch.select(["hub", "other"]).take(pa.array(keep, pa.int64()))

    left = scratch.save(joined.mapInArrow(bounded, "hub long, other long"), f"{name}-pairs")
    sizes = left.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("parts"))
    dealt = left.join(sizes, "hub").select("hub", "other", F.pmod(F.xxhash64("hub", "other"), "parts").alias("part"))
    rows = scratch.save(dealt.select("hub", "part", F.col("other").alias("sid")).unionByName(dealt.select("hub", "part", F.col("hub").alias("sid")).distinct()), f"{name}-blocks")

    # the sets are made again from the texts, for the documents that stand for a needed class
    needed = rows.select("sid").distinct().join(sets.select("sid", "rep"), "sid").select("sid", "rep")
    needed = scratch.save(needed, f"{name}-needed")
    bits = BLOOM_BITS
    count = needed.count()
    while bits > 1 << 16 and bits >= 64 * count:
        bits >>= 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            h = mix(ids.view(np.uint64) ^ _ROUND[1]) % np.uint64(bits)
            np.bitwise_or.at(on, (h >> np.uint64(3)).astype(np.int64), np.left_shift(1, (h & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.record_batch([pa.array([zlib.compress(on.tobytes(), 1)], pa.binary())], ["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                on |= np.frombuffer(zlib.decompress(raw), np.uint8)
        yield pa.record_batch([pa.array([zlib.compress(on.tobytes(), 1)], pa.binary())], ["bits"])

    found = added_up(needed.select("rep").mapInArrow(mark, "bits binary"), merge, "bits binary").collect()
    bloom = spark.sparkContext.broadcast(np.frombuffer(zlib.decompress(bytes(found[0][0])), np.uint8) if found else np.zeros(bits // 8, np.uint8))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = bloom.value
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            h = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _ROUND[1]) % np.uint64(bits)
            hit = ((on[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) | ~known
            part = batch.filter(pa.array(hit))
            for first in range(0, part.num_rows, 256):
                made = [x for x in map(np.unique, text_shingles(_strings(part.column(1).slice(first, 256)), k)) if len(x)]
                yield pa.record_batch([pa.array([set_id(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], ["sid", "elements"])

    full = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(contents, "sid long, elements binary")
    blocks = rows.join(full, "sid").select("hub", "part", "sid", "elements")

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("sid").to_pylist()
        got: dict[int, np.ndarray] = {}
        for i, raw in zip(ids, table.column("elements").to_pylist(), strict=True):
            got.setdefault(i, np.frombuffer(raw, np.uint64))
        ids = sorted(got)
        found = trie_links([len(got[i]) for i in ids], [got[i] for i in ids], num, den)
        return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

    out = scratch.save(blocks.groupBy("hub", "part").applyInArrow(links, "a long, b long"), f"{name}-links")
    scratch.drop(left, rows, needed)
    return out


# ---------------------------------------------------------------- components


def components(scratch: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(sid, comp): the smallest set id reachable, for sets that have a link.

    Minimum labels with pointer jumping; each round is written out, and the
    rounds end when no label changes.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "sid"), name)
    while True:
        near = both.join(labels.toDF("b", "comp"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "sid").select("sid", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.toDF("comp", "far")
        new = scratch.save(step.join(jump, "comp", "left").select("sid", "was", F.coalesce(F.least("comp", "far"), "comp").alias("comp")), name)
        changed = new.where("comp < was").limit(1).count()
        scratch.drop(labels)
        labels = new.select("sid", "comp")
        if not changed:
            scratch.drop(both)
            return labels


# ---------------------------------------------------------------- the join


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when ``den * |intersection| >= num * |union|``; a component
    is named by its smallest doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    level, over = order_levels(shingle_counts(docs, k))
    levels, counts = spark.sparkContext.broadcast(level), spark.sparkContext.broadcast(over)

    every = scratch.save(document_sets(docs, k, num, den, levels), "documents")
    own = scratch.save(every.select("doc_id", "sid", "n_shingles"), "own")
    rep = own.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    # one row of each class: its smallest document's; repeated rows are equal, so any will do
    classes = every.where("sid is not null").join(rep, "sid").where("doc_id = rep").dropDuplicates(["sid"])
    sets = scratch.save(classes.select("sid", "rep", "n_shingles", "sketch"), "classes")

    group = Window.partitionBy("token", "deal")
    whole = group.orderBy(F.desc("heat"), "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = prefix_rows(classes, counts).withColumns({"lead": F.first("sid").over(whole), "lead_at": F.first("at").over(whole), "many": F.count(F.lit(1)).over(whole)})
    half = lambda c, high: (F.shiftright(c, 32) if high else F.col(c).bitwiseAND(0xFFFFFFFF)).cast("int")
    shared = rows.where((F.col("many") > 1) | (half("deal", True) > 1))
    shared = scratch.save(shared.select("token", "sid", half("at", True).alias("n"), half("at", False).alias("pos"), "lead", half("lead_at", True).alias("lead_n"), half("lead_at", False).alias("lead_pos")), "shared")
    scratch.drop(every)

    n, m = F.col("n"), F.col("lead_n")
    star = shared.where(F.col("lead") != F.col("sid")).where(_close(n, m, num, den)).where(_reachable(n, F.col("pos"), m, F.col("lead_pos"), num, den))
    star = star.select(F.col("lead").alias("hub"), F.col("sid").alias("other")).distinct()
    first = compared(scratch, docs, sets, star, k, num, den, "first")
    comps = components(scratch, first, "first-components")

    named = shared.select("token", "sid", "n", "pos").join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = scratch.save(named, "named")
    mixed = named.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("rows")).where("least < most").select("token", "rows")
    mixed = scratch.save(mixed, "mixed")
    # of a group of many cells the largest component is not crossed with itself: its rows meet the others' only
    hot = named.join(mixed.where(F.col("rows") > GROUP_ROWS).select("token"), "token").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    hot = hot.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("of_top"))
    sized = mixed.join(hot, "token", "left").withColumn("of_top", F.coalesce("of_top", F.lit(0)))
    sized = sized.select("token", "top", F.ceil((F.col("rows") - F.col("of_top")) / GROUP_ROWS).cast("int").alias("cells"), F.ceil(F.col("of_top") / GROUP_ROWS).cast("int").alias("top_cells"))
    inside = F.coalesce(F.col("comp") == F.col("top"), F.lit(False))
    deal = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    open_rows = named.join(sized, "token").withColumn("side", F.when(inside, F.col("cells") + deal("top_cells")).otherwise(deal("cells")))
    last = F.when(inside, F.col("cells")).otherwise(F.col("cells") + F.col("top_cells")) - 1
    cells = open_rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    cells = cells.select("token", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "sid", "n", "pos", "comp")

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a cell from different components, its rows sorted by size; passed on as arrays of bounded length."""
        held: list[np.ndarray] = []
        size = 0

        def once() -> np.ndarray:
            """The pairs held, each once: a pair meets under every token that its sets share."""
            nonlocal size
            pair = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            pair = pair[:, np.lexsort(pair)]
            pair = pair[:, np.r_[True, (np.diff(pair, axis=1) != 0).any(axis=0)][: pair.shape[1]]]
            held[:] = [pair]
            size = pair.shape[1]
            return pair

        def flush() -> pa.RecordBatch:
            nonlocal size
            pair = once()
            held.clear()
            size = 0
            return pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], ["hub", "other"])

        def pairs(cell: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            n, pos, comp, sid, side = (cell[x] for x in ("n", "pos", "comp", "sid", "side"))
            split = cell["i"][0] != cell["j"][0]
            top = np.searchsorted(n * num, n * den, "right")
            for r in range(len(n)):
                c = slice(r + 1, max(r + 1, top[r]))
                ok = (comp[c] != comp[r]) & (np.minimum(n[r] - pos[r], n[c] - pos[c]) * (num + den) >= (n[r] + n[c]) * num)
                if split:
                    ok &= side[c] != side[r]
                o = sid[c][ok]
                if len(o):
                    held.append(np.stack([np.minimum(o, sid[r]), np.maximum(o, sid[r])]))
                    size += len(o)
                    if size > 2 * PAIRS_HELD and once().shape[1] > PAIRS_HELD:
                        yield flush()

        rest: pa.Table | None = None
        names = ["token", "i", "j", "side", "sid", "n", "pos", "comp"]

        def cells_of(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            col = {x: table.column(x).to_numpy().astype(np.int64) for x in names}
            new = np.flatnonzero((np.diff(col["token"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)) + 1
            cut = np.r_[0, new, table.num_rows]
            for a, b in zip(cut[:-1] if last else cut[:-2], cut[1:] if last else cut[1:-1], strict=True):
                if b - a > 1:
                    yield from pairs({x: v[a:b] for x, v in col.items()})
            return None if last else table.slice(cut[-2])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                rest = yield from cells_of(table if rest is None else pa.concat_tables([rest, table]).combine_chunks(), False)
        if rest is not None:
            yield from cells_of(rest, True)
        yield flush()

    dealt = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "sid")
    second = compared(scratch, docs, sets, dealt.mapInArrow(crossed, "hub long, other long").distinct(), k, num, den, "second")
    comps = components(scratch, first.unionByName(second), "components")

    ids = rep.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = ids.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = ids.join(least, "comp").select("sid", "component_id")
    return own.join(ids, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("sid").isNull(), F.col("doc_id"))).alias("component_id"))
