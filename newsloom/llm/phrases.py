"""Phrase collocations: counts by multikey quicksort of suffix pointers, scores by the weakest cut.

Texts are cut into pieces and pieces into words.  A suffix is a place in a
piece with at most three words from there on.  Each task numbers its words,
adds up equal suffixes and deals them out by a hash of their two leading
words, so that all suffixes that begin alike meet, wherever they stood.  A
receiving task sorts pointers to its suffixes by three-way partitioning, one
word deeper wherever the words so far are equal: the size of an equal
partition is the count of its words, and a partition below the least count is
abandoned, as everything deeper is rarer still.  All open partitions of a
round are split at once by array operations.

Pairs of words that a sample shows to be very common are dealt out by their
third word as well; their own count is dealt out apart.  The sample decides
where suffixes meet and never what is counted.

Defined cases: a null text is empty, a null lang is ``und``; every other lang
stands for itself, the empty one too.  Only A-Z change to lower case.  Pieces
and words may be of any length; an empty piece has no words.  Repeated rows
count as often as they occur.  Equal scores are ordered by count, equal
counts by the UTF-8 bytes of the phrase, and phrases are distinct, so there
are no further ties.  An empty table gives no rows.  No other column is read,
whatever its name.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch

#: Words of the longest phrase, and the least count of a candidate.
DEPTH, LEAST = 3, 10
#: Rows of a lang in the result.
TOP = 2000
#: Word places that a task holds before it adds them up and hands them on.
CHUNK = 1_500_000
#: Parts of a receiving partition, which are sorted one after another.
PARTS = 2
#: A pair of words with more than this share of a sample's places is dealt out by the third word too: 500 pairs at most.
COMMON = 1 / 500
#: Documents of the sample for that, about.
SAMPLE = 5000
#: A word or pair with this share of all places, or more, meets its candidates by broadcast: as many rows at most as the share goes into 1.
BROADCAST = 1 / 2000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else _LOWER[c] for c in range(256))
_SEP = b"\n"
_BLOB = "lang string, part int, words binary, ids binary, n binary"
_COUNTS = "lang string, k int, phrase string, f long"


class _Words:
    """Numbers of words: 0 is nothing, 1 the end of a piece, words from 2 on."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[b""], self.number[_SEP]

    def read(self, text: str) -> np.ndarray:
        """Numbers of the text's words, with an end after each piece."""
        tokens = (text.encode("utf-8", "surrogatepass").translate(_TABLE) + _SEP).replace(_SEP, b" \n ").split(b" ")
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids != 0]


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of the pieces, as rows of three numbers (0 beyond the piece), and their counts."""
    padded = np.concatenate([ids, [1, 1]])
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    word = a != 1
    a, b, c = a[word], b[word], c[word]
    b = np.where(b == 1, 0, b)
    c = np.where((b == 0) | (c == 1), 0, c)
    width = max(int(padded.max()).bit_length(), 1)
    if 3 * width <= 63:
        packed, n = np.unique((a << 2 * width | b << width | c), return_counts=True)
        mask = (1 << width) - 1
        return np.stack([packed >> 2 * width, packed >> width & mask, packed & mask], axis=1), n
    rows, n = np.unique(np.stack([a, b, c], axis=1), axis=0, return_counts=True)
    return rows, n


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hash of numbers."""
    x = x.astype(np.uint64)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return x ^ x >> np.uint64(32)


def _common_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words with their counts in a sample, for the frequent ones of each task."""
    words, parts = _Words(), defaultdict(list)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts[lang].append(words.read(text))
    names = list(words.number)
    for lang, ids in parts.items():
        rows, n = _suffixes(np.concatenate(ids))
        rows, n = rows[rows[:, 1] > 0], n[rows[:, 1] > 0]
        if not len(n):
            continue
        pairs, at = np.unique(rows[:, :2], axis=0, return_inverse=True)
        sums = np.bincount(at.ravel(), weights=n).astype(np.int64)
        keep = sums * 4 > n.sum() * COMMON
        pick = pairs[keep]
        firsts, seconds = ([None, *(_text(names[i]) for i in side)] for side in pick.T)  # the row without words has all places
        kind = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64()), ("all", pa.int64())])
        yield pa.record_batch([[lang] * len(firsts), firsts, seconds, [0, *sums[keep].tolist()], [int(n.sum()), *[0] * len(pick)]], schema=kind)


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def _dealt(common: list[tuple[str, str, str]], buckets: int):
    """Task function: texts to packed suffixes by bucket."""

    def blobs(lang: str, rows: np.ndarray, n: np.ndarray, bucket: np.ndarray, names: list[bytes]) -> Iterator[tuple]:
        order = np.argsort(bucket, kind="stable")
        rows, n, bucket = rows[order], n[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
            used, own = np.unique(np.concatenate([[0], rows[start:end].ravel()]), return_inverse=True)
            yield lang, int(bucket[start]), b" ".join([names[i] for i in used[1:]]), own[1:].astype(np.int32).tobytes(), n[start:end].astype(np.int64).tobytes()

    def flush(words: _Words, parts: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = list(words.number)
        crc = _mixed(np.fromiter(map(zlib.crc32, names), np.int64, len(names)))
        out = []
        for lang, ids in parts.items():
            rows, n = _suffixes(np.concatenate(ids))
            salt = np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass")))
            first = _mixed(crc[rows[:, 0]] + salt)
            # every place counts for its first word
            one, at = np.unique(rows[:, 0], return_inverse=True)
            singles = np.stack([one, np.zeros_like(one), np.zeros_like(one)], axis=1)
            kinds = [(singles, np.bincount(at, weights=n).astype(np.int64), _mixed(crc[one] + salt), 1)]
            two = rows[:, 1] > 0
            rows, n, first = rows[two], n[two], first[two]
            pair = _mixed(first ^ crc[rows[:, 1]] * np.uint64(3))
            known = [tuple(words.number.get(w.encode("utf-8", "surrogatepass"), -1) for w in p) for l, *p in common if l == lang]
            joined = rows[:, 0] << 32 | rows[:, 1]
            hot = np.isin(joined, [i << 32 | j for i, j in known if i >= 0 and j >= 0])
            kinds.append((rows[~hot], n[~hot], pair[~hot], 2))
            if hot.any():
                _, at, of = np.unique(joined[hot], return_index=True, return_inverse=True)
                both = rows[hot][at] * [1, 1, 0]
                kinds.append((both, np.bincount(of, weights=n[hot]).astype(np.int64), pair[hot][at], 2))
                three = hot & (rows[:, 2] > 0)
                kinds.append((rows[three], n[three], _mixed(pair[three] ^ crc[rows[three, 2]] * np.uint64(5)), 3))
            for rows_, n_, hash_, least in kinds:
                # the depth from which equal partitions are counts stands before the bucket
                for l, bucket, *rest in blobs(lang, rows_, n_, (hash_ % np.uint64(buckets)).astype(np.int64), names) if len(n_) else ():
                    out.append((l, bucket * 4 + least, *rest))
        for i in range(0, len(out), 256):
            yield pa.record_batch([list(x) for x in zip(*out[i : i + 256], strict=True)], schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), ("words", pa.binary()), ("ids", pa.binary()), ("n", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, held = _Words(), defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.read(text).astype(np.int32)
                parts[lang].append(ids)
                held += len(ids)
                if held >= CHUNK:
                    yield from flush(words, parts)
                    words, parts, held = _Words(), defaultdict(list), 0
        if held:
            yield from flush(words, parts)

    return run


def multikey_quicksort(keys: np.ndarray, n: np.ndarray, first: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, row, count) of every run of equal leading words with a count of at least ``least``.

    ``keys`` are rows of word numbers, 0 beyond the end; ``n`` are the rows'
    counts.  Depths below ``first`` are walked but not reported.  ``row`` is
    any row of the run.  Pointers are split in rounds: each open partition
    around the word of its middle pointer into less, equal and greater; the
    equal one goes a word deeper.  A partition whose counts add up to less
    than ``least`` is abandoned.
    """
    where = np.arange(len(keys))
    seg = np.zeros(len(keys), np.int64)
    depth = np.zeros(1, np.int64)
    while len(where):
        bounds = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sizes = np.diff(np.append(bounds, len(seg)))
        of = np.repeat(np.arange(len(bounds)), sizes)
        d = depth[of]
        word = keys[where, d]
        pivot = word[bounds + sizes // 2]
        side = np.sign(word - pivot[of]) + 1  # 0 less, 1 equal, 2 greater
        part = of * 3 + side
        weight = np.bincount(part, weights=n[where], minlength=3 * len(bounds))
        equal = np.arange(len(bounds)) * 3 + 1
        alive = weight >= least
        ended = np.zeros(len(alive), bool)
        ended[equal] = pivot == 0  # shorter suffixes end here
        some = np.zeros(len(alive), np.int64)
        some[part] = where
        deep = np.zeros(len(alive), np.int64)
        for s in range(3):
            deep[s::3] = depth + (s == 1)
        found = np.flatnonzero(alive & ~ended & (np.arange(len(alive)) % 3 == 1) & (deep >= first))
        yield from zip(deep[found].tolist(), some[found].tolist(), weight[found].astype(np.int64).tolist(), strict=True)
        alive &= ~ended & (deep < keys.shape[1])
        keep = alive[part]
        where, part = where[keep], part[keep]
        order = np.argsort(part, kind="stable")
        where, part = where[order], part[order]
        live = np.flatnonzero(alive)
        seg, depth = np.searchsorted(live, part), deep[live]


def _counted(least: int):
    """Task function: packed suffixes, ordered by part, to counts of words, pairs and triples."""

    def sort(lang_blobs: dict[str, list[tuple]], first: int) -> Iterator[pa.RecordBatch]:
        for lang, blobs in lang_blobs.items():
            number: dict[bytes, int] = defaultdict(count(1).__next__)
            keys = []
            for words, ids, _ in blobs:
                own = np.array([0, *map(number.__getitem__, words.split(b" "))], np.int32)
                keys.append(own[np.frombuffer(ids, np.int32)].reshape(-1, DEPTH))
            keys = np.concatenate(keys)
            n = np.concatenate([np.frombuffer(x, np.int64) for *_, x in blobs])
            names = [b"", *number]
            out: list[tuple] = [(lang, 0, "", int(n.sum()))] if first == 1 else []
            for depth, row, f in multikey_quicksort(keys, n, first, least):
                out.append((lang, depth, b" ".join(names[i] for i in keys[row, :depth]).decode("utf-8", "surrogatepass"), f))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, defaultdict(list)
        for batch in batches:
            for lang, part, words, ids, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != at and held:
                    yield from sort(held, at % 4)
                    held = defaultdict(list)
                at = part
                held[lang].append((words, ids, n))
        if held:
            yield from sort(held, at % 4)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([list(x) for x in zip(*rows, strict=True)], schema=pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())]))


def common_pairs(texts: DataFrame, rows: int) -> list[tuple[str, str, str]]:
    """lang and words of the pairs that take more than ``COMMON`` of the places of a sample of about ``SAMPLE`` texts."""
    part = texts if rows <= SAMPLE else texts.sample(SAMPLE / rows, seed=7)
    seen = part.repartition(8).mapInArrow(_common_pairs, "lang string, a string, b string, n long, all long")
    sums = seen.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    places = seen.agg(F.sum("all")).first()[0] or 0
    return [(r.lang, r.a, r.b) for r in sums.where((F.col("n") > places * COMMON) & F.col("a").isNotNull()).collect()]


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, k, phrase and f of all phrases of 1 to 3 words with at least ``least`` occurrences; k = 0: parts of the number of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = texts.mapInArrow(_dealt(common_pairs(texts, docs.count()), tasks * PARTS), _BLOB)
    task = F.floor(F.col("part") / (4 * PARTS)).cast("int")
    return blobs.repartitionById(tasks, task).sortWithinPartitions("part").mapInArrow(_counted(least), _COUNTS)


def _with_count(rows: DataFrame, key: Column, counts: DataFrame, name: str, places: int) -> DataFrame:
    """``rows`` with the count of the phrase ``key``.

    A phrase can be part of a tenth as many candidates as it has places.  The
    few that have a large share of all places are broadcast, so the shuffle
    of the others has no hot key.
    """
    big = F.col("f") > places * BROADCAST
    few = F.broadcast(counts.where(big).select(F.col("lang").alias("few_lang"), F.col("phrase").alias("few_phrase"), F.col("f").alias("few_f")))
    rest = counts.where(~big).select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of_phrase"), F.col("f").alias("of_f"))
    out = rows.withColumn("key", key).join(few, (F.col("lang") == F.col("few_lang")) & (F.col("key") == F.col("few_phrase")), "left")
    out = out.withColumn("cold", F.when(F.col("few_f").isNull(), F.col("key")).otherwise(F.concat(F.lit(" "), F.col("phrase"))))  # no phrase begins with a space
    out = out.join(rest, (F.col("lang") == F.col("of_lang")) & (F.col("cold") == F.col("of_phrase")), "left")
    return out.withColumn(name, F.coalesce("few_f", "of_f")).drop("key", "cold", "few_lang", "few_phrase", "few_f", "of_lang", "of_phrase", "of_f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "phrases")
    counts = scratch.save(phrase_counts(docs, least), "counts")
    totals = counts.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    places = counts.where("k = 0").agg(F.sum("f")).first()[0] or 0
    words, pairs, triples = (counts.where(F.col("k") == k) for k in (1, 2, 3))
    w = F.split("phrase", " ")
    head, tail = F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2])

    two = _with_count(_with_count(pairs, w[0], words, "l", places), w[1], words, "r", places)
    longer = triples.select("lang", F.explode(F.array_distinct(F.array(head, tail))).alias("in_phrase"), "f").groupBy(F.col("lang").alias("in_lang"), "in_phrase").agg(F.max("f").alias("longest"))
    two = two.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left").where(~(100 * F.coalesce("longest", F.lit(0)) >= 50 * F.col("f"))).drop("in_lang", "in_phrase", "longest")
    three = triples
    for name, key, of in (("l1", w[0], words), ("r1", tail, pairs), ("l2", head, pairs), ("r2", w[2], words)):
        three = _with_count(three, key, of, name, places)

    def score(l: str, r: str) -> Column:
        wide = lambda c: F.col(c).cast("decimal(18,0)")
        return F.call_function("div", (wide("f") * wide("f")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))

    two = two.select("lang", "phrase", "f", "l", "r", score("l", "r").alias("score"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("*", score("l1", "r1").alias("s1"), score("l2", "r2").alias("s2")).select("lang", "phrase", "f", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase"))
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
