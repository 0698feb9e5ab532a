"""Log-bilinear language model, trained by noise-contrastive estimation in numpy.

Units are the most frequent training words (up to a documented number, so the
model grows with the corpus until then), one end unit, and buckets that hold
all other words by their last bytes.  Each unit has a history vector and a
target vector.  A unit is predicted in two factors, its class and itself in
its class:

    p(c | h1, h2) ~ exp((r_h1 C1 + r_g(h2) C2) . q_c + b_c)
    p(w | c, h1)  ~ exp((r_c(h1) D) . q_w + b_w)        over the words of c

with the unit before (h1), the group of the one before that (h2), and a
context matrix for each position.  Classes and groups are clusters of the
units by their neighbours.  Both factors are trained by the noise-contrastive
objective with the unigram distribution as noise.  Objective and gradient
depend on the corpus only through counts of (unit, class), (class, unit) and
(group, group, class), which are counted over the whole corpus in Spark, so the
expected objective, with no sampling, is climbed with matrix products (Adam).
Batched matrix products then give the logarithm of every normaliser, and a
token's log-probability is two dot products less two normalisers.  Inside a
bucket a word has the share (count + 1) / (bucket's counts + distinct words +
1), the last 1 being unseen words.  A text's score is the sum over its words
and its end; the end unit is also the history of the first words.

What the driver and the broadcasts hold is bounded by parameters (units times
classes, remembered words).  Words beyond the remembered ones get their counts
by a join.

Nulls: a null text has no words, only its end; a null doc_id counts as empty
text in the split and is therefore training.  With no training rows every
count is 0 and the model is the uniform one over the end unit and buckets.
Repeated rows train and are scored each.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch, added_up

#: Words with vectors of their own, buckets for the rest, words whose counts are broadcast.
UNIT_WORDS, BUCKETS, REMEMBERED = 20_000, 512, 200_000
#: Clusters of units: classes that are predicted, and coarser groups for the second position.
CLASSES, GROUPS = 256, 64
#: The most frequent units whose company places the others in clusters.
LANDMARKS = 128
DIMENSIONS, NOISE, STEPS, RATE = 32, 8, 60, 0.05
#: Weight of the squared vectors against the corpus' tokens.
DECAY = 10.0
#: Distinct words held before a task passes its counts on.
HELD = 400_000
END = ""


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def bucket_of(word: bytes, buckets: int) -> int:
    """The bucket of a word without a unit of its own: by its last three bytes."""
    return zlib.crc32(word[-3:]) % buckets


def _bucket_column(word: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.substring(word.cast("binary"), -3, 3)), F.lit(buckets)).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) over all texts; the empty word counts the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "count"])
            held.clear()
            return out

        for batch in batches:
            for text in (x.as_py() for x in batch.column(0)):
                held.update(_words(text))
                held[b""] += 1
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class Units:
    """Remembered words with their unit and count, and the buckets' sizes."""

    words: dict[bytes, int]
    unit: np.ndarray
    logs: np.ndarray
    bucket_log: np.ndarray
    top: int

    @property
    def buckets(self) -> int:
        return len(self.bucket_log)

    @property
    def size(self) -> int:
        return self.top + 1 + self.buckets


def make_units(counts: DataFrame, unit_words: int, buckets: int, remembered: int) -> Units:
    """The units of a corpus from its word counts."""
    first = counts.where(F.col("word") != END).orderBy(F.desc("count"), "word").limit(remembered).toArrow()
    names, many = [w.as_py().encode() for w in first.column("word")], first.column("count").to_numpy()
    top = min(unit_words, len(names))
    words = {w: i for i, w in enumerate(names)}
    unit = np.array([i if i < top else top + 1 + bucket_of(w, buckets) for w, i in words.items()], np.int32)
    logs = np.log10(many + 1.0)
    tail = counts.where(F.col("word") != END).groupBy(_bucket_column(F.col("word"), buckets).alias("bucket")).agg(F.sum(F.col("count") + 1).alias("mass"))
    mass = np.ones(buckets)
    for r in tail.collect():  # a row for each bucket at most
        mass[r["bucket"]] += r["mass"]
    for w, n in zip(names[:top], many[:top].tolist(), strict=True):
        mass[bucket_of(w, buckets)] -= n + 1
    return Units(words, unit, logs, np.log10(mass), top)


def _unit_ids(text: str | None, units: Units) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Remembered index of each word (-1: none), its unit, the words and which are not remembered."""
    words = _words(text)
    ids = np.fromiter(map(units.words.get, words, repeat(-1)), np.int64, len(words))
    missing = np.flatnonzero(ids < 0)
    own = units.unit[ids] if len(units.unit) else np.zeros(len(ids), np.int32)
    if len(missing):
        own[missing] = [units.top + 1 + bucket_of(words[i], units.buckets) for i in missing.tolist()]
    return ids, own, words, missing


# ---------------------------------------------------------------- counts over the corpus


def sequences(raw: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of unit ids: each token's target, the unit before it and the one before that; and the texts' lengths."""
    texts = [np.frombuffer(x, np.int32) for x in raw]
    size = np.array([len(t) + 1 for t in texts], np.int64)
    target = np.concatenate([np.r_[t, end] for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    before = np.r_[end, target[:-1]][: len(target)]
    before[first] = end
    second = np.r_[end, before[:-1]][: len(target)]
    second[first] = end
    return target.astype(np.int64), before.astype(np.int64), second.astype(np.int64), size


def summed(encoded: DataFrame, size: int, keys: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterable[np.ndarray]], end: int) -> np.ndarray:
    """How often each of ``size`` keys occurs in the training texts, added up in a tree of tasks.

    ``keys`` gives key arrays of tokens (target, before, second).
    """

    def pack(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.record_batch([pa.array([zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), 1)], pa.binary()), pa.array([zlib.compress(total[at].tobytes(), 1)], pa.binary())], ["at", "n"])

    def unpack(total: np.ndarray, at: bytes, n: bytes) -> None:
        total[np.cumsum(np.frombuffer(zlib.decompress(at), np.int32), dtype=np.int64)] += np.frombuffer(zlib.decompress(n), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, length = np.zeros(size, np.int64), [], 0

        def add() -> None:
            target, before, second, _ = sequences(held, end)
            for k in keys(target, before, second):
                np.add.at(total, k, 1)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(raw)
                length += len(raw) // 4 + 1
                if length > 1 << 20:
                    add()
                    held, length = [], 0
        add()
        yield pack(total)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unpack(total, at, n)
        yield pack(total)

    schema = "at binary, n binary"
    parts = encoded.where("ids is not null and not held_out").select("ids").mapInArrow(count, schema)
    total = np.zeros(size, np.int64)
    for row in added_up(parts, join, schema).collect():
        unpack(total, bytes(row[0]), bytes(row[1]))
    return total


def company(encoded: DataFrame, units: Units) -> np.ndarray:
    """Per unit: how often each landmark stands right before it, and right after it."""
    end, v, k = units.top, units.size, LANDMARKS

    def keys(target: np.ndarray, before: np.ndarray, second: np.ndarray) -> Iterable[np.ndarray]:
        mark = np.full(v, -1)
        mark[: min(units_top, k - 1)] = np.arange(min(units_top, k - 1))
        mark[end] = k - 1
        left, right = mark[before], mark[target]
        yield (target * (2 * k) + left)[left >= 0]
        yield (before * (2 * k) + k + right)[right >= 0]

    units_top = units.top
    return summed(encoded, v * 2 * k, keys, end).reshape(v, 2 * k)


def clusters(found: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """A cluster for each unit by the square roots of its neighbours' shares (k-means, frequent units weigh more)."""
    total = found.sum(axis=1)
    rows = np.sqrt(found / np.maximum(total, 1)[:, None]).astype(np.float32)
    weight = np.sqrt(total + 1.0)
    order = np.argsort(-total, kind="stable")
    k = min(k, len(rows))
    centre = rows[order[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(rows @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        mass = np.bincount(near, weight, k)
        for d in range(rows.shape[1]):
            centre[:, d] = np.where(mass > 0, np.bincount(near, weight * rows[:, d], k) / np.maximum(mass, 1e-9), centre[:, d])
    return np.unique(near, return_inverse=True)[1].astype(np.int64)


@dataclass
class Counts:
    """What training needs of the corpus: (unit, class), (class, unit) and (group, group, class)."""

    pairs: np.ndarray
    inner: np.ndarray
    groups: np.ndarray


def class_counts(encoded: DataFrame, cls: np.ndarray, group: np.ndarray, end: int) -> Counts:
    """The counts over all training texts."""
    v, c, g = len(cls), int(cls.max()) + 1, int(group.max()) + 1
    small_cls, small_group = cls.astype(np.int32), group.astype(np.int32)

    def keys(target: np.ndarray, before: np.ndarray, second: np.ndarray) -> Iterable[np.ndarray]:
        yield before * c + small_cls[target]
        yield v * c + small_cls[before].astype(np.int64) * v + target
        yield 2 * v * c + (small_group[second].astype(np.int64) * g + small_group[before]) * c + small_cls[target]

    total = summed(encoded, 2 * v * c + g * g * c, keys, end)
    return Counts(total[: v * c].reshape(v, c), total[v * c : 2 * v * c].reshape(c, v), total[2 * v * c :].reshape(g, g, c))


# ---------------------------------------------------------------- training


def _climb(p: dict[str, np.ndarray], gradient: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], steps: int, rate: float) -> None:
    """Adam, upwards and in place."""
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, steps + 1):
        step = rate * min(1.0, 2 * (1 - (t - 1) / steps))
        for k, g in gradient(p).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] += step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)


def _push(scores: np.ndarray, pairs: np.ndarray, mass: np.ndarray, noise: np.ndarray, total: float) -> np.ndarray:
    """Gradient of the expected noise-contrastive objective by the scores; reuses ``scores``.

    ``mass``: tokens of each history that the targets compete for; ``noise``:
    noise samples a token times each target's share.
    """
    scores -= np.log(noise)
    np.clip(scores, -30, 30, out=scores)
    np.exp(-scores, out=scores)
    true = np.reciprocal(scores + 1, out=scores)  # that a target is data, not noise
    true *= pairs + mass * noise
    np.subtract(pairs, true, out=true)
    true /= total
    return true


def train_pairs(pairs: np.ndarray, noise: np.ndarray, mass: np.ndarray, bias: np.ndarray, dimensions: int = DIMENSIONS, samples: int = NOISE, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = 0) -> dict[str, np.ndarray]:
    """Vectors r (histories) and q (targets), context matrix c and biases b from counts [history, target]."""
    rng = np.random.default_rng(seed)
    (n, m), total = pairs.shape, max(float(pairs.sum()), 1.0)
    pairs, mass, k_noise = pairs.astype(np.float32), mass.astype(np.float32), (samples * noise).astype(np.float32)
    p = {k: v.astype(np.float32) for k, v in (("r", rng.normal(0, 0.1, (n, dimensions))), ("q", rng.normal(0, 0.1, (m, dimensions))), ("c", np.eye(dimensions)), ("b", bias))}

    def gradient(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        predicted = p["r"] @ p["c"]
        push = _push(predicted @ p["q"].T + p["b"], pairs, mass, k_noise, total)
        inner = push @ p["q"]
        return {"q": push.T @ predicted - (decay / total) * p["q"], "b": push.sum(axis=0), "r": inner @ p["c"].T - (decay / total) * p["r"], "c": p["r"].T @ inner}

    _climb(p, gradient, steps, rate)
    return p


@dataclass
class Model:
    """The trained model in the form that scores: per unit and class, float32."""

    end: int
    cls: np.ndarray
    group: np.ndarray
    first: np.ndarray  # unit before, times its context matrix
    second: np.ndarray  # group of the unit before that, times its context matrix
    q_class: np.ndarray
    b_class: np.ndarray
    z_class: np.ndarray  # [unit, group]
    inner: np.ndarray  # class of the unit before, times its context matrix
    q_unit: np.ndarray
    b_unit: np.ndarray
    z_unit: np.ndarray  # [class before, class]

    def log_probability(self, target: np.ndarray, before: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised, of targets after two units."""
        c, g, h = self.cls[target], self.group[second], self.cls[before]
        predicted = self.first[before]
        predicted += self.second[g]
        out = np.einsum("ij,ij->i", predicted, self.q_class[c]) + self.b_class[c] - self.z_class[before, g]
        return out + np.einsum("ij,ij->i", self.inner[h], self.q_unit[target]) + self.b_unit[target] - self.z_unit[h, c]


def train(counts: Counts, cls: np.ndarray, group: np.ndarray, end: int, dimensions: int = DIMENSIONS, samples: int = NOISE, steps: int = STEPS) -> Model:
    """Both factors by noise-contrastive estimation, then all normalisers."""
    c, g = int(cls.max()) + 1, int(group.max()) + 1
    of_unit = counts.pairs.sum(axis=1)  # tokens after each unit
    of_class = counts.pairs.sum(axis=0)
    noise = (of_class + 1) / (of_class.sum() + c)
    p = train_pairs(counts.pairs, noise, of_unit[:, None], np.log(noise), dimensions, samples, steps)
    first = p["r"] @ p["c"]

    # the second position: groups are their units' mean, with a matrix of their own on top of the first position
    weight = of_unit + 1e-3
    mean = np.stack([np.bincount(group, weight * p["r"][:, d], g) for d in range(dimensions)], axis=1) / np.bincount(group, weight, g)[:, None]
    mean = mean.astype(np.float32)
    ahead = (mean @ p["c"]).astype(np.float32)
    joint = counts.groups.reshape(g * g, c).astype(np.float32)
    mass = joint.sum(axis=1, keepdims=True)
    total = max(float(joint.sum()), 1.0)
    k_noise = (samples * noise).astype(np.float32)
    back, near = np.repeat(np.arange(g), g), np.tile(np.arange(g), g)
    p2 = {"c2": np.zeros((dimensions, dimensions), np.float32), "t": np.zeros((g, dimensions), np.float32)}

    def gradient(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        push = _push((mean @ x["c2"] + x["t"])[back] @ p["q"].T + (ahead @ p["q"].T + p["b"])[near], joint, mass, k_noise, total)
        inner = (push @ p["q"]).reshape(g, g, dimensions).sum(axis=1)
        return {"c2": mean.T @ inner, "t": inner - (DECAY / total) * x["t"]}

    _climb(p2, gradient, steps, RATE)
    second = mean @ p2["c2"] + p2["t"]
    del joint

    of_target = counts.inner.sum(axis=0)
    in_class = np.bincount(cls, of_target + 1, c)
    share = (of_target + 1) / in_class[cls]
    by_class = np.zeros((len(counts.inner), c))
    for h in range(len(by_class)):
        by_class[h] = np.bincount(cls, counts.inner[h], c)
    w = train_pairs(counts.inner, share, by_class[:, cls], np.log(share), dimensions, samples, steps)
    inner = w["r"] @ w["c"]

    # normalisers, a block of histories at a time
    z_class = np.empty((len(first), g), np.float32)
    to_second = second @ p["q"].T
    for a in range(0, len(first), 256):
        s = (first[a : a + 256] @ p["q"].T + p["b"])[:, None, :] + to_second
        top = s.max(axis=2, keepdims=True)
        z_class[a : a + 256] = np.log(np.exp(s - top).sum(axis=2)) + top[:, :, 0]
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(c))
    s = (inner @ w["q"].T + w["b"])[:, order].astype(np.float64)
    z_unit = np.log(np.add.reduceat(np.exp(s), edge, axis=1)).astype(np.float32)
    return Model(end, cls.astype(np.int32), group.astype(np.int32), first, second.astype(np.float32), p["q"], p["b"], z_class, inner, w["q"], w["b"], z_unit)


ENCODED = "row_id long, word string, many int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, ids binary"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def encoded_rows(docs: DataFrame, units, end_log: float, seen: bool) -> DataFrame:
    """Per row its unit ids and base figures, and a row for each word of it that is not remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = units.value
        for batch in batches:
            row_ids, doc_ids, held = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for a in range(0, batch.num_rows, 500):
                texts = batch.column(2).slice(a, 500).to_pylist()
                out: list[list] = [[] for _ in range(10)]

                def put(*row, out=out) -> None:
                    for c, x in zip(out, row, strict=True):
                        c.append(x)

                for i in range(a, a + len(texts)):
                    ids, own, words, missing = _unit_ids(texts[i - a], u)
                    known = ids[ids >= 0]
                    base = float(u.logs[known].sum()) + end_log if len(known) else end_log
                    tail = own > u.top
                    inside = ids[tail & (ids >= 0)]
                    share = (float(u.logs[inside].sum()) if len(inside) else 0.0) - float(u.bucket_log[own[tail] - u.top - 1].sum())
                    put(row_ids[i], f" {row_ids[i]}", 0, doc_ids[i], held[i], len(ids) + 1, len(known) + seen, base, share, own.astype(np.int32).tobytes())
                    for w, many in Counter(words[j] for j in missing.tolist()).items():
                        put(row_ids[i], w.decode(), many, None, None, 0, 0, 0.0, 0.0, None)
                types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split(" ")[0] for x in ENCODED.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", "held_out").mapInArrow(run, ENCODED)


def fitted(docs: DataFrame, scratch: Scratch, unit_words: int, buckets: int, classes: int, groups: int, remembered: int) -> tuple[DataFrame, DataFrame, Model, Units, int, int]:
    """(encoded rows, word counts, model, units, training tokens, distinct training tokens) of a corpus."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = scratch.save(word_counts(docs.where(~F.col("held_out"))), "counts")
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == END).select("count").first()
    units = make_units(counts, unit_words, buckets, remembered)
    shared = spark.sparkContext.broadcast(units)
    encoded = scratch.save(encoded_rows(docs, shared, math.log10((ends[0] if ends else 0) + 1), bool(ends)), "encoded")
    found = company(encoded, units)
    cls, group = clusters(found, classes), clusters(found, groups)
    model = train(class_counts(encoded, cls, group, units.top), cls, group, units.top)
    return encoded, counts, model, units, int(n), int(v)


def score(docs: DataFrame, unit_words: int = UNIT_WORDS, buckets: int = BUCKETS, remembered: int = REMEMBERED, classes: int = CLASSES, groups: int = GROUPS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    encoded, counts, model, _, n, v = fitted(docs, Scratch(docs.sparkSession, "lbl"), unit_words, buckets, classes, groups, remembered)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).to_pylist()
            sums = np.zeros(len(raw))
            at = [i for i, x in enumerate(raw) if x is not None]
            a = 0
            while a < len(at):
                b, size = a, 0
                while b < len(at) and (b == a or size + len(raw[at[b]]) <= 1 << 18):
                    size += len(raw[at[b]])
                    b += 1
                target, before, second, each = sequences([raw[i] for i in at[a:b]], m.end)
                total = np.concatenate([m.log_probability(target[i : i + 65536], before[i : i + 65536], second[i : i + 65536]) for i in range(0, len(target), 65536)])
                sums[at[a:b]] = np.add.reduceat(total.astype(np.float64), np.cumsum(each) - each) / math.log(10)
                a = b
            model = batch.column(8).to_numpy() + sums
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(model)], [*batch.schema.names[:8], "model"])

    # scored before the join, so that no text's units are shuffled
    rows = encoded.mapInArrow(run, ENCODED.removesuffix(", ids binary"))
    # a document's own row has a key that no word can be, so both kinds spread over the join
    joined = rows.join(counts, "word", "left")
    gain = F.when(F.col("count").isNull(), 0.0).otherwise(F.col("many") * F.log10(F.col("count") + 1))
    every = joined.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("count").isNull(), 0).otherwise(F.col("many"))).alias("n_known"),
        F.sum(F.col("base") + gain).alias("base"),
        F.sum(F.col("model") + gain).alias("score"),
    )
    return every.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score")
