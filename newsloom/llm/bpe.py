"""Byte-level BPE by merge replay over a partition's distinct words.

Texts are split by the tokenizer's pattern.  The distinct pieces that a worker
has not met yet are laid out end to end as bytes, and an inverted index from
the rank of an adjacent pair to its positions drives the merges: the lowest
rank is taken from a heap, all its positions merge at once, and only the two
neighbours of each merged place are looked up again.  A piece in which a merge
opens a lower rank than the one in hand is replayed alone in strict order, so
the result is always that of the lowest-rank-first rule.

Null texts encode as empty, empty texts to no ids; very long texts and very
long pieces are encoded whole.  Decoding is a lookup of bytes by id.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.scratch import small_batches

#: Distinct pieces that a worker remembers; beyond it the rarest half goes.
REMEMBERED = 400_000
#: Characters encoded at a time, unless one text is longer.
CHUNK = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is the id) from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of two adjacent tokens' merge by ``left << 32 | right``, for all pairs that merge.

    A pair merges if its bytes are a token, so these are the ways to cut each
    token in two tokens.
    """
    return {ranks[t[:i]] << 32 | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def strict(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int]:
    """One piece, always the leftmost pair of the lowest rank."""
    out = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    while len(out) > 1:
        best, at = min(((r, i) for i in range(len(out) - 1) if (r := pairs.get(out[i] << 32 | out[i + 1], -1)) >= 0), default=(-1, -1))
        if best < 0:
            break
        out[at : at + 2] = [best]
    return out


def byte_pairs(ranks: dict[bytes, int], pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token of each byte, and rank of each pair of bytes (-1: none)."""
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
    table = np.array([pairs.get(int(x) << 32 | int(y), -1) for x in single for y in single], np.int64)
    return single, table


def replay(pieces: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int], start: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[int]]:
    """The ids of many pieces at once, by the pair index."""
    single, table = start or byte_pairs(ranks, pairs)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    n = len(raw)
    opened = np.full(n, -1, np.int64)
    if n > 1:
        opened[:-1] = table[raw[:-1] << 8 | raw[1:]]
        opened[ends - 1] = -1
    # the index: all positions of each pair, in order
    at = np.flatnonzero(opened >= 0)
    at = at[np.argsort(opened[at], kind="stable")]
    found, first = np.unique(opened[at], return_index=True)
    heap: list[int] = found.tolist()
    where: dict[int, list[int]] = dict(zip(heap, (x.tolist() for x in np.split(at, first[1:])), strict=True)) if heap else {}
    token: list[int] = single[raw].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for e, k in zip(ends.tolist(), size.tolist(), strict=True):
        if k:
            after[e - 1] = before[e - k] = -1
    lower: list[int] = []
    get, push, pop = pairs.get, heapq.heappush, heapq.heappop
    while heap:
        rank = pop(heap)
        for i in sorted(where.pop(rank)):
            left = token[i]
            j = after[i]
            if left < 0 or j < 0 or get(left << 32 | token[j]) != rank:
                continue
            token[i], token[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                r = get(rank << 32 | token[k])
                if r is not None:
                    if r < rank:
                        lower.append(i)
                    if r in where:
                        where[r].append(i)
                    else:
                        where[r] = [i]
                        push(heap, r)
            h = before[i]
            if h >= 0:
                r = get(token[h] << 32 | rank)
                if r is not None:
                    if r < rank:
                        lower.append(h)
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        push(heap, r)
    flat = np.array(token, np.int64)
    kept = flat >= 0
    cut = np.r_[0, np.cumsum(kept)][np.r_[0, ends]].tolist()
    ids = flat[kept].tolist()
    out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i, p in enumerate(pieces):
        if p in ranks:
            out[i] = [ranks[p]]
    for w in set(np.searchsorted(ends, lower, "right").tolist()) if lower else ():
        if pieces[w] not in ranks:
            out[w] = strict_heap(pieces[w], ranks, pairs)
    return out


def strict_heap(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int]:
    """As ``strict``, in n log n for long pieces."""
    if len(piece) < 64:
        return strict(piece, ranks, pairs)
    token = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    n = len(token)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(token[i] << 32 | token[i + 1], -1)) >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if token[i] < 0 or j < 0 or pairs.get(token[i] << 32 | token[j]) != rank:
            continue
        token[i], token[j] = rank, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := pairs.get(rank << 32 | token[k], -1)) >= 0:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := pairs.get(token[h] << 32 | rank, -1)) >= 0:
            heapq.heappush(heap, (r, h))
    return [t for t in token if t >= 0]


class Encoder:
    """A worker's encoder: remembers the ids of the pieces it has met."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = pair_ranks(self.ranks)
        self.start_at = byte_pairs(self.ranks, self.pairs)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.flat, self.start, self.hits = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the pieces met most, half of what is remembered at most."""
        names = list(self.known)
        often = np.argsort(-self.hits, kind="stable")[: REMEMBERED // 2]
        often = often[self.hits[often] > 1]
        size = np.diff(self.start)[often]
        past = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[often] - past + size, size) + np.arange(past[-1] if len(past) else 0)]
        self.start = np.r_[0, past]
        self.known = {names[i]: k for k, i in enumerate(often.tolist())}
        self.hits = np.zeros(len(often), np.int64)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = [p for p in pieces if p not in self.known]
        ids = replay([p.encode() for p in new], self.ranks, self.pairs, self.start_at)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter((t for x in ids for t in x), np.int32, int(sizes.sum()))])
        self.hits = np.concatenate([self.hits, np.zeros(len(ids), np.int64)])
        at = len(self.known)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts in them."""
        pieces = [self.split(t) for t in texts]
        self.learn(set().union(*pieces))
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        which = np.fromiter((i for p in pieces for i in map(self.known.__getitem__, p)), np.int64, int(count.sum()))
        self.hits += np.bincount(which, minlength=len(self.hits))
        first, size = self.start[which], self.start[which + 1] - self.start[which]
        past = np.cumsum(size)
        ids = self.flat[np.repeat(first - past + size, size) + np.arange(past[-1] if len(past) else 0)]
        return ids, np.r_[0, past][np.r_[0, np.cumsum(count)]]


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_DECODERS: dict[str, pa.Array] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _decoder(path: str) -> pa.Array:
    if path not in _DECODERS:
        ranks = read_ranks(path)
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        _DECODERS[path] = pa.array(tokens, pa.binary())
    return _DECODERS[path]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without its text column, with ``ids array<int>`` (null text: none).

    A column of ``df`` named as ``ids`` is replaced, all others stay; rows
    keep their number, repeated ones too, and equal texts get equal ids.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text, ids)]
    order = df.select(F.col(f"`{text}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in rest])
    schema = ", ".join([f"`{c}` {order.schema[c].dataType.simpleString()}" for c in rest] + [f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in (part.slice(i, 512) for part in batches for i in range(0, part.num_rows, 512)):
            texts = batch.column(0).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") <= CHUNK):
                    size += len(texts[b] or "")
                    b += 1
                got, at = enc.encode([t or "" for t in texts[a:b]])
                made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(a, b - a) for i in range(len(rest))), made], [*rest, ids])
                a = b

    return order.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes of ``ids`` (null: empty) added as ``out``, in place of a column of that name."""
    columns = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + [f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _decoder(path)
        for batch in batches:
            at = columns.index(ids)
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                lists = part.column(at)
                flat = lists.flatten()
                size = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
                data = tokens.take(flat)
                edge = np.frombuffer(data.buffers()[1], np.int32)[: len(data) + 1] if len(data) else np.zeros(1, np.int32)
                cut = edge[np.r_[0, np.cumsum(size)]].astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cut.tobytes()), data.buffers()[2] if len(data) and data.buffers()[2] else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*columns, out])

    return df.mapInArrow(run, schema)
