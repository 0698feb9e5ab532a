"""Vectorised word and shingle hashing shared by several operators.

Words are the matches of ``[^\\x20\\x09-\\x0D]+``.  All hashing is on UTF-8
bytes with fixed 64-bit constants, so every worker and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE[~_WORD] = 0
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(max(n, (1 << 20) + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word in ``data``, with its first and past-the-end byte."""
    buf = np.frombuffer(data, np.uint8)
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _WORD[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (empty for fewer words)."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _LANE[j]
    return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for a short sequence taken as a whole, with its length."""
    return mix((hashes * _LANE[: len(hashes)]).sum(keepdims=True) + _LANE[15:] * np.uint64(len(hashes)))


def slices(batch, rows: int = 512):
    """A record batch in slices, so that few texts are Python strings at once."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def chunks(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts joined into buffers of about ``most`` bytes.

    Yields the first and past-the-end index, the buffer and the offsets of
    the texts in it.  A longer text is a buffer of its own.
    """
    first, parts, offsets, at = 0, [], [0], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if parts and at + len(raw) > most:
            yield first, i, b"\n".join(parts), np.array(offsets)
            first, parts, offsets, at = i, [], [0], 0
        parts.append(raw)
        at += len(raw) + 1
        offsets.append(at)
    if parts:
        yield first, first + len(parts), b"\n".join(parts), np.array(offsets)


def text_words(texts: Iterable[str | None], lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; A-Z lower-cased if asked."""
    for _, _, data, offsets in chunks(texts):
        hashes, starts, _ = word_hashes(data.lower() if lower else data)
        cut = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            yield hashes[cut[i] : cut[i + 1]]


def text_shingles(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The k-word shingles of each text, repeats kept, A-Z lower-cased.

    A text of 1 to k-1 words has its whole sequence as one; one without
    words has none.
    """
    for _, _, data, offsets in chunks(texts):
        hashes, starts, _ = word_hashes(data.lower())
        runs = shingles(hashes, k)
        cut = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            a, b = cut[i], cut[i + 1]
            yield runs[a : b - k + 1] if b - a >= k else whole(hashes[a:b]) if b > a else hashes[:0]
