"""Vectorised hashes of words and shingles for batches of texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)  # constants only: the same in every process
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes hashed at once: eight-byte values per byte stay within a few MB.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[str | None], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words (runs without ASCII white space)."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # segments end between words
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, length = edge[::2], edge[1::2] - edge[::2]
        if len(first):
            before = np.cumsum(length) - length
            place = np.arange(before[-1] + length[-1]) - np.repeat(before, length)
            power = np.multiply.accumulate(np.full(int(length.max()) + 1, _BASE, np.uint64))
            value = _BYTE[raw[inside]] * power[place]
            starts.append(first + at)
            hashes.append(mix(np.add.reduceat(value, before) ^ length.astype(np.uint64)))
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A text with fewer words has one shingle, its whole word sequence; one without words none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, word = word_hashes(b"\n".join(raw))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    many = max(0, len(word) - width + 1)
    total = np.zeros(many, np.uint64)
    for k in range(width if many else 0):
        total += word[k : k + many] * _LANES[k]
    full = mix(total)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            short = np.sum(word[a:b] * _LANES[: b - a], dtype=np.uint64)
            out.append(mix(np.array([short], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def min_hashes(sets: Sequence[np.ndarray], k: int, seed: int = 7) -> np.ndarray:
    """(texts, k) uint32 MinHash signature; rows of empty sets are all ones."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 2**32, k, dtype=np.uint32)
    odd = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    if len(some):
        values = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        offsets = np.cumsum(sizes[some]) - sizes[some]
        work = np.empty_like(values)
        for j in range(k):
            np.bitwise_xor(values, flip[j], out=work)
            np.multiply(work, odd[j], out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
            out[some, j] = np.minimum.reduceat(work, offsets)
    return out
