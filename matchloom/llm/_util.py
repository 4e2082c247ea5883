"""Shared helpers of the training-data operators: staged tables, samples, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..sources.stage import dropped, staged

__all__ = ["cutoff", "dropped", "each", "hash_spans", "mix", "short", "staged", "window_hashes", "word_hashes"]


def short(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most so many rows: Spark bounds a batch by bytes, this what a worker makes of it at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def each(column: pa.Array, rows: int = 512) -> Iterator:
    """The values of a column, of which no more than so many are Python objects at a time."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def cutoff(n: int, wanted: int) -> int:
    """The 64-bit hash up to which some 2 * ``wanted`` + 1000 of ``n`` rows have theirs. A sample of the lowest hashes need look no higher, so that what is sorted for it doesn't grow with the data."""
    share = (2 * wanted + 1000) / max(n, 1)
    return 2**63 - 1 if share >= 1 else int(-(2**63) + share * 2**64)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1 = np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ordered pairs (a, b)."""
    x = a * _M1
    x += b
    x ^= x >> _S1
    x *= _M2
    x ^= x >> _S1
    return x


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, from word hashes, by doubling: a window of 2n words is the pair of its halves."""
    if len(words) < length:
        return words[:0]
    n, have = 1, words
    while 2 * n <= length:
        have = mix(have[:-n], have[n:])
        n *= 2
    if n < length:
        have = mix(have[: len(words) - length + 1], have[length - n :][: len(words) - length + 1])
    return have


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bases of the two word hashes; where 64 bits may not decide, both together do.
_BASES = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
#: Bytes that are hashed at once, and the length from which a word is hashed on its own.
_PIECE, _LONG = 1 << 18, 64
_powers = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def _up_to(n: int, which: int) -> np.ndarray:
    """Powers of a base and of its inverse, from 0 to ``n`` at least."""
    if _powers[which].shape[1] <= n:
        base = _BASES[which]
        p = np.empty((2, 1 << n.bit_length()), np.uint64)
        p[0], p[1] = base, pow(base, -1, 1 << 64)
        p[:, 0] = 1
        _powers[which] = np.cumprod(p, 1)
    return _powers[which]


def word_hashes(raw: bytes, which: int = 0) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of anything but ASCII white space.

    Polynomial hashes from prefix sums, finalised, for all words of a piece at once; long words, on which such hashes are weak, by XXH3.
    ``which`` (0 or 1) names one of two independent hashes.
    """
    out = []
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and not _SPACE[raw[end]]:  # no word is cut
            end += 1
        out.append(_piece(raw, at, end, which))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def _piece(raw: bytes, at: int, end: int, which: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8, end - at, at)
    edge = np.empty(len(b) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~_SPACE[b]
    change = np.flatnonzero(edge[1:] != edge[:-1])
    first, last = change[::2], change[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    return hash_spans(raw, at, b, first, last, which)


def hash_spans(raw: bytes, at: int, b: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the spans [first, last) of the bytes ``b``, which are those of ``raw`` from ``at``."""
    power, inverse = _up_to(len(b), which)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * power[: len(b)], out=total[1:])
    length = last - first
    h = mix((total[last] - total[first]) * inverse[first], length.astype(np.uint64))
    long = np.flatnonzero(length >= _LONG)
    if len(long):
        from xxhash import xxh3_64_intdigest

        for i in long.tolist():
            h[i] = xxh3_64_intdigest(raw[at + int(first[i]) : at + int(last[i])], seed=which)
    return h
