"""Numpy part of the repeated-substring operator: q-gram buckets and their refinement inside one document."""

from __future__ import annotations

import numpy as np

#: Bytes of a match, unless told otherwise. Initial buckets have an eighth of them and are doubled three times.
LENGTH = 400
_LOW = (1 << 24) - 1
#: Documents are scanned in pieces of this many match starts, so positions fit the low bits.
PIECE = 1 << 23

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


_POW, _INV = np.empty(0, np.uint64), np.empty(0, np.uint64)


def mix(a: np.ndarray, b) -> np.ndarray:
    """Identifier of a pair of identifiers."""
    x = (a ^ (a >> np.uint64(29))) * _M1 + b
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(30))


def span_of(length: int) -> int:
    """Consecutive q-grams of which one is the anchor: a match holds exactly this many."""
    return length - length // 8 + 1


def qgram_buckets(data: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifier of the ``q`` bytes from each position."""
    global _POW, _INV
    n = len(data)
    if len(_POW) < n:
        _POW, _INV = _powers(_R, 2 * n), _powers(_RINV, 2 * n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _POW[:n], out=sums[1:])
    x = (sums[q:] - sums[:-q]) * _INV[:n - q + 1]
    x ^= x >> np.uint64(31)
    x *= _M3
    x ^= x >> np.uint64(29)
    return x


def bucket_at(ids: np.ndarray, at: np.ndarray, depth: int, q: int) -> np.ndarray:
    """Identifiers of the ``depth`` bytes (``q`` times a power of two) from the given positions: the pair of identifiers
    of the two halves, recursively."""
    if depth == q:
        return ids[at]
    half = depth // 2
    return mix(bucket_at(ids, at, half, q), bucket_at(ids, at + half, half, q))


def string_at(ids: np.ndarray, start: np.ndarray, size: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of strings of q to 16 * q bytes: the deepest bucket at the start and the one that ends with them."""
    out = np.empty(len(start), np.uint64)
    depth = np.where(size >= 8 * q, 8 * q, np.where(size >= 4 * q, 4 * q, np.where(size >= 2 * q, 2 * q, q)))
    for d in (q, 2 * q, 4 * q, 8 * q):
        some = np.flatnonzero(depth == d)
        if len(some):
            a, n = start[some], size[some]
            out[some] = mix(mix(bucket_at(ids, a, d, q), n.astype(np.uint64)), bucket_at(ids, a + n - d, d, q))
    return out


def anchor_ranges(ids: np.ndarray, n_starts: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, lo, hi: match starts lo..hi whose least q-gram (of ``span``, rightmost on ties) is at ``anchor``."""
    out = []
    for at in range(0, n_starts, PIECE):
        stop = min(n_starts, at + PIECE)
        part = ids[at:stop + span - 1]
        key = (part & ~np.uint64(_LOW)) | (np.uint64(_LOW) - np.arange(len(part), dtype=np.uint64))
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
        edge = np.flatnonzero(key[1:] != key[:-1])
        lo = np.concatenate([[0], edge + 1])
        hi = np.concatenate([edge, [len(key) - 1]])
        anchor = _LOW - (key[lo] & np.uint64(_LOW)).astype(np.int64)
        out.append((anchor + at, lo + at, hi + at))
    return tuple(np.concatenate(x) for x in zip(*out))
