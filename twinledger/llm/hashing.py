"""Vectorized hashing of words in whole texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.default_rng(20240229)
_BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, _PIECE + 1024), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end after white space, so that memory stays bounded."""
    start = 0
    while len(data) - start > _PIECE:
        part = np.frombuffer(data, np.uint8, count=_PIECE, offset=start)
        ends = np.flatnonzero(_IS_SPACE[part])
        if not len(ends):  # one word longer than a piece
            rest = np.frombuffer(data, np.uint8, offset=start)
            ends = np.flatnonzero(_IS_SPACE[rest])[:1]
            if not len(ends):
                break
        cut = start + int(ends[-1]) + 1
        yield data[start:cut]
        start = cut
    yield data[start:]


def _words(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a buffer."""
    if lower:
        buf = _LOWER[buf]
    space = np.concatenate(([True], _IS_SPACE[buf], [True]))
    change = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = change[0::2], change[1::2]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * _power(_BASE, len(buf)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(buf) + 1)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts, ends


def batches(texts: list[str | None], size: int = _PIECE) -> Iterator[list[int]]:
    """Numbers of consecutive texts of about ``size`` characters together."""
    group, total = [], 0
    for i, text in enumerate(texts):
        group.append(i)
        total += len(text or "") + 1
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def word_hashes(texts: list[str | None], lower: bool = True) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words in order; null and blank texts have none.

    Words are runs of bytes other than blank and \\t to \\r; ``lower`` folds A-Z only.
    """
    for group in batches(texts):
        data = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in group]
        if len(data) == 1:
            yield np.concatenate([_words(np.frombuffer(p, np.uint8), lower)[0] for p in _pieces(data[0])])
            continue
        hashes, starts, _ = _words(np.frombuffer(b" ".join(data), np.uint8), lower)
        limits = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data])[:-1])
        yield from np.split(hashes, limits)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n`` consecutive words; the whole sequence as one if it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = mixed(words[: len(words) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mixed(out * np.uint64(3) + words[i : len(words) - n + 1 + i])
    return np.unique(out)
