"""Vectorised 64-bit hashes of words and word shingles, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: the ASCII white space.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FOLDED = _OF_BYTE[LOWER]


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def power(n: int) -> int:
    """The base to the n, modulo 2 to the 64."""
    return pow(_BASE, n, 1 << 64)


def table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for n positions; one table serves all usual blocks."""
    return powers(max(BLOCK, 1 << int(max(n, 1) - 1).bit_length()))


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z folded) of texts at bounds, and where each text's words begin.

    Works in blocks that end at white space, so memory follows the block and not the text.
    """
    n, at, starts, hashes = len(data), 0, [], []
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    while at < n:
        to = min(n, at + BLOCK)
        while to < n:  # a block never ends inside a word
            gap = np.flatnonzero(BLANK[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
                break
            to = min(n, to + BLOCK)
        part, cut = data[at:to], edge[at : to + 1]
        keep = ~BLANK[part]
        first, last = keep.copy(), keep.copy()
        first[1:] &= cut[1:-1] | ~keep[:-1]
        last[:-1] &= cut[1:-1] | ~keep[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        up, down = table(to - at)
        terms = _FOLDED[part]
        terms *= up[: to - at]
        total = np.cumsum(terms)
        hashes.append(mix((total[e] - total[s] + terms[s]) * down[s]))
        starts.append(s + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(start, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; with fewer words than size, of the whole sequence."""
    words, at = hash_words(data, bounds)
    weights, lengths = constants(11, size), constants(12, size)
    n = max(0, len(words) - size + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(size):
        grams += words[j : j + n] * weights[j]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + lengths[b - a : b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray], k: int, seed: int = 21, block: int = 1 << 16) -> np.ndarray:
    """A row of k minima for each set; an empty set's row is all ones."""
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    times, plus = constants(seed, k), constants(seed + 1, k)
    full = [i for i, x in enumerate(sets) if len(x)]
    a = 0
    while a < len(full):
        b, size = a, 0
        while b < len(full) and (b == a or size + len(sets[full[b]]) <= block):
            size += len(sets[full[b]])
            b += 1
        own = full[a:b]
        values = np.concatenate([sets[i] for i in own])
        offsets = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])[:-1]]).astype(np.int64)
        scratch = np.empty_like(values)
        for j in range(k):
            np.multiply(values, times[j], out=scratch)
            np.add(scratch, plus[j], out=scratch)
            out[own, j] = np.minimum.reduceat(scratch, offsets)
        a = b
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, in which the band's number is hashed too."""
    weights = constants(31, rows)
    picked = minima[:, : bands * rows].reshape(len(minima), bands, rows)
    keys = (picked * weights).sum(axis=2, dtype=np.uint64) + constants(32, bands)
    return mix(keys).view(np.int64)


def set_digest(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two signed longs."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, x in enumerate(sets):
        out[i, 0] = mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
        out[i, 1] = mix(x ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)
    return mix(out).view(np.int64)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def like_pairs(sets: list[np.ndarray], percent: int, cells: int = 1 << 22) -> np.ndarray:
    """Matrix of which pairs of sorted sets have a Jaccard similarity of at least percent, exactly; an empty set is like none.

    Values that two sets share are the columns of a 0-1 matrix, whose product with itself counts intersections; it is made
    in runs of columns, so memory follows cells and not the number of values.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float64)
    both = np.zeros((n, n), np.float32)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, total = max(1, cells // max(n, 1)), int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, width):
        first, last = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, min(width, total - a)), np.float32)
        part[owner[first:last], column[first:last] - a] = 1
        both += part @ part.T
    full = sizes > 0
    return (100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & full[:, None] & full[None]
