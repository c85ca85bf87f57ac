"""Word and shingle hashes of a text as numpy arrays, and DartMinHash signatures over them."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_PLACE = mix((np.arange(4096, dtype=np.uint64) + np.uint64(1001)) * _ODD) | np.uint64(1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a block of about BLOCK bytes at a time."""
    out, a = np.empty(len(starts), dtype=np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK)))
        low, size = starts[a], ends[a:b] - starts[a:b]
        at = np.arange(int(ends[b - 1] - low))
        first = np.repeat(starts[a:b] - low, np.diff(np.append(starts[a:b], ends[b - 1])))
        place = at - first
        power = _PLACE[place] if size.max() < 4000 and place.max() < 4096 else mix((place.astype(np.uint64) + np.uint64(1001)) * _ODD) | np.uint64(1)
        chunk = data[low : ends[b - 1]]
        value = np.where(_SPACE[chunk], np.uint64(0), _BYTE[chunk] * power)
        out[a:b] = mix(np.add.reduceat(value, starts[a:b] - low) + size.astype(np.uint64))
        a = b
    return out


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of so many words; a shorter text with a word is one run."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(data, *word_bounds(data))
    n = min(words, len(w))
    if not n:
        return w
    runs = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for j in range(n):
        runs = runs * _ODD + w[j : len(w) - n + 1 + j]
    return np.unique(mix(runs + np.uint64(n)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signature(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: k 64-bit values, of which two weighted sets share each with probability their weighted Jaccard.

    An element of weight w owns a region w high; every unit of its height is a cell. Darts hit a cell at the times of
    a Poisson process that a hash of the cell fixes, each at a hashed height and coordinate; a dart above the top of
    the region misses. Only darts earlier than a deadline are thrown, which expects k (ln k + 2) hits in all, so an
    element of a large set seldom throws one; if a coordinate stays empty, the deadline is doubled. The earliest dart
    of each coordinate is kept."""
    if weights is None:
        cells, top = elements, None
        total = float(len(elements))
    else:
        height = np.ceil(weights).astype(np.int64)
        cells = np.repeat(elements, height)
        level = np.arange(len(cells)) - np.repeat(np.cumsum(height) - height, height)
        cells = mix(cells + level.astype(np.uint64) * _ODD)
        top = np.minimum(1.0, np.repeat(weights, height) - level)
        total = float(weights.sum())
    deadline = k * (np.log(k) + 2) / total
    while True:
        when, who, where = np.zeros(len(cells)), np.arange(len(cells)), []
        ids, ranks, turn = [], [], 0
        while len(who):
            turn += 1
            dart = mix(cells[who] ^ np.uint64(turn * int(_ODD) % 2**64))
            when = when - np.log(_uniform(dart))
            alive = when < deadline
            when, who, dart = when[alive], who[alive], dart[alive]
            other = mix(dart + _ODD)
            hit = slice(None) if top is None else _uniform(mix(other + _ODD)) < top[who]
            ids.append(dart[hit])
            ranks.append(when[hit])
            where.append((other[hit] % np.uint64(k)).astype(np.int64))
        ids, ranks, where = np.concatenate(ids), np.concatenate(ranks), np.concatenate(where)
        order = np.argsort(-ranks, kind="stable")
        out, seen = np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=bool)
        out[where[order]] = ids[order]
        seen[where] = True
        if seen.all():
            return out
        deadline *= 2


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of equally many signature values."""
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for j in range(rows.shape[1]):
        key = key * _ODD + rows[:, j]
    return mix(key).view(np.int64)
