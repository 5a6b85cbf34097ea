"""Words, word hashes, n-gram hashes and minimisers of whole texts, on flat numpy arrays."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM = np.uint64(0xD1342543DE82EF95)

#: Bytes that separate words: `[^\x20\x09-\x0D]+` and, after lower-casing A-Z, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
BLANKS = [0x20, *range(0x09, 0x0E)]
SIGNS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def word_bytes(separators, lowered: bool) -> np.ndarray:
    """For each byte of a text, whether it belongs to a word (capitals are looked at in lower case)."""
    inside = np.ones(256, bool)
    inside[separators] = False
    return inside[LOWER] if lowered else inside


BLANK_WORDS = word_bytes(BLANKS, False)
LOWER_WORDS = word_bytes(SIGNS, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOCK = 1 << 16  # window starts whose sums are made together
SMALL = 1 << 14  # window starts whose hashes or minima stay in a core's cache
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse for i < n, modulo 2 ** 64; short tables are kept between calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 2 * BLOCK)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * BLOCK:
            _POWERS[int(base)] = have
    return have


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal sequences wherever they stand.

    Windows in the order of their starts are hashed block by block, as sums and powers take several times the room of the values.
    """
    if len(values) <= 2 * BLOCK or not len(starts) or (starts[1:] < starts[:-1]).any():
        return _window_hashes(values, starts, ends, base)
    cuts = np.unique(np.searchsorted(starts, np.arange(starts[0], starts[-1] + BLOCK + 1, BLOCK)))
    low, high = starts[cuts[:-1]], np.maximum.reduceat(ends, cuts[:-1])
    if (high - low).sum() > 2 * len(values):  # windows of many blocks
        return _window_hashes(values, starts, ends, base)
    out = np.empty(len(starts), np.uint64)
    for i, j, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), low.tolist(), high.tolist()):
        out[i:j] = _window_hashes(values[a:b], starts[i:j] - a, ends[i:j] - a, base)
    return out


def _window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and the n + 1 word offsets of the texts."""
    w = np.concatenate([[False], inside[data], [False]])
    edge = w[1:] != w[:-1]
    starts, ends = np.flatnonzero(edge & w[1:]), np.flatnonzero(edge & w[:-1])
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    joined = inner[w[inner] & w[inner + 1]]  # a text boundary inside a run of word bytes
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, offsets: np.ndarray, lowered: bool):
    """Word hashes, word starts and ends in bytes, and word offsets of the texts."""
    starts, ends, at = spans(data, offsets, LOWER_WORDS if lowered else BLANK_WORDS)
    return window_hashes(LOWER[data] if lowered else data, starts, ends, BASE), starts, ends, at


def inside_rows(at: np.ndarray, length: int) -> np.ndarray:
    """For each start of a window of `length` values, whether it ends inside the same row (offsets `at`)."""
    n = int(at[-1])
    ok = np.ones(n, bool)
    ok[:at[0]] = False
    counts = np.minimum(np.diff(at), length - 1)  # the last starts of each row
    ok[np.repeat(at[1:] - np.cumsum(counts), counts) + np.arange(counts.sum())] = False
    return ok[:max(n - length + 1, 0)]


def sized_hashes(values: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The hashes that `window_hashes` gives the windows of `length` values from each place, by doubling.

    A window's sum is that of its first part and, times a power of the base, that of the rest; parts are of 1, 2, 4 and so on values.
    """
    n = max(len(values) - length + 1, 0)
    out = np.empty(n, np.uint64)
    up = [np.uint64(pow(int(base), i, 1 << 64)) for i in range(length + 1)]
    for low in range(0, n, SMALL):
        m = min(SMALL, n - low)
        part = values[low:low + m + length - 1].astype(np.uint64)
        part += np.uint64(1)
        sums, done, size = np.zeros(m, np.uint64), 0, 1
        while True:
            if length & size:
                sums += part[done:done + m] * up[done]
                done += size
            if 2 * size > length:
                break
            more = part[size:] * up[size]
            more += part[:-size]
            part, size = more, 2 * size
        sums += np.uint64(length)
        out[low:low + m] = mix(sums)
    return out


def grams(values: np.ndarray, at: np.ndarray, length: int, base: np.uint64 = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of `length` values that lies in one row: start positions and hashes."""
    starts = np.flatnonzero(inside_rows(at, length))
    return starts, sized_hashes(values, length, base)[starts]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values (windows of 1, 2, 4 and so on, then two that overlap)."""
    n = len(values)
    if n < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:n - width + 1], values[width - size:width - size + n - width + 1])


PLACE = 24  # low bits of a gram's hash that make room for its place
CHUNK = 1 << 23  # window starts looked at together at most


def anchors(hashes: np.ndarray, positions: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of every window of `window` values: window starts, and for each the index into `hashes`.

    `hashes[i]` is the hash of the `gram` values from `positions[i]`. The smallest hash without its PLACE low bits counts, ties go to the
    leftmost one: a choice that depends on nothing but the window, so equal windows have their minimiser at the same place in every shard.
    """
    n, few = int(at[-1]), window - gram + 1
    place, starts = np.uint64(PLACE), np.flatnonzero(inside_rows(at, window))
    chosen, chunk = np.zeros(len(starts), np.int64), min(CHUNK, max(SMALL, 8 * few))
    for low in range(0, n, chunk):
        high = min(n, low + chunk + few - 1)
        a, b = np.searchsorted(positions, [low, high])
        first, last = np.searchsorted(starts, [low, low + chunk])
        if first == last:
            continue
        full = np.full(high - low, np.iinfo(np.uint64).max, np.uint64)
        full[positions[a:b] - low] = (hashes[a:b] >> place << place) | np.arange(b - a, dtype=np.uint64)
        least = sliding_min(full, few)[starts[first:last] - low]
        chosen[first:last] = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64) + a
    return starts, chosen


def runs(starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows with the same minimiser: first start, last start, minimiser."""
    if not len(starts):
        return starts, starts, chosen
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1], chosen[new]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions below n that lie in any [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, ends, 1)
    return np.cumsum(steps[:n]) > 0
