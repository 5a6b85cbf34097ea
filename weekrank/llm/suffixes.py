"""Suffix arrays by Larsson-Sadakane refinement, common prefixes by Kasai's rule, and an FM-index, all in numpy."""

from __future__ import annotations

import numpy as np

WORD = 8


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number in text order; past the end they are 0."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(WORD):
        out |= padded[i:i + len(data)] << np.uint64(8 * (WORD - 1 - i))
    return out


def suffix_array(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and its inverse; `keys[i]` orders the first `depth` symbols of suffix i.

    Groups of suffixes that agree so far are refined by the rank of the suffix `depth` further on; the depth
    doubles. Suffixes that are already alone in their group are not touched again.
    """
    n = len(keys)
    order = np.argsort(keys)  # in any order inside a group, as in the end every suffix is alone
    rank = np.zeros(n, np.int64)  # the first place of the group + 1
    if not n:
        return order, rank
    first = np.concatenate([[True], np.diff(keys[order]) != 0])
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0)) + 1
    alone = first & np.append(first[1:], True)
    slots = np.flatnonzero(~alone)
    shift = np.int64(int(2 * n + 1).bit_length())
    while len(slots):
        at = order[slots]
        further = at + depth
        second = np.where(further < n, n + rank[np.minimum(further, n - 1)], n - at)  # the shorter one first
        both = (rank[at] << shift) | second
        by = np.argsort(both, kind="stable")  # nearly in order already, which a stable sort makes use of
        at, both = at[by], both[by]
        order[slots] = at
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        single = new & np.append(new[1:], True)
        slots = slots[~single]
        depth *= 2
    return order, rank - 1


def _same_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading bytes in which two packed words agree, from their exclusive or: the exponent of its highest bit as a double."""
    top = (differ & ~(differ >> np.uint64(1))).astype(np.float64)  # without the bit below, so that rounding cannot carry
    return np.minimum((1086 - (top.view(np.int64) >> 52)) >> 3, WORD)


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, most: int, lanes: int = 128) -> np.ndarray:
    """Bytes, up to `most`, that each suffix shares with the one before it in `order`.

    Kasai's rule (a suffix shares at least one byte less than the suffix one earlier in the text) is followed in
    many stretches of the text at once: step k looks at the k-th position of every stretch.
    """
    n = len(data)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    words = packed(np.concatenate([data, np.zeros(most + WORD, np.uint8)]))
    length = max(1, min(lanes, n))
    starts = np.arange(0, n, length)
    shared = np.zeros(len(starts), np.int64)
    for step in range(length):
        at = starts + step
        live = at < n
        at = np.where(live, at, 0)
        where = place[at]
        live &= where > 0
        before = order[np.maximum(where - 1, 0)]
        shared = np.maximum(shared - 1, 0)
        shared[~live] = 0
        going = np.flatnonzero(live & (shared < most))
        while len(going):
            i, j = at[going] + shared[going], before[going] + shared[going]
            more = np.minimum(_same_bytes(words[i] ^ words[j]), n - np.maximum(i, j))
            shared[going] += more
            going = going[(more == WORD) & (shared[going] < most)]
        np.minimum(shared, most, out=shared)
        out[where[live]] = shared[live]
    return out


class FMIndex:
    """Burrows-Wheeler index of a symbol array: counts and places of phrases by backward search.

    Ranks come from a wavelet tree whose levels are stored as prefix counts of one bit each; places come from
    suffix positions kept at every `sample`-th text position. Symbols are from 1 up; 0 is kept for the end.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        text = np.concatenate([text, [0]]).astype(np.int64)
        self.n, self.sample = len(text), sample
        order, _ = suffix_array(text.astype(np.uint64), 1)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.bits = max(int(symbols).bit_length(), 1)
        self.ones, self.zeros = [], []
        row = last
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.last = last
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `upto` rows of the last column."""
        start, end = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the phrases (one per line, the last symbol in the last column): numbers, first and last row."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        found = []
        width = phrases.shape[1] if len(phrases) else 0
        for step in range(width):
            done = lengths[which] == step
            if done.any():
                found.append((which[done], low[done], high[done]))
                which, low, high = which[~done], low[~done], high[~done]
            symbol = phrases[which, width - 1 - step]
            low = self.before[symbol] + self.rank(symbol, low)
            high = self.before[symbol] + self.rank(symbol, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        found.append((which, low, high))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def locate(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Text positions of all rows in the ranges: walk back to a kept suffix."""
        counts = high - low
        rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        out, steps, going = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(going):
            at = rows[going]
            here = self.kept[at + 1] > self.kept[at]
            out[going[here]] = self.places[self.kept[at[here]]] + steps
            going, at = going[~here], at[~here]
            symbol = self.last[at]
            rows[going] = self.before[symbol] + self.rank(symbol, at)
            steps += 1
        return out
