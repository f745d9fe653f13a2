"""A suffix array to a bounded depth by two-stage sorting, in numpy.

A suffix is of type B if it is smaller than its successor, else of type A. Only B suffixes are sorted directly. One scan over the
buckets of first symbols then places each A suffix behind its already placed successor: within a bucket all A suffixes stand before all
B suffixes, in the order in which the scan meets their successors. Order beyond ``depth`` symbols is left open, which is enough
to bring suffixes together that share that many.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import powers, prefix_hash

_CODE = np.random.default_rng(77).integers(1, 1 << 64, 257, dtype=np.uint64)
_SYMBOLS_IN_WORD = 7


def _words(t: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from each place on, as one number in the same order."""
    one = t.astype(np.int64)
    two = one[:-1] << 9 | one[1:]
    four = two[:-2] << 18 | two[2:]
    six = four[:-2] << 18 | two[4 : len(four) + 2]
    return six[:-1] << 9 | one[6 : len(six) + 5]


def is_smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type B; the last is not."""
    rise = np.sign(np.diff(t.astype(np.int16), append=-1)).astype(np.int8)
    places = np.where(rise != 0, np.arange(len(t)), len(t) - 1)
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    return rise[nearest] > 0


class _Text:
    """Symbols with room behind them, and hashes of any span."""

    def __init__(self, t: np.ndarray, depth: int) -> None:
        self.n, self.depth = len(t), depth
        self.t = np.concatenate([t.astype(np.int16), np.zeros(depth + 8, np.int16)])
        self.words = _words(self.t)
        self.prefix = prefix_hash(_CODE[self.t])
        self.un = powers(len(self.prefix) + 1)[1]

    def span(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.un[at]

    def common(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, of which ``least`` symbols are known to agree; ``depth`` at most."""
        before_a, before_b, of_a, of_b = self.prefix[a], self.prefix[b], self.un[a], self.un[b]
        whole = (self.prefix[a + self.depth] - before_a) * of_a == (self.prefix[b + self.depth] - before_b) * of_b
        out = np.where(whole, self.depth, least)
        left = np.flatnonzero(~whole)
        a, b, before_a, before_b, of_a, of_b = a[left], b[left], before_a[left], before_b[left], of_a[left], of_b[left]
        low, high = least[left], np.full(len(left), self.depth)  # low agrees, high does not
        for _ in range(int(self.depth).bit_length()):
            middle = (low + high) >> 1
            same = (self.prefix[a + middle] - before_a) * of_a == (self.prefix[b + middle] - before_b) * of_b
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        out[left] = low
        return out


def _sort_directly(text: _Text, suffixes: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols: by words, each group of equals going on where its members part."""
    words = text.words[suffixes]
    order = np.argsort(words, kind="stable")
    out, words = suffixes[order], words[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = words[1:] != words[:-1]
    slots, depth = np.arange(len(out)), np.full(len(out), _SYMBOLS_IN_WORD)
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(new))
        tied = np.repeat(sizes > 1, sizes)
        slots, depth, new = slots[tied], depth[tied], new[tied]
        if not len(slots):
            return out
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(new))
        own = out[slots]
        depth = np.minimum(depth, text.depth)
        # groups whose next words differ part here; only of the others it takes a search to know where they part
        words = text.words[own + depth]
        alike = np.repeat(np.minimum.reduceat(words, starts) == np.maximum.reduceat(words, starts), sizes)
        shared = depth.copy()
        shared[alike] = text.common(own[alike], np.repeat(own[starts], sizes)[alike], depth[alike])
        parting = np.repeat(np.minimum.reduceat(shared, starts), sizes)
        open_ = parting < text.depth
        if not open_.any():
            return out
        group = np.repeat(np.arange(len(starts)), sizes)[open_]
        slots, own, depth = slots[open_], own[open_], parting[open_]
        words = text.words[own + depth]
        order = np.lexsort((words, group))
        out[slots] = own[order]
        words, group = words[order], group[order]
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (words[1:] != words[:-1]) | (group[1:] != group[:-1])
        depth = depth + _SYMBOLS_IN_WORD


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, _Text]:
    """Suffixes of the symbols (0 to 256) in the order of their first ``depth`` symbols: all, or the wanted ones (a mask).

    To place a wanted A suffix its successors up to the next B suffix are needed, so those are placed and returned too; others are not.
    """
    text = _Text(t, depth)
    smaller = is_smaller_than_next(t)
    placing = np.ones(len(t), dtype=bool)
    if wanted is not None:
        # a place is needed if it is wanted, or if a wanted one lies before it with no B suffix from there up to just before it
        last_wanted = np.maximum.accumulate(np.where(wanted, np.arange(len(t)), -1))
        last_smaller = np.maximum.accumulate(np.where(smaller, np.arange(len(t)), -1))
        placing = wanted | ((last_wanted >= 0) & (np.concatenate([[-1], last_smaller[:-1]]) < last_wanted))
    direct = _sort_directly(text, np.flatnonzero(smaller & placing))
    symbol = t[direct]
    bounds = np.searchsorted(symbol, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    placed: list[np.ndarray] = []

    def scan(found: np.ndarray, bucket: int) -> np.ndarray:
        """Hands the A suffixes before some placed ones to their buckets; returns those of this bucket."""
        before = found - 1
        before = before[before >= 0]
        before = before[~smaller[before] & placing[before]]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first, prepend=-1, append=-1)) if len(first) else []
        here = before[:0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if first[i] == bucket:
                here = before[i:j]
            else:
                waiting[first[i]].append(before[i:j])
        return here

    last = len(t) - 1  # its successor is the empty suffix, which stands before all
    if last >= 0 and placing[last]:
        waiting[t[last]].append(np.array([last]))
    for bucket in range(257):
        current = np.concatenate(waiting[bucket]) if waiting[bucket] else direct[:0]
        waiting[bucket] = []
        while len(current):
            placed.append(current)
            current = scan(current, bucket)
        own = direct[bounds[bucket] : bounds[bucket + 1]]
        placed.append(own)
        scan(own, bucket)
    return np.concatenate(placed) if placed else direct, text


def repeated_windows(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece, which of its ``window``-byte strings (by start) stand in another place of these pieces too."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    t = raw.astype(np.int16) + 1
    t[starts + sizes] = 0
    whole = np.zeros(len(t) + 1, dtype=np.int64)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= window:
            whole[a] += 1
            whole[a + n - window + 1] -= 1
    whole = np.cumsum(whole)[:-1] > 0
    order, text = suffix_array(t, window, whole)
    order = order[whole[order]]
    repeated = np.zeros(len(t), dtype=bool)
    if len(order) > 1:
        same = text.common(order[:-1], order[1:], np.zeros(len(order) - 1, dtype=np.int64)) >= window
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
    return [repeated[a : a + max(0, n - window + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
