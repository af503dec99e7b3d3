"""FM-index over the word ids of one shard: suffix order, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions of all suffixes of ``text`` in order; a suffix that is a prefix of another comes first.

    Prefix doubling: the first key holds as many symbols as fit, then only suffixes that
    still tie are sorted again by the rank of what follows.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    width = max(1, 60 // (bits + 1))
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        part = np.zeros(n, dtype=np.int64)
        if k < n:
            part[: n - k] = text[k:].astype(np.int64) + 1
        key = (key << (bits + 1)) | part
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.empty(n, dtype=bool)
    head[0] = True
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    span = width
    while True:
        # Slots whose group has more than one member; their groups are contiguous.
        lone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~lone)
        if len(slots) == 0:
            return order
        sfx = order[slots]
        nxt = np.where(sfx + span < n, rank[np.minimum(sfx + span, n - 1)] + 1, 0)
        group = rank[sfx]
        by = np.lexsort((nxt, group))
        sfx, nxt, group = sfx[by], nxt[by], group[by]
        order[slots] = sfx
        new = np.empty(len(slots), dtype=bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        head[slots] = new
        rank[sfx] = np.maximum.accumulate(np.where(new, slots, 0))
        span *= 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit plane per level."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (cur >> level) & 1
            count = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(int(len(cur) - count[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``, for arrays of both."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, zeros + lo1, lo - lo1)
            hi = np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        symbol = np.zeros_like(at)
        lo, pos = np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros):
            bit = (ones[pos + 1] - ones[pos]).astype(bool)
            symbol = (symbol << 1) | bit
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            pos = np.where(bit, zeros + ones[pos], pos - ones[pos])
        return symbol, pos - lo


class FMIndex:
    """Finds phrases of word ids in ``text``; ids run from 0 to ``alphabet`` - 1."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8) -> None:
        bits = max(1, int(alphabet).bit_length())
        # One more symbol, 0, ends the text, so that every suffix has a symbol before it.
        full = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_order(full, bits)
        bwt = full[order - 1]
        self.n = len(full)
        self.wavelet = WaveletMatrix(bwt, bits)
        self.before = np.zeros((1 << bits) + 1, dtype=np.int64)
        np.cumsum(np.bincount(full, minlength=1 << bits), out=self.before[1:])
        kept = order % sample == 0
        self.kept_count = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(kept, out=self.kept_count[1:])
        self.kept_at = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (rows): the range of suffixes that begin with each."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k].astype(np.int64) + 1
            lo = self.before[symbol] + self.wavelet.rank(symbol, lo)
            hi = self.before[symbol] + self.wavelet.rank(symbol, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffix slots, by stepping back to the next sampled position."""
        out = np.empty(len(slots), dtype=np.int64)
        live, at, steps = np.arange(len(slots)), slots.astype(np.int64), 0
        while len(live):
            sampled = self.kept_count[at + 1] > self.kept_count[at]
            out[live[sampled]] = self.kept_at[self.kept_count[at[sampled]]] + steps
            live, at = live[~sampled], at[~sampled]
            if len(live):
                symbol, count = self.wavelet.access_rank(at)
                at = self.before[symbol] + count
                steps += 1
        return out
