"""A compressed full-text index of word sequences: suffix order, Burrows-Wheeler transform, wavelet tree.

The wavelet tree is kept level by level (a wavelet matrix): bits packed into
64-bit words with a running count for each word, so a rank is one popcount.
Suffixes are ordered by their first symbols only, more of them than the patterns
searched for have.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Windows of a text that are searched for one after another; pieces of so many go side by side.
PIECE = 64
_MASK = (U(1) << np.arange(64, dtype=U)) - U(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers in the order of their first ``depth`` symbols, by doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    h = 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        top = int(rank.max(initial=0)) + 1
        if top == n:
            break
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (top + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        rank = fresh
        h *= 2
    return order


class WaveletTree:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n = n = len(symbols)
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.count, self.zeros = [], [], []
        at = symbols.astype(np.int64)
        words = n // 64 + 1
        for level in range(self.levels - 1, -1, -1):
            bit = (at >> level) & 1 == 1
            padded = np.zeros(words * 64, bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(U)
            self.bits.append(packed)
            self.count.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(int(n - bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])
        first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=alphabet))]
        self.first = first[:-1].astype(np.int64)
        # Where each symbol's run begins after the last level's reordering.
        order = np.arange(alphabet, dtype=np.int64)
        begin = np.zeros(alphabet, np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, begin)
            begin = np.where((order >> level) & 1 == 1, self.zeros[k] + ones, begin - ones)
        self.begin = begin

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.count[k][word] + np.bitwise_count(self.bits[k][word] & _MASK[at & 63])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        begin = self.begin[symbol]
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at - begin


class FMIndex:
    """Index of texts (arrays of symbols from 1), each with an owner's rank, for patterns of up to ``longest`` symbols.

    ``least`` answers range minima over the suffix order, so a search can
    be held to texts of a smaller owner.
    """

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, alphabet: int, longest: int):
        lengths = np.array([len(t) + 1 for t in texts])
        text = np.zeros(int(lengths.sum()), np.int64)
        ends = np.cumsum(lengths)
        for t, end in zip(texts, ends.tolist()):
            text[end - 1 - len(t) : end - 1] = t
        order = suffix_order(text, longest + 1)
        self.text, self.order = text.astype(np.int32), order.astype(np.int32)
        self.tree = WaveletTree(text[order - 1], alphabet)
        self.total = len(text)
        self.owner = np.repeat(owners, lengths).astype(np.int32)[order]
        place = np.empty(self.total, np.int32)  # of each row by owner, then by position
        place[np.lexsort((self.order, self.owner))] = np.arange(self.total, dtype=np.int32)
        self.place, self.row = place, np.argsort(place).astype(np.int32)
        self.minima = [place]
        width = 1
        while 2 * width <= self.total:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The row of the least owner within each range, and of its rows the one that comes first in the text."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        return self.row[out]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """One step of backward search for many patterns: the ranges after putting a symbol in front."""
        n = len(symbol)
        r = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        first = self.tree.first[symbol]
        return first + r[:n], first + r[n:]


def covered(index: FMIndex, texts: list[np.ndarray], owners: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each text the stretches covered by ``window`` symbols in a row that a text of a smaller owner holds.

    All texts are searched together, in pieces of ``PIECE`` windows, a backward step at a time, from the end of a
    piece's first undecided window to its begin. A search that fails decides all windows that hold what was not found.
    One that succeeds is located in the text of the least owner, as early as it can be, and goes on there, symbol by
    symbol, so a long stretch is searched for once.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([max(0, len(t) - window + 1) for t in texts], np.int64)
    pieces = -(-sizes // PIECE)
    text = np.repeat(np.arange(len(texts)), pieces)
    first = PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(PIECE, sizes[text] - first) + window - 1
    flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
    base = np.r_[0, np.cumsum([len(t) for t in texts])][text] + first
    rank = np.asarray(owners)[text]
    stretches: list[list[tuple[int, int]]] = [[] for _ in text]
    start = np.zeros(len(text), np.int64)
    at = start + window
    lo, hi = np.zeros(len(text), np.int64), np.full(len(text), index.total, np.int64)
    live = np.arange(len(text))
    while len(live):
        symbol = flat[base[live] + at[live] - 1]
        new_lo, new_hi = index.extend(symbol, lo[live], hi[live])
        good = new_hi > new_lo
        some = np.flatnonzero(good)
        if len(some):
            good[some] = index.owner[index.least(new_lo[some], new_hi[some])] < rank[live[some]]
        lo[live], hi[live] = new_lo, new_hi
        at[live[good]] -= 1
        done = live[good & (at[live] == start[live])]
        if len(done):
            places = index.order[index.least(lo[done], hi[done])].tolist()
            for i, place in zip(done.tolist(), places):
                begin, end = int(start[i]), int(start[i]) + window
                rest = flat[base[i] + end : base[i] + length[i]]
                held = index.text[place + window : place + window + len(rest)]
                differ = np.flatnonzero(rest[: len(held)] != held)
                end += int(differ[0]) if len(differ) else len(held)
                stretches[i].append((begin, end))
                start[i] = end - window + 1
        failed = live[~good]
        start[failed] = at[failed]
        again = np.concatenate([done, failed])
        at[again] = start[again] + window
        lo[again], hi[again] = 0, index.total
        live = live[start[live] + window <= length[live]]
    for own, begin, spans in zip(text.tolist(), first.tolist(), stretches):
        for a, b in spans:
            if found[own] and found[own][-1][1] >= begin + a:
                found[own][-1] = (found[own][-1][0], begin + b)
            else:
                found[own].append((begin + a, begin + b))
    return found
