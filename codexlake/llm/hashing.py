"""Word segmentation and 64-bit word hashes of whole batches of texts, vectorised in numpy.

A word's hash is a polynomial in tabulated random byte values, taken from prefix
sums modulo 2**64, then mixed; so one pass over the bytes serves all words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_Q = U(0xD6E8FEB86659FD93)
_BYTE = np.random.RandomState(20240607).randint(0, 1 << 62, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}

#: White space as the contracts name it: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Anything in ASCII that is neither letter nor digit; bytes of longer code points count as letters.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, U(base), U)
        steps[0] = U(1)
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Starts and ends of all words in bytes, and the n+1 word offsets of the documents."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    sp = gap[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = sp[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[first] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = sp[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    starts = np.flatnonzero(before & ~sp)
    ends = np.flatnonzero(after & ~sp) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    n = len(data)
    sums = np.empty(n + 1, U)
    sums[0] = U(0)
    np.cumsum(_BYTE[data] * _power("r", _R, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("i", _R_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, lower: bool = False):
    """Hashes of all words and the n+1 word offsets of the documents."""
    if lower:
        data = LOWER[data]
    starts, ends, words = word_spans(data, offsets, gap)
    return span_hashes(data, starts, ends), words


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, by first word; runs that cross documents are the caller's to leave out."""
    if len(h) < k:
        return np.empty(0, U)
    out = h[: len(h) - k + 1] + U(k)
    for j in range(1, k):
        out = out * _Q + h[j : len(h) - k + 1 + j]
    return mix(out)


def fold(h: np.ndarray, seed: int) -> int:
    """One hash of a whole sequence of hashes."""
    n = len(h)
    with np.errstate(over="ignore"):
        total = (mix(h ^ U(seed)) * _power("q", int(_Q), n)).sum(dtype=U) if n else U(0)
        return int(mix(np.array([total + U(n) * U(0x9E3779B97F4A7C15) + U(seed)], U))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
