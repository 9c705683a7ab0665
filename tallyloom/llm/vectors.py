"""Words and their hashes for whole batches of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer word is hashed in one piece all the same.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

# Letters A-Z become lower case, ASCII punctuation and white space become a blank.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _a, _b in ((0, 48), (58, 65), (91, 97), (123, 128)):
    _PLAIN[_a:_b] = 32


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        x = np.full(max(n, PIECE + 1), base, np.uint64)
        x[0] = 1
        have = _powers[name] = np.multiply.accumulate(x)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes | None], table: np.ndarray = _PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, text it is in, its first byte there, the byte after it). table maps bytes; words are what blanks (32) part."""
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b" " + b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    data = table[data]
    data[first] = 32  # before, between and after the texts
    full = data != 32
    edges = np.flatnonzero(full[1:] != full[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, hi - lo), out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = (sums[e] - sums[s]) * _power("inverse", _INVERSE, hi - lo + 1)[s]
        a = b
    owner = np.searchsorted(first, starts, "right") - 1
    return mix(hashes), owner, starts - first[owner] - 1, ends - first[owner] - 1


def word_counts(texts: list[bytes | None], table: np.ndarray = _PLAIN) -> np.ndarray:
    """The number of words of each text, as word_hashes parts them."""
    first = np.concatenate([[0], np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))])
    full = table[np.frombuffer(b" " + b" ".join([t or b"" for t in texts]) + b" ", np.uint8)] != 32
    full[first] = False
    starts = np.flatnonzero(full[1:] & ~full[:-1]) + 1
    return np.diff(np.searchsorted(starts, first))


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words in one text, number of its first word)."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(_BASE) + words[i : i + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(h[at]), at


def same_runs(values: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of so many values from places one and from later places two are the same, told by 64-bit sums."""
    power = _power("base", _BASE, len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power)])
    return (sums[one + size] - sums[one]) * power[two - one] == sums[two + size] - sums[two]
