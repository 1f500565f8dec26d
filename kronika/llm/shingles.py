"""Distinct word shingles of texts as 64-bit hashes, and MinHash signatures of such sets."""

from __future__ import annotations

import numpy as np

#: Fixed seeds of all hashing here.
_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
JOIN = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE[SPACE] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), A-Z in lower case, words split at white space."""
    data = [t.encode().lower() for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    buffer = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = SPACE[buffer]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.flatnonzero(space & np.append(False, ~space[:-1])) - starts
    gaps = np.diff(np.append(starts, len(buffer)))
    place = np.arange(starts[0], len(buffer)) - np.repeat(starts, gaps)
    power = powers(STEP, int(lengths.max()) + 1)
    value = BYTE[buffer[starts[0] :]] * power[np.minimum(place, len(power) - 1)]
    words = mixed(np.add.reduceat(value, starts - starts[0]) + lengths.astype(np.uint64))
    return words, np.searchsorted(np.cumsum(sizes), starts, "right")


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, sorted; with fewer words all of them as one."""
    words, owner = word_hashes(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(len(words) - width + 1, 0)
    every = np.zeros(n, np.uint64)
    for i in range(width):
        every = every * JOIN + words[i : i + n]
    every = mixed(every)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = whole * JOIN + w
            out.append(mixed(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhash(hashes: np.ndarray, n: int = 64) -> np.ndarray:
    """``n`` minima over seeded linear maps of the upper half of each hash."""
    rng = np.random.default_rng(n)
    a = rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[i : i + 2048, None] * a + b).min(0))
    return least
