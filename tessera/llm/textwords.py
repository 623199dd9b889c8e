"""Words and shingles of texts as 64-bit hashes, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(64)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _ODD(64)
_SALT = _ODD(64)
#: Two independent hashes of a word, each of polynomials modulo two primes below 2^31. (Modulo a power of two, words built by a rule collide at any base.)
_PRIMES = ((2147483647, 2147483629), (2147483587, 2147483579))
_BASES = tuple(tuple(int(x) for x in _RNG.integers(1 << 20, 1 << 30, 2)) for _ in _PRIMES)
#: What a byte counts; upper-case A-Z as lower case where they are folded.
_BYTE = np.arange(1, 257, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: So many products of a byte and a power add up to less than 2^64.
_ADDENDS = 1 << 24

#: Bytes of text that are hashed together.
SLICE = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finalizer of a common 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[tuple[int, int], np.ndarray] = {}
common.KEPT.append(_POWERS.clear)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The powers from 0 to ``n`` of ``base`` modulo ``prime``."""
    have = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(have) <= n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
    _POWERS[base, prime] = have
    return have


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: their starts and ends in ``data``, and each text's first word (one more at the end)."""
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray, fold: bool = True, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash, and each text's first word (one more at the end); ``fold``: A-Z as a-z."""
    starts, ends, first = bounds(data, at)
    return bytes_hash(data, starts, ends, fold, which), first


class Hasher:
    """Hashes of ranges of ``data``; ``which`` is 0 or 1. Ranges of any kind share the sums over the data."""

    def __init__(self, data: np.ndarray, fold: bool = True, which: int = 0):
        values, self.primes = (_FOLDED if fold else _BYTE)[data], _PRIMES[which]
        self.sums, self.down = [], []
        for base, prime in zip(_BASES[which], self.primes):
            terms = values * _powers(base, prime, len(data))[: len(data)]
            if len(data) > _ADDENDS:
                terms %= np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
            self.down.append(_powers(pow(base, -1, prime), prime, len(data)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for sums, down, prime in zip(self.sums, self.down, self.primes):
            p = np.uint64(prime)
            out = out << np.uint64(31) | (sums[ends] - sums[starts]) % p * down[starts] % p
        return mixed(out)


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, which: int = 0) -> np.ndarray:
    """The hash of each range of ``data``."""
    return Hasher(data, fold, which).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its shingles of ``width`` words (not yet distinct); of fewer words, all of them as one."""
    if len(words) >= width:
        runs = sum(words[k : len(words) - width + 1 + k] * _PLACE[k] for k in range(width))
        runs = mixed(runs)
    else:
        runs = words[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield runs[a : b - width + 1]
        elif b > a:
            yield mixed(np.sum(words[a:b] * _PLACE[: b - a], dtype=np.uint64)[None] + _SALT[b - a])
        else:
            yield words[:0]


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def shingle_sets(column: pa.Array, width: int, which: int = 0) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    data, at = common.utf8(column)
    for i, j in common.slices(at, SLICE):
        words, first = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i], which=which)
        yield from map(distinct, shingle_hashes(words, first, width))


def named_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Each text's distinct shingles, sorted, and two sums by which equal sets are known, of independent hashes of words."""
    data, at = common.utf8(column)
    for i, j in common.slices(at, SLICE):
        part, starts = data[at[i] : at[j]], at[i : j + 1] - at[i]
        each = (shingle_hashes(*word_hashes(part, starts, which=k), width) for k in (0, 1))
        for s, other in zip(*each):
            order = np.argsort(s)
            s = s[order]
            once = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            s = s[once]
            yield s, *(int(np.sum(x, dtype=np.uint64).astype(np.int64)) for x in (s, mixed(other[order[once]])))


def exact_shingles(a: str, b: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of two texts as numbers that are equal only for equal words; of fewer words, all of them as one."""
    words: dict[bytes, int] = {}
    lists = [x.encode().lower().split() for x in (a, b)]  # bytes: A-Z and ASCII white space only
    of = [np.array([words.setdefault(w, len(words) + 1) for w in ws], np.int64) for ws in lists]
    short = [len(x) < width for x in of]
    if any(short):
        if all(short):
            return tuple(np.array([0] if lists[0] == lists[1] else [k], np.int64)[: len(x)] for k, x in enumerate(of))
        return tuple(np.array([-1 - k], np.int64)[: len(x)] if s else distinct(_runs(x, width, len(words) + 1)[0]) for k, (s, x) in enumerate(zip(short, of)))
    n = len(of[0]) - width + 1
    names = _runs(np.concatenate(of), width, len(words) + 1)[0]
    return distinct(names[:n]), distinct(names[n + width - 1 :])


def _runs(x: np.ndarray, width: int, top: int) -> tuple[np.ndarray, int]:
    """A number for each run of ``width`` of the numbers ``x``, which are below ``top``."""
    names, most = x, top
    for k in range(1, width):
        if most * top >= 1 << 62:
            values, names = np.unique(names, return_inverse=True)
            most = len(values)
        names = names[:-1] * top + x[k:]
        most *= top
    return names, most
