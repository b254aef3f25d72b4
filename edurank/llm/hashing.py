"""Vectorised 64-bit hashes of many byte ranges of one buffer."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _WHITE[data]


def mixed(value: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well spread unsigned 64-bit number for each unsigned 64-bit number."""
    out = value + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


class RangeHasher:
    """Hashes of byte ranges by prefix sums of a polynomial modulo 2**64, for features.

    Equal byte strings have equal hashes wherever they lie.  Unequal ones may be
    built to collide whatever the base, so this does not tell texts apart:
    :func:`word_hashes` and :class:`SequenceHasher` do.
    """

    def __init__(self, seed: int) -> None:
        self.symbols = mixed(np.arange(1, 257, dtype=np.uint64), 2 * seed)
        self.base = int(mixed(np.array([seed], np.uint64), 2 * seed + 1)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) >= size:
            return
        for name, base in (("powers", self.base), ("inverses", self.inverse)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate((table, table * np.uint64(pow(base, len(table), 1 << 64))))
            setattr(self, name, table)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbols[data] * self.powers[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])


# Longer words are hashed one by one.
_SHORT = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes of all ranges at a time; every step mixes what came before."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mixed(size.astype(np.uint64), salt)
    open_, at = np.flatnonzero((size > 0) & (size <= _SHORT)), 0
    while len(open_):
        left = size[open_] - at
        part = eight[starts[open_] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[open_] = mixed(out[open_] ^ part, salt)
        open_, at = open_[left > 8], at + 8
    for i in np.flatnonzero(size > _SHORT):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), salt)
    return out


PRIME = (1 << 61) - 1
_P, _HALF = np.uint64(PRIME), np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo 2**61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return x - _P * (x >= _P)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reduced numbers modulo 2**61 - 1, from 31-bit halves: 2**61 counts as 1."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _HALF, b >> np.uint64(31), b & _HALF
    middle = a_low * b_high + a_high * b_low
    upper = np.uint64(2) * a_high * b_high + (middle >> np.uint64(30))
    return _reduced(upper + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a_low * b_low)


class SequenceHasher:
    """Hashes of sequences of words: polynomials of the words' hashes modulo the prime 2**61 - 1, by prefix sums.

    Equal sequences have equal hashes wherever they stand.  Two unequal ones of n
    words share theirs for at most n of the 2**61 bases, if no two words share a
    hash; each seed has a base and hashes of words of its own.
    """

    def __init__(self, seed: int) -> None:
        drawn = int.from_bytes(hashlib.blake2b(f"base {seed}".encode(), digest_size=8).digest(), "little")
        self.seed, self.base = seed, (1 << 40) + drawn % (PRIME - (1 << 40))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) >= size:
            return

        def powers(base: int) -> np.ndarray:
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate((table, _times(table, np.uint64(pow(base, len(table), PRIME)))))
            return table

        self.powers, self.inverses = powers(self.base), powers(pow(self.base, -1, PRIME))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of ``width`` consecutive words, of those that begin at the places ``at`` or at all."""
        count = len(starts)
        at = np.arange(max(0, count - width + 1)) if at is None else at
        if not len(at):
            return np.empty(0, np.uint64)
        self._grow(count)
        terms = _times(_reduced(word_hashes(data, starts, ends, self.seed)), self.powers[:count])
        sums = np.zeros((2, count + 1), np.uint64)
        np.cumsum(terms & _HALF, out=sums[0, 1:])
        np.cumsum(terms >> np.uint64(31), out=sums[1, 1:])
        low, high = (_reduced(out[at + width] - out[at]) for out in sums)
        return mixed(_times(_reduced(_times(high, np.uint64(1 << 31)) + low), self.inverses[at]))


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    inside = np.concatenate(([False], ~white(data), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]
