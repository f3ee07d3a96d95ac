"""The words of many texts at once: bounds, 64-bit hashes, and exact comparison of what hashes call equal.

A hash only proposes that two words or runs of words are equal. `identities` compares the words themselves before they get one number, and
tells clashing ones apart, so that sets, overlaps and matches that are counted from its numbers are those of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable

import numpy as np

#: A-Z become a-z, and the six ASCII white-space characters a space; every other byte belongs to a word.
SPACE_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Bytes that are searched for word bounds at once, and from how many bytes on a word is hashed by itself.
SEGMENT, LONG = 1 << 20, 256
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The low 0 to 8 bytes of a 64-bit number.
LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spread(counts: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] numbers) for every i, one after the other."""
    out = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return out if first is None else out + np.repeat(first, counts)


class Words:
    """All words of some texts: starts and ends in `flat`, hashes, and how many each text has."""

    def __init__(self, texts: list[bytes | None], table: bytes = SPACE_WORDS):
        parts = [(t or b"").translate(table) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.flat = b" ".join([*parts, b" " * 8])  # a space ends every text, and eight bytes can be read from any place
        del parts
        self.begin = np.cumsum(sizes) - sizes
        self.starts, self.ends = self._bounds(int(sizes.sum()))
        self.counts = np.diff(np.searchsorted(self.starts, self.begin + sizes), prepend=0) if len(texts) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self._eight = np.ndarray(len(self.flat) - 7, "<u8", self.flat, strides=(1,))
        self.hashes = self._hashed()

    def _bounds(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        data, edges, inside = np.frombuffer(self.flat, np.uint8, n), [], False
        for at in range(0, n, SEGMENT):
            word = data[at : at + SEGMENT] != 32
            change = word.copy()
            change[1:] ^= word[:-1]
            change[0] ^= inside
            edges.append(np.flatnonzero(change) + at)
            inside = bool(word[-1])
        every = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        return every[::2].copy(), every[1::2].copy()

    def _chunks(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self._eight[starts].astype(np.uint64) & LOW[np.minimum(left, 8)]

    def _hashed(self) -> np.ndarray:
        """Eight bytes a step, mixed at every step; long words by a cryptographic hash."""
        n = self.ends - self.starts
        h = n.astype(np.uint64) * A
        live, step = np.flatnonzero(n <= LONG), 0
        while len(live):
            left = n[live] - 8 * step
            h[live] = mix(h[live] ^ self._chunks(self.starts[live] + 8 * step, left)) + B
            live, step = live[left > 8], step + 1
        for i in np.flatnonzero(n > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return h

    def word(self, i: int) -> bytes:
        return self.flat[self.starts[i] : self.ends[i]]

    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in bytes of the words' own texts."""
        shift = np.repeat(self.begin, self.counts)
        return self.starts - shift, self.ends - shift

    def normalised(self, i: int) -> bytes:
        """Text i as its words with one space between."""
        a = int(self.begin[i])
        b = int(self.begin[i + 1]) if i + 1 < len(self.begin) else len(self.flat) - 8
        return b" ".join(x for x in self.flat[a:b].split(b" ") if x)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i and j are different, byte by byte."""
        n = self.ends[i] - self.starts[i]
        out = n != self.ends[j] - self.starts[j]
        live, step = np.flatnonzero(~out), 0
        while len(live):
            left = n[live] - 8 * step
            bad = self._chunks(self.starts[i[live]] + 8 * step, left) != self._chunks(self.starts[j[live]] + 8 * step, left)
            out[live[bad]] = True
            live, step = live[~bad & (left > 8)], step + 1
        return out

    def ids(self) -> np.ndarray:
        """A number for every word: the same one if, and only if, the words are equal."""
        return identities(self.hashes, self.differ, self.word)


def identities(keys: np.ndarray, differ: Callable[[np.ndarray, np.ndarray], np.ndarray], value: Callable[[int], Hashable]) -> np.ndarray:
    """Numbers from 0 on, equal if and only if the values are, given keys that are equal for equal values.

    differ compares the values at two lists of places; only where keys clash are values themselves looked at."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[1:] = keys[order[1:]] == keys[order[:-1]]
    at = np.flatnonzero(again)
    bad = at[differ(order[at], order[at - 1])] if len(at) else at
    number = np.cumsum(~again) - 1
    given = number.copy()
    if len(bad):
        top = int(number[-1]) + 1
        for g in np.unique(number[bad]).tolist():
            a, b = np.searchsorted(number, [g, g + 1])
            seen: dict[Hashable, int] = {}
            for x in range(a, b):
                v = value(int(order[x]))
                if v not in seen:
                    seen[v] = g if not seen else top
                    top += seen[v] == top
                given[x] = seen[v]
    out = np.empty(len(keys), np.int64)
    out[order] = given
    return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, across the bounds of texts too; mixed at every step."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n))
    for i in range(n):
        out = (out ^ h[i : i + m]) * A
        out ^= out >> np.uint64(32)
    return mix(out)
