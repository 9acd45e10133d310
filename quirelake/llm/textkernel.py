"""Array code on many texts at once: code points, runs of character classes and 62-bit hashes of spans.

The texts of an Arrow batch are laid end to end as one array of code points, in blocks of about a million, so that
memory stays small whatever a batch or a text holds.  A span's hash joins two polynomials modulo the prime 2**31 - 1,
each in a base and over values of the code points of its own, read off prefix sums; equal spans have equal hashes at
every place.  Two different spans of n code points collide with a probability of about (n / 2**31)**2, whatever their
form, as the modulus is prime; where a collision would falsify a result, spellings are compared besides (`bpe`).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 1 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_PRIME = (1 << 31) - 1
#: bases of the two polynomials
_BASES = (1355236547, 961748927)
#: Unicode White_Space (fixed values)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.fromiter(
        ({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
        np.uint8,
        sys.maxunicode + 1,
    )
    table[_WHITE] = SPACE
    return table


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of an array."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _values(k: int) -> np.ndarray:
    """Values of the code points, from 1 to the prime less 1."""
    return _mixed(np.arange(sys.maxunicode + 1, dtype=np.uint64) + np.uint64(k << 32)) % np.uint64(_PRIME - 1) + np.uint64(1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**62, as a number below 2**31 + 1."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """At least n powers of each base and of its inverse modulo the prime."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        made = []
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, _PRIME)):
                out, step = np.ones(1, np.uint64), b
                while len(out) < max(n, BLOCK_CHARS + 1):
                    out = np.concatenate([out, out * np.uint64(step) % np.uint64(_PRIME)])
                    step = step * step % _PRIME
                both.append(out)
            made.append((both[0], both[1]))
        _POWERS[:] = made
    return _POWERS


class Block:
    """Some texts laid end to end."""

    def __init__(self, texts: list[str | None], first: int = 0):
        #: place of the block's first text in the batch
        self.first = first
        self.texts = texts
        self.joined = "".join(t for t in texts if t)
        self.cps = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        #: the texts' starts, and the end of the last
        self.bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) if t else 0 for t in texts], out=self.bounds[1:])
        self._prefix: list[np.ndarray] | None = None

    @property
    def n(self) -> int:
        return len(self.cps)

    def _prefixes(self, cps: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, (powers, _) in enumerate(_powers(self.n + 1)):
            prefix = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_reduced(_values(k)[cps] * powers[: self.n]), out=prefix[1:])
            out.append(prefix)
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, cps: np.ndarray | None = None) -> np.ndarray:
        """Hash of each span; cps: other code points in the place of the block's own, such as case-folded ones."""
        if cps is not None:
            prefixes = self._prefixes(cps)
        else:
            prefixes = self._prefix = self._prefix or self._prefixes(self.cps)
        halves = []
        for prefix, (_, inverse) in zip(prefixes, _powers(self.n + 1)):
            # differences stay below 2**31 times the number of code points
            part = _reduced(_reduced(prefix[ends] - prefix[starts]))
            halves.append(part * inverse[starts] % np.uint64(_PRIME))
        return _mixed(halves[0] << np.uint64(31) | halves[1])

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        """The place in the block of the text that holds each position."""
        return np.searchsorted(self.bounds, at, side="right") - 1


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The texts in blocks of about so many characters; a text is never divided."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        more = len(text) if text else 0
        if size and size + more > chars:
            yield Block(texts[begin:i], begin)
            begin, size = i, 0
        size += more
    if begin < len(texts):
        yield Block(texts[begin:], begin)


def hash_of(word: str) -> int:
    """The hash of one string, as `Block.hashes` gives it for a span."""
    block = Block([word])
    return int(block.hashes(np.array([0]), np.array([block.n]))[0])


class HashIndex:
    """A growing map from span hash to a dense number, kept as a direct-addressed table over a sorted array."""

    def __init__(self, bits: int = 17):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.zeros(0, np.uint64)
        self.numbers = np.zeros(0, np.int64)
        self._slot_key = np.zeros(1 << self.bits, np.uint64)
        self._slot_number = np.full(1 << self.bits, -1, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown."""
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self._slot_key[slots] == hashes, self._slot_number[slots], -1)
        if self.n:
            rest = np.flatnonzero(out < 0)
            if len(rest):
                wanted = hashes[rest]
                at = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
                out[rest] = np.where(self.keys[at] == wanted, self.numbers[at], -1)
        return out

    def add(self, hashes: np.ndarray, new: np.ndarray | None = None) -> np.ndarray:
        """Numbers for new, distinct hashes: those given, else the next ones."""
        if new is None:
            new = np.arange(self.n, self.n + len(hashes))
        self.n += len(hashes)
        keys, numbers = np.concatenate([self.keys, hashes]), np.concatenate([self.numbers, new])
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self._slot_key[slots], self._slot_number[slots] = hashes, new
        return new
