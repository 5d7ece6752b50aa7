"""Vectorised word handling on UTF-8 bytes for the Arrow-based operators.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``; all separators are ASCII, so the
byte rule and the code-point rule agree).  Texts are handled in chunks of a few megabytes: all words of a chunk are
hashed with a handful of numpy calls, whatever the number of documents.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: The words of the SQL contracts, for Java, DuckDB and Python regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 4_000_000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: ``data`` has the texts joined by line feeds (and eight bytes of padding);
    word i is data[starts[i]:ends[i]]; text d has the words first[d]:first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def head(self) -> np.ndarray:
        """The first eight bytes of each word, zero-padded, as an integer."""
        return self._load(self.starts, self.ends - self.starts)

    def _load(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        overlapping = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, 0, (1,))
        return overlapping[at] & _LOW_BYTES[np.minimum(left, 8)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        length = self.ends - self.starts
        h = mix(self.head() * _ODD + length.astype(np.uint64))
        rest, at = np.flatnonzero(length > 8), 8
        while len(rest):
            h[rest] = mix(h[rest] * _ODD + self._load(self.starts[rest] + at, length[rest] - at))
            at += 8
            rest = rest[length[rest] > at]
        return h

    def text_of(self, d: int) -> bytes:
        """Bytes from the first to the last word of text d."""
        a, b = self.first[d], self.first[d + 1]
        return self.data[self.starts[a]:self.ends[b - 1]].tobytes() if b > a else b""


def split(texts: list[str | None], lower_ascii: bool = False, separator: np.ndarray = _SEPARATOR) -> Words:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(8), dtype=np.uint8)
    size = len(data) - 8
    if lower_ascii:
        data = _LOWER[data]
    inside = np.zeros(size + 1, dtype=np.int8)
    inside[1:] = ~separator[data[:size]]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return Words(np.ascontiguousarray(data), starts, ends, np.searchsorted(starts, begins))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters (one longer text is a range of its own)."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, for each start (len(h) - n + 1 of them, none for fewer words)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[:len(h) - n + 1].copy()
    for j in range(1, n):
        g = g * _ODD + h[j:len(h) - n + 1 + j]
    return mix(g)


def gram_bounds(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the range [a, b) of gram starts that lie wholly in it."""
    a = words.first[:-1]
    return a, np.maximum(a, words.first[1:] - n + 1)
