"""Vectorised words: byte classes, word bounds and 64-bit word hashes of many texts at once.

Texts stay UTF-8. Every byte of a non-ASCII character is at least 0x80, so a class of characters that holds all or
none of the non-ASCII characters is a class of bytes. A word's hash is a difference of prefix sums of a polynomial
in its bytes, mixed afterwards; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_STEP = U(0xD1342543DE82EF95)
_BACK = U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_power = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _STEP), ("down", _BACK)):
            row = np.full(size, base, dtype=U)
            row[0] = 1
            _power[key] = np.multiply.accumulate(row)
    return _power["up"][:n], _power["down"][:n]


def _class(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Letters and digits of ASCII and everything beyond it: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased.
ALNUM = _class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: All but white space: [^\x20\x09-\x0D]
INK = ~_class([(0x20, 0x20), (0x09, 0x0D)])


@dataclass
class Words:
    """Words of a slice of texts, in order. ``doc``: index of the text in the slice; ``at``/``end``: byte bounds in
    ``data``; ``first``: index of each text's first word, with one more entry for the end."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) over runs of texts; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, lower: bool = True) -> Words:
    """Words of one slice: longest runs of bytes of the class ``kind`` that don't cross a text's end."""
    inside = kind[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    starts[offsets[full]] = inside[offsets[full]]
    ends[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    at, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(at, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(at):
        up, down = _powers(len(data) + 1)
        code = (_CODE[_LOWER] if lower else _CODE)[data] * up[: len(data)]
        total = np.concatenate([np.zeros(1, U), np.cumsum(code, dtype=U)])
        h = mix((total[end] - total[at]) * down[at] + (end - at).astype(U))
    else:
        h = np.zeros(0, U)
    return Words(data, offsets, doc, at, end, h, first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``n`` words within a text."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    g = w.hash[:m].copy()
    for k in range(1, n):
        g = mix(g * U(0x9E3779B97F4A7C15) + w.hash[k : k + m])
    ok = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    return ok, g[ok]


def word_hash(word: str) -> int:
    """The hash of one word, as ``split`` gives it."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(split(raw, np.array([0, len(raw)]), kind=np.ones(256, dtype=bool)).hash[0])
