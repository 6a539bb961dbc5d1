"""Words of many texts as numpy arrays of 64-bit hashes.

A text is its UTF-8 bytes; a word is a run of bytes of one class. All texts of
an Arrow column are cut at once, straight from the column's buffers, so nothing
is done per word in Python.

Hashes are polynomials modulo 2**64 over the bytes of a word (or the mixed
hashes of a run of words), so equal words always hash alike and a run's hash is
a difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = values.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(_STEP))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U)
                for b in (self.base, self.inverse)
            )


_BYTES, _WORDS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642D)
#: Another base, for a second hash that is independent of the first.
OTHER = Powers(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Kind:
    """Which bytes are part of words, and what each counts as (0: a separator)."""

    name: str
    value: np.ndarray


def _kind(name: str, is_word, fold=lambda b: b) -> Kind:
    noise = seeded(256, 7)
    return Kind(name, np.array([noise[fold(b)] if is_word(fold(b)) else 0 for b in range(256)], U))


def _lower(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


#: Everything but space, tab and the line and page breaks, unchanged.
BLANK_WORDS = _kind("blank", lambda b: b != 32 and not 9 <= b <= 13)
#: ASCII digits and letters and all other scripts, A-Z lowered.
ALNUM_WORDS = _kind("alnum", lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, _lower)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


@dataclass
class Words:
    """Words of some texts: byte ranges, hashes, the first word of each text (n + 1 entries), hashes of heads."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    heads: list[np.ndarray]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words of its text start at or after each word."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def cut(data: np.ndarray, offsets: np.ndarray, kind: Kind, heads: tuple[int, ...] = ()) -> Words:
    """The words of texts given as bytes and offsets (both from 0).

    ``heads`` asks for hashes of each word's first so many bytes (all, if it has fewer).
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64), [np.zeros(0, U)] * len(heads))
    value = kind.value[data]
    word = value != 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = offsets[offsets < n]  # a word never runs on into the next text
    begins[edge] = word[edge]
    edge = offsets[offsets > 0] - 1
    ends[edge] = word[edge]
    start, last = np.flatnonzero(begins), np.flatnonzero(ends)
    _BYTES.reach(n)
    value *= _BYTES.up[:n]
    total = np.cumsum(value, dtype=U)
    before = total[start] - value[start]

    def hashed(stop: np.ndarray) -> np.ndarray:
        return mix((total[stop] - before) * _BYTES.down[start])

    parts = [mix(hashed(np.minimum(last, start + size - 1)) + U(size)) for size in heads]
    return Words(start, last + 1, hashed(last), np.searchsorted(start, offsets), parts)


def grams(words: np.ndarray, size: int, powers: Powers | None = None) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, text borders ignored (len - size + 1 of them)."""
    powers = powers or _WORDS
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    powers.reach(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers.up[: len(words)], dtype=U, out=total[1:])
    return mix((total[size:] - total[:n]) * powers.down[:n])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words beginning at ``starts``."""
    opens = np.bincount(starts, minlength=n + 1)
    opens -= np.bincount(np.minimum(starts + size, n), minlength=n + 1)
    return np.cumsum(opens[:-1]) > 0
