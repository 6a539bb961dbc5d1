"""Fill-in-the-middle: a text in three parts, its middle moved to the end behind markers.

A text is its UTF-8 bytes in blocks of a fixed size. Two Fenwick trees over the
blocks hold how many units begin in each block and how many code points do. A
cut after so many units descends the unit tree by halving steps (binary lifting)
to the block where the next unit begins, adding up code points on the way, and
the place inside is looked for in that block alone. A unit is a code point, or
what a pattern says.

Parts and form are drawn from the hash of seed and row id, so repeated tasks and
other partitionings give the same rows. Texts never leave their row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.frames import col, without
from logmetrics.llm.words import slices, text_buffers

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
BLOCK_BYTES = 256
ADDED = ("fim_text", "fim_form", "fim_units", "prefix_chars", "middle_chars")


class Blocks:
    """Fenwick trees of the unit and code point counts of a text's blocks."""

    def __init__(self, data: np.ndarray, pattern: re.Pattern | None = None, size: int = BLOCK_BYTES) -> None:
        self.data, self.size = data, size
        self.point = (data & 0xC0) != 0x80
        self.unit = self.point if pattern is None else self._begins(pattern)
        edges = np.arange(0, len(data), size)
        self.count = len(edges)
        self.units, self.points = (self._tree(flags, edges) for flags in (self.unit, self.point))
        self.total = int(np.count_nonzero(self.unit))

    def _begins(self, pattern: re.Pattern) -> np.ndarray:
        """A unit begins with each match that is not empty; what stands before the first is part of it."""
        begins = np.zeros(len(self.data), bool)
        found = [m.start() for m in pattern.finditer(self.data.tobytes().decode()) if m.end() > m.start()]
        if found:
            found[0] = 0
            begins[np.flatnonzero(self.point)[found]] = True
        return begins

    def _tree(self, flags: np.ndarray, edges: np.ndarray) -> list[int]:
        """Entry i sums the i & -i blocks that end with block i (from 1)."""
        before = np.zeros(self.count + 1, np.int64)
        if self.count:
            np.cumsum(np.add.reduceat(flags, edges, dtype=np.int64), out=before[1:])
        at = np.arange(self.count + 1)
        return (before - before[at - (at & -at)]).tolist()

    def cut(self, after: int) -> tuple[int, int]:
        """(byte, code points before it) of the place after so many units."""
        if after >= self.total:
            return len(self.data), int(np.count_nonzero(self.point))
        block, left, points = 0, after, 0
        step = 1 << self.count.bit_length()
        while step := step >> 1:
            if block + step <= self.count and self.units[block + step] <= left:
                block += step
                left -= self.units[block]
                points += self.points[block]
        begin = block * self.size
        place = int(np.flatnonzero(self.unit[begin : begin + self.size])[left])
        return begin + place, points + int(np.count_nonzero(self.point[begin : begin + place]))


def draws(seed: int, key: str) -> list[int]:
    """Four 32-bit numbers of a row."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(
    text: bytes, key: str, seed: int, pattern: re.Pattern | None, markers: tuple[bytes, ...], plain: int, spm: int
) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle) of one text."""
    blocks = Blocks(np.frombuffer(text, np.uint8), pattern)
    first, second, third, fourth = draws(seed, key)
    if not text or third % 100 >= 100 - plain or any(m in text for m in markers):
        return text, "plain", blocks.total, None, None
    low, high = sorted((first % (blocks.total + 1), second % (blocks.total + 1)))
    (begin, points), (end, more) = blocks.cut(low), blocks.cut(high)
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    p, s, m = markers
    if fourth % 100 < spm:
        return b"".join([s, suffix, p, prefix, m, middle]), "spm", blocks.total, points, more - points
    return b"".join([p, prefix, s, suffix, m, middle]), "psm", blocks.total, points, more - points


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers that cannot arise where a text and a marker meet."""
    clash = any(a in b for a, b in permutations(markers, 2)) or any(
        a[-k:] == b[:k] for a in markers for b in markers for k in range(1, min(len(a), len(b)))
    )
    if not all(markers) or clash:
        raise ValueError("markers must not be empty, hold each other, or end as one begins")
    return markers


def move_middles(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    pattern: str | None = None,
    markers: tuple[str, str, str] = MARKERS,
    plain: int = 10,
    spm: int = 20,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with every whole text transformed; see :func:`restore_texts` for the way back.

    Added: ``fim_text``; ``fim_form``, ``psm`` (prefix, suffix, middle), ``spm``
    (suffix, prefix, middle) or ``plain`` (unchanged); ``fim_units``, the units
    of the text; ``prefix_chars`` and ``middle_chars`` in code points (null if
    plain). ``plain`` and ``spm`` are percentages: of all rows, and of the
    transformed ones. ``pattern`` makes each of its matches begin a unit.

    A null text counts as empty; an empty text, and one that holds a marker, is
    plain; a null id counts as an empty one; equal rows give equal rows; an
    empty table gives an empty one; columns named like the added ones are
    replaced. ``keep_text=False`` leaves the text column out.
    """
    raw = tuple(m.encode() for m in _checked(markers))
    docs = without(docs, *ADDED)
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    schema = T.StructType(
        [docs.schema.fields[k] for k in kept]
        + [T.StructField(name, T.StringType()) for name in ADDED[:2]]
        + [T.StructField(name, T.LongType()) for name in ADDED[2:]]
    )

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = None if pattern is None else re.compile(pattern)
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            keys = batch.column(id_at).cast(pa.string()).to_pylist()
            for begin, end in slices(offsets):
                rows = [
                    transform(data[offsets[k] : offsets[k + 1]].tobytes(), keys[k] or "", seed, units, raw, plain, spm)
                    for k in range(begin, end)
                ]
                text, form, *counts = zip(*rows, strict=True)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in kept]
                    + [pa.array(text, pa.binary()).cast(pa.string()), pa.array(form, pa.string())]
                    + [pa.array(c, pa.int64()) for c in counts],
                    [part.schema.names[k] for k in kept] + list(ADDED),
                )

    return docs.mapInArrow(move, schema)


def restore_texts(
    moved: DataFrame,
    output: str = "fim_text",
    form: str = "fim_form",
    name: str = "restored_text",
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``moved`` with the text each output was made of, from output and form alone.

    A null output or form, and an output without the markers of its form, give
    null; a column named ``name`` is replaced.
    """
    p, s, m = (f"\\Q{x}\\E" for x in _checked(markers))
    width = {x: F.lit(len(mark) + 1) for x, mark in zip("ps", markers[:2], strict=True)}

    def parts(first: str, second: str):
        split = F.split(F.substring(col(output), width[first], F.char_length(col(output))), f"{second}|{m}", 3)
        return [F.get(split, k) for k in range(3)]

    psm, spm = parts("p", s), parts("s", p)
    text = (
        F.when(col(form) == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(col(form) == "spm", F.concat(spm[1], spm[2], spm[0]))
        .when(col(form) == "plain", col(output))
    )
    return without(moved, name).withColumn(name, text)
