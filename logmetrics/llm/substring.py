"""Removal of passages that an earlier document has, by windows in a distributed index.

This stands in for a relative Lempel-Ziv parsing: factors come from windows that
are looked up by hash; reference blocks are not extended word by word.

The reference of a document is every document with a smaller id. It is indexed
as a book of phrases (windows of 13 words) that is cut into blocks by the
phrase's hash, and each document is factored against all blocks at once: from
left to right, a factor begins at the first word whose phrase the book has from
an earlier document and goes on, greedily, as long as the next phrase is there
too; it ends 12 words after the last one found. So a factor is at least a
phrase long, each of its boundaries is a phrase that was looked up and not
found, and the words inside factors are exactly those that windows shared with
an earlier document cover.

Most phrases occur once, so two rounds keep the rest at home:

1. Each window is represented by its least 5-word hash (equal windows, equal
   representatives; neighbours mostly share one). Only these travel, once for
   each block of documents, and those seen in more than one place come back.
2. Only windows with such a representative travel (96-bit hash, least and
   largest document id in the block); the least id overall comes back.

Rows of the index are pre-aggregated per block of documents, so a passage that
a third of all documents holds is one entry a block and no task meets all its
documents. Work and traffic are linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logmetrics.llm import blocks as B
from logmetrics.llm.frames import col, without
from logmetrics.llm.words import BLANK_WORDS, OTHER, U, covered, cut, grams, slices, text_buffers

CORE = 5
#: Bits of a representative that travel; a clash only sends a window for nothing.
BITS = 48
ADDED = ("kept_text", "n_words", "n_removed")


def _representatives(hashes: np.ndarray, window: int, core: int) -> np.ndarray:
    """The least core-word hash in the window beginning at each word."""
    least, have, want = grams(hashes, core), 1, window - core + 1
    if len(least) < want:
        return np.zeros(0, U)
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least >> U(64 - BITS)


def _asked(rows: pa.RecordBatch, window: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted representatives of some documents: those in one, those in several of them."""
    data, offsets = text_buffers(rows.column(1))
    found = []
    for begin, end in slices(offsets):
        part = cut(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], BLANK_WORDS)
        least = _representatives(part.hash, window, core)
        at = np.flatnonzero(part.left()[: len(least)] >= window)
        doc = part.doc()[at].astype(U) + U(begin)
        key = least[at] << U(64 - BITS) | doc
        found.append(key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key)
    key = np.unique(B.joined(found)) >> U(64 - BITS)
    value, count = np.unique(key, return_counts=True)
    return value[count == 1], value[count > 1]


def _ask(window: int, core: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in B.runs(batches):
            once, more = _asked(rows, window, core)
            cuts = [B.bounds(v, BITS, buckets) for v in (once, more)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(buckets, dtype=np.int32)),
                    pa.array(np.full(buckets, block)),
                    *(
                        pa.array([B.pack_sorted(v[c[k] : c[k + 1]]) for k in range(buckets)], pa.binary())
                        for v, c in zip((once, more), cuts, strict=True)
                    ),
                ],
                ["bucket", "block", "once", "more"],
            )

    return ask


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, rows = [], []
    for batch in batches:
        block += batch.column("block").to_pylist()
        for once, more in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
            rows.append((B.unpack_sorted(once), B.unpack_sorted(more)))
    every = np.sort(B.joined([v for once, more in rows for v in (once, more, more)]))
    lookup = B.Lookup(np.unique(every[1:][every[1:] == every[:-1]]), BITS)
    for k, (once, more) in zip(block, rows, strict=True):
        part = np.sort(np.concatenate([once[lookup.find(once)[0]], more]))
        if len(part):
            yield _answer([k], [B.pack_sorted(part)])


def _answer(block: list[int], part: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.binary())], ["block", "part"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield (
                batch.column("block")[k].as_py(),
                B.unpacked(batch.column("payload")[k].as_py()),
                batch.column("parts")[k].as_py() or [],
            )


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document ids and which are known; a document without an id takes no part."""
    ids = rows.column(0)
    known = np.ones(len(ids), bool) if not ids.null_count else ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def _send(window: int, core: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, parts in _parts(batches):
            if not parts:
                continue
            lookup = B.Lookup(np.sort(B.joined([B.unpack_sorted(p) for p in parts])), BITS)
            ids, known = _ids(rows)
            data, offsets = text_buffers(rows.column(1))
            phrase, check, doc = [], [], []
            for begin, end in slices(offsets):
                part = cut(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], BLANK_WORDS)
                at, _ = lookup.find(_representatives(part.hash, window, core))
                own = part.doc()[at] + begin
                ok = (part.left()[at] >= window) & known[own]
                at, own = at[ok], own[ok]
                phrase.append(grams(part.hash, window)[at])
                check.append(grams(part.hash, window, OTHER)[at].astype(np.uint32))
                doc.append(ids[own])
            phrase, check, doc = B.joined(phrase), B.joined(check, np.uint32), B.joined(doc, np.int64)
            if not len(phrase):
                continue
            order = np.argsort(phrase, kind="stable")
            phrase, check, doc = phrase[order], check[order], doc[order]
            heads = np.flatnonzero(np.r_[True, (np.diff(phrase) != 0) | (np.diff(check) != 0)])
            low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
            phrase, check = phrase[heads], check[heads]
            cuts = B.bounds(phrase, 64, buckets)
            spans = [(k, slice(cuts[k], cuts[k + 1])) for k in range(buckets) if cuts[k + 1] > cuts[k]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in spans], pa.int32()),
                    pa.array([block] * len(spans), pa.int64()),
                    pa.array([B.pack_sorted(phrase[s]) for _, s in spans], pa.binary()),
                    pa.array([check[s].tobytes() for _, s in spans], pa.binary()),
                    pa.array([B.pack_ints(low[s]) for _, s in spans], pa.binary()),
                    pa.array([B.pack_ints(high[s] - low[s]) for _, s in spans], pa.binary()),
                ],
                ["bucket", "block", "phrase", "check", "low", "high"],
            )

    return send


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each phrase that an earlier document has than the block's latest: the earliest."""
    names = ("phrase", "check", "low", "high")
    read = (B.unpack_sorted, lambda d: np.frombuffer(d, np.uint32), B.unpack_ints, B.unpack_ints)
    block: list[int] = []
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        block += batch.column("block").to_pylist()
        for to, name, f in zip(columns, names, read, strict=True):
            to += [f(d) for d in batch.column(name).to_pylist()]
    if not block:
        return
    ends = np.cumsum([len(v) for v in columns[0]])
    phrase, check, low, high = (np.concatenate(v) for v in columns)
    high = high + low
    order = np.lexsort((check, phrase))
    heads = np.flatnonzero(np.r_[True, (np.diff(phrase[order]) != 0) | (np.diff(check[order]) != 0)])
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(low[order], heads), np.diff(np.r_[heads, len(order)]))
    for k, begin, end in zip(block, np.r_[0, ends[:-1]], ends, strict=True):
        hit = np.flatnonzero(first[begin:end] < high[begin:end]) + begin
        if len(hit):
            phrases = B.pack_sorted(phrase[hit])
            yield _answer([k], [len(phrases).to_bytes(4, "little") + phrases + B.pack_ints(first[hit])])


def _factor(window: int):
    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, parts in _parts(batches):
            phrases, firsts = [], []
            for p in parts:
                size = 4 + int.from_bytes(p[:4], "little")
                phrases.append(B.unpack_sorted(p[4:size]))
                firsts.append(B.unpack_ints(p[size:]))
            phrase, first = B.joined(phrases), B.joined(firsts, np.int64)
            order = np.lexsort((first, phrase))
            keys, heads = np.unique(phrase[order], return_index=True)
            lookup, first = B.Lookup(keys), first[order][heads]
            ids, known = _ids(rows)
            data, offsets = text_buffers(rows.column(1))
            counts, gone = [], []
            for begin, end in slices(offsets):
                part = cut(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], BLANK_WORDS)
                counts.append(part.counts)
                at, key = lookup.find(grams(part.hash, window))
                own = part.doc()[at] + begin
                at = at[(part.left()[at] >= window) & known[own] & (first[key] < ids[own])]
                gone.append(covered(at, window, len(part.hash)))
            counts, gone = B.joined(counts, np.int64), B.joined(gone, bool)
            ends = np.cumsum(counts)
            removed = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(gone, out=removed[1:])
            removed = removed[ends] - removed[ends - counts]
            raw, kept = data.tobytes(), []
            for k in range(rows.num_rows):
                split = raw[offsets[k] : offsets[k + 1]].split()
                if removed[k]:
                    keep = np.flatnonzero(~gone[ends[k] - counts[k] : ends[k]]).tolist()
                    split = [split[w] for w in keep]
                kept.append(b" ".join(split))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts), pa.array(removed)],
                [*rows.schema.names, *ADDED],
            )

    return factor


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, core: int = CORE
) -> DataFrame:
    """All rows of ``docs`` with ``kept_text``, ``n_words`` and ``n_removed`` added.

    Words are runs of anything but space, tab and line or page breaks. A word
    goes when a window of ``window`` words that covers it also starts in a
    document with a smaller id; the rest is joined by single spaces. Windows are
    judged on the input.

    ``docs`` reads a stored table. A null text has no words and gives ''; a text
    shorter than the window loses nothing; rows with the same id are no earlier
    than each other; a row without an id loses nothing and no other row loses
    words for it; an empty table gives an empty one; columns of ``docs`` named
    like the added ones are replaced.
    """
    others = [c for c in without(docs, *ADDED, "block").columns if c not in (id_col, text_col)]
    docs = docs.select(col(id_col).cast("bigint").alias(id_col), col(text_col), *map(col, others))
    texts, buckets = docs.select(col(id_col), col(text_col)), B.bucket_count(docs)
    asked = B.with_block(texts).mapInArrow(
        _ask(window, core, buckets), "bucket int, block bigint, once binary, more binary"
    )
    repeated = B.dealt(asked, buckets, _repeated)
    sent = B.answered(B.packed(texts), repeated).mapInArrow(
        _send(window, core, buckets),
        "bucket int, block bigint, phrase binary, check binary, low binary, high binary",
    )
    earliest = B.dealt(sent, buckets, _earliest)
    schema = T.StructType(
        [*docs.schema.fields]
        + [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType())]
        + [T.StructField("n_removed", T.LongType())]
    )
    return B.answered(B.packed(docs), earliest).mapInArrow(_factor(window), schema)
