"""Importance resampling towards a target distribution of hashed n-grams.

A-Z are lowered and separators collapse to single spaces; one overlapped scan
with a regular expression then yields, at every word, the spans of all runs of
up to ``size`` words that begin there (a run begins after a space, its words are
matched whole and ends are at word borders). A run's bytes are hashed into a
bucket by CRC-32. How often a feature's bucket occurs in the target against the
source is its gain; a text's weight is the sum of its gains, and texts are drawn
without replacement by weight plus Gumbel noise from the hash of their id.

Texts are scanned once: each keeps its sparse bucket counts, packed, in a stored
table, from which both the source's counts (at most ``buckets`` numbers a task,
added up before the shuffle) and the weights come. Only the bucket counts reach
the driver. The draw is exact: the lowest score drawn is found by counting (see
:mod:`logmetrics.operators.selection`) and only drawn rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.blocks import pack_ints, pack_sorted, unpack_ints, unpack_sorted
from logmetrics.llm.frames import col, without
from logmetrics.llm.words import U, slices, text_buffers
from logmetrics.operators.positions import row_index
from logmetrics.operators.selection import key_at, not_after
from logmetrics.session import materialize

BUCKETS = 10_000
#: Words in the longest feature.
SIZE = 3
ADDED = ("n_words", "n_features", "weight", "score", "rank")
_KEPT = ("n_words", "n_features", "features")
#: Matches taken at once, so that a long text's spans are never all in memory.
_AT_ONCE = 1 << 15
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def span_pattern(size: int) -> regex.Pattern:
    """One match a word: its groups are the runs that begin there, longest first.

    For texts of words that each have one space before them. Near the end a
    longer run's group is the same as the longest there is.
    """
    run = rb"([^ ]++)"
    for _ in range(size - 1):
        run = rb"(" + run + rb"(?: [^ ]++)?+)"
    return regex.compile(rb" " + run)


def bucket_counts(text: bytes, pattern: regex.Pattern, size: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets hit in ascending order, times each) of a text's features."""
    flat = b" ".join([b"", *text.translate(_NORMAL).split()])
    words, found = 0, []
    matches = pattern.finditer(flat, overlapped=True)
    tail: list[list[bytes]] = [[] for _ in range(size)]
    total = None
    while runs := list(islice(matches, _AT_ONCE)):
        words += len(runs)
        hashes = []
        for group in range(1, size + 1):  # group k has size + 1 - k words; the last size - k need more text
            spans = tail[group - 1] + [m[group] for m in runs]
            cut = len(spans) - (size - group)
            tail[group - 1] = spans[max(cut, 0) :]
            hashes += map(crc32, spans[: max(cut, 0)])
        found.append(np.array(hashes, np.uint32) % buckets)
        if len(runs) == _AT_ONCE:  # a long text: counts of all buckets instead of a list
            total = np.zeros(buckets, np.int64) if total is None else total
            total += np.bincount(found.pop(), minlength=buckets)
    if total is not None:
        for part in found:
            total += np.bincount(part, minlength=buckets)
        hit = np.flatnonzero(total)
        return words, hit, total[hit]
    hit, times = np.unique(found[0] if found else np.zeros(0, np.uint32), return_counts=True)
    return words, hit, times


def _packed(hit: np.ndarray, times: np.ndarray) -> bytes:
    first = pack_sorted(hit.astype(U))
    return len(first).to_bytes(4, "little") + first + pack_ints(times.astype(np.int64))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 4 + int.from_bytes(packed[:4], "little")
    return unpack_sorted(packed[4:size]).astype(np.int64), unpack_ints(packed[size:])


def extract(docs: DataFrame, text_col: str, size: int, buckets: int, keep_text: bool) -> DataFrame:
    """``docs`` with the words, the number of features and the packed bucket counts of every whole text."""
    docs = without(docs, *_KEPT)
    text_at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    schema = T.StructType(
        [docs.schema.fields[k] for k in kept]
        + [T.StructField(name, T.LongType()) for name in _KEPT[:2]]
        + [T.StructField(_KEPT[2], T.BinaryType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = span_pattern(size)
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            for begin, end in slices(offsets):
                words, totals, features = [], [], []
                for k in range(begin, end):
                    n, hit, times = bucket_counts(data[offsets[k] : offsets[k + 1]].tobytes(), pattern, size, buckets)
                    words.append(n)
                    totals.append(int(times.sum()))
                    features.append(_packed(hit, times))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in kept]
                    + [pa.array(words, pa.int64()), pa.array(totals, pa.int64()), pa.array(features, pa.binary())],
                    [part.schema.names[k] for k in kept] + list(_KEPT),
                )

    return docs.mapInArrow(scan, schema)


def count_features(extracted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts of a stored :func:`extract`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                hit, times = _unpacked(packed)
                total[hit] += times
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["b", "n"])

    sums = extracted.select("features").mapInArrow(add, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for b, n in sums.collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(seed: int, key: str) -> int:
    """Thousandths of a Gumbel draw of a row, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(extracted: DataFrame, gain: np.ndarray, id_col: str, seed: int) -> DataFrame:
    """A stored :func:`extract` with each text's weight and score in place of its features."""
    held = extracted.sparkSession.sparkContext.broadcast(gain)
    id_at, features_at = (extracted.columns.index(c) for c in (id_col, "features"))
    kept = [k for k in range(len(extracted.columns)) if k != features_at]
    schema = T.StructType(
        [extracted.schema.fields[k] for k in kept] + [T.StructField(n, T.LongType()) for n in ("weight", "score")]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            weights, scores = [], []
            keys = batch.column(id_at).cast(pa.string()).to_pylist()
            for key, packed in zip(keys, batch.column(features_at).to_pylist(), strict=True):
                hit, times = _unpacked(packed)
                weights.append(int(gain[hit] @ times))
                scores.append(weights[-1] + noise(seed, key or ""))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                schema=pa.schema([*(batch.schema.field(k) for k in kept), ("weight", pa.int64()), ("score", pa.int64())]),
            )

    return extracted.mapInArrow(score, schema)


def draw(scored: DataFrame, id_col: str, percent: int, least_words: int) -> DataFrame:
    """A stored :func:`weigh` with ``rank``: 1, 2, 3... of the drawn rows by falling score, else null."""
    # Ties go to the smaller id, rows without one come last; further columns make repeated rows' order firm.
    order = {"_score": -F.col("score"), "_none": col(id_col).isNull(), "_id": col(id_col), "_w": F.col("weight")}
    order |= {"_n": F.col("n_features"), "_m": F.col("n_words")}
    able = scored.withColumns(order).where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    none = F.lit(None).cast("bigint").alias("rank")
    key = key_at(able, wanted - 1, *order) if wanted else None
    if key is None:
        return scored.select("*", none)
    chosen = F.coalesce(not_after(key, *order), F.lit(False)) & (F.col("n_words") >= least_words)
    marked = scored.withColumns(order).withColumn("_chosen", chosen)
    ranked = row_index(marked.where("_chosen").drop("_chosen"), *order, name="_place")
    rank = F.when(F.col("_place") < wanted, F.col("_place") + 1).alias("rank")  # beyond: repeats of the last one
    return ranked.select(*map(col, scored.columns), rank).unionByName(
        marked.where(~F.col("_chosen")).select(*map(col, scored.columns), none)
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    size: int = SIZE,
    buckets: int = BUCKETS,
    seed: int = 42,
    keep_text: bool = True,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``percent`` of the rows with ``least_words`` words or more (rounded down) are
    drawn towards the texts of ``target`` and ranked from 1; ``rank`` is null for
    all others. Of equal scores the smaller id comes first.

    A null or empty text has no features and the weight 0; a null id hashes as
    an empty one and comes last among equals; repeated rows each count, and
    where the draw ends among them any of them are drawn; an empty ``docs``
    gives an empty table, an empty ``target`` equal shares for all buckets;
    columns named like the added ones are replaced. ``id_col`` holds integers or
    strings. ``keep_text=False`` leaves the text column out.
    """
    docs = without(docs, *ADDED, "features", "_score", "_none", "_id", "_w", "_n", "_m", "_chosen", "_place")
    stored = materialize(extract(docs, text_col, size, buckets, keep_text), "features")
    wanted = extract(target.select(col(target_text).alias("text")), "text", size, buckets, False)
    gain = gains(count_features(stored, buckets), count_features(wanted, buckets))
    return draw(materialize(weigh(stored, gain, id_col, seed), "scores"), id_col, percent, least_words)
