"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the bag of its byte n-grams (1 to 4 bytes of a word, its borders
marked), hashed to a table of embedding rows; their average goes through a
linear layer and a softmax. Embeddings and layer are trained by stochastic
gradient descent in numpy, on a bounded number of training documents whose
n-grams the executors have counted. A temperature and a rejection threshold are
then set on training documents that the descent has not seen.

Since everything before the softmax is linear, each table row's product with the
layer is computed once; a prediction averages those over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.frames import col, without
from logmetrics.llm.words import ALNUM_WORDS, U, mix, seeded, slices, text_buffers

SIZES = (1, 2, 3, 4)
TABLE_BITS, WIDTH = 16, 16
#: Bound on the documents a model learns from, shared among the languages.
TRAIN_ROWS = 1600
EPOCHS, RATE, TARGET = 12, 8.0, 0.99
UNKNOWN = "und"
ADDED = ("lang_pred", "lang_score", "lang_rejected")
_BORDER = seeded(1, 99)[0]


@dataclass(frozen=True)
class Model:
    """Languages, each table row's logits, bias, temperature and the least trusted score."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, table row) of every n-gram that lies in a word or reaches one border mark."""
    digits = (data >= 48) & (data <= 57)
    value = ALNUM_WORDS.value[data]
    value[digits] = 0
    inside = value != 0
    value[~inside] = _BORDER
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    docs, rows = [], []
    gram, middle = None, None
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            break
        gram = value[:n].copy() if gram is None else gram[:n] * U(0x9E3779B97F4A7C15) + value[size - 1 :]
        ok = inside[:n].copy() if size == 1 else (inside[:n] | inside[size - 1 :])
        if size > 2:
            middle = inside[1 : n + 1] if middle is None else middle[:n] & inside[size - 2 : size - 2 + n]
            ok &= middle[:n]
        ok &= doc[:n] == doc[size - 1 :]
        at = np.flatnonzero(ok)
        docs.append(doc[at])
        rows.append((mix(gram[at] + U(size)) >> U(64 - TABLE_BITS)).astype(np.int32))
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(rows)


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for begin, end in slices(offsets, most):
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table rows and their counts for each training text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for begin, end, part, own in _pieces(data, offsets):
            doc, row = subwords(part, own)
            key, count = np.unique(doc.astype(np.int64) << TABLE_BITS | row, return_counts=True)
            cuts = np.searchsorted(key, np.arange(end - begin + 1, dtype=np.int64) << TABLE_BITS)
            row = (key & ((1 << TABLE_BITS) - 1)).astype(np.uint16)
            count = count.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(begin, end - begin)]
                + [
                    pa.array([v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                    for v in (row, count)
                ],
                ["lang", "rows", "counts"],
            )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], languages: tuple[str, ...], seed: int = 3) -> Model:
    """Stochastic gradient descent over (language, table rows, counts), one text a step."""
    draw = np.random.default_rng(seed)
    table = draw.standard_normal((1 << TABLE_BITS, WIDTH)) / WIDTH
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    order = draw.permutation(len(samples))
    check = order[: len(order) // 5] if len(order) >= 10 * len(languages) else order
    learn = order[len(order) // 5 :] if len(order) >= 10 * len(languages) else order
    steps = EPOCHS * max(len(learn), 1)
    done = 0
    for _ in range(EPOCHS):
        for k in draw.permutation(learn):
            label, rows, counts = samples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = counts / counts.sum()
            mean = share @ table[rows]
            slope = _softmax(mean @ layer + bias)
            slope[label] -= 1
            back = layer @ slope
            layer -= rate * 0.1 * np.outer(mean, slope)
            bias -= rate * 0.01 * slope
            table[rows] -= rate * share[:, None] * back
    logits = table @ layer
    z = np.array([counts @ logits[rows] / counts.sum() + bias for _, rows, counts in (samples[k] for k in check)])
    y = np.array([samples[k][0] for k in check])
    temperature, least = 1.0, 0.0
    if len(z):
        grid = np.exp(np.linspace(-3, 3, 61))
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        rank = np.argsort(-top)
        good = np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= TARGET
        least = float(top[rank][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(languages, logits.astype(np.float32), bias, temperature, least)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2


def train_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS
) -> Model:
    """A model from documents with a language that are not held out.

    About ``rows`` documents at most, as many of each language as there are or
    as its share allows, picked by a hash of the id; whole texts. The driver
    gets their n-gram counts (at most 2**16 a text). Texts without letters teach
    nothing; without any usable document every text is ``und``.
    """
    known = docs.select(col(id_col).alias("key"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    known = known.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out("key"))
    sizes = dict(known.groupBy("lang").count().collect())
    if not sizes:
        return Model((), np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros(0))
    each = max(1, rows // len(sizes))
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, int(min(1.0, each / n) * (1 << 20))).otherwise(limit)
    sample = known.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 20)) < limit)
    found = sample.select("text", "lang").mapInArrow(_count, "lang string, rows binary, counts binary").collect()
    languages = tuple(sorted(sizes))
    samples = sorted(
        (languages.index(r["lang"]), bytes(r["rows"]), bytes(r["counts"])) for r in found if len(r["rows"])
    )
    return fit(
        [(k, np.frombuffer(r, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(float)) for k, r, c in samples],
        languages,
    )


def _lettered(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that hold a letter of any script."""
    low = data | 32
    ascii_letter = np.r_[0, np.cumsum((low >= 97) & (low <= 122))]
    has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~has & (offsets[1:] > offsets[:-1])).tolist():
        has[k] = any(c.isalpha() for c in texts[k].as_py())
    return has


def predict_languages(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected`` (less sure than the threshold).

    A text that is null or has no letter is ``und`` with score 0 and rejected;
    columns named like the added ones are replaced; an empty table gives an
    empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, *ADDED)
    text_at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != text_at]
    schema = T.StructType(
        [docs.schema.fields[k] for k in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
        + [T.StructField("lang_rejected", T.BooleanType())]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = held.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(text_at)
            data, offsets = text_buffers(texts)
            total, number = np.zeros((batch.num_rows, len(own.languages))), np.zeros(batch.num_rows)
            if own.languages:
                for begin, end, part, cuts in _pieces(data, offsets):
                    doc, row = subwords(part, cuts)
                    number[begin:end] = np.bincount(doc, minlength=end - begin)
                    for k in range(len(own.languages)):
                        total[begin:end, k] = np.bincount(doc, own.logits[:, k][row], minlength=end - begin)
            usable = _lettered(texts, data, offsets) & (number > 0)
            pick, score = np.full(batch.num_rows, len(own.languages)), np.zeros(batch.num_rows)
            if usable.any():
                z = (total[usable] / number[usable, None] + own.bias) / own.temperature
                p = _softmax(z)
                pick[usable], score[usable] = p.argmax(axis=1), p.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept)]
                + [pa.array(names[pick], pa.string()), pa.array(score), pa.array(~usable | (score < own.least))],
                [*(batch.schema.names[k] for k in kept), *ADDED],
            )

    return docs.mapInArrow(predict, schema)
