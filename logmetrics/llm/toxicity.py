"""Toxic passages: maximal scoring segments over token log-odds, calibrated by extreme values.

Tokens are lower-cased words. A token's log-odds compare its rate in toxic and
other training documents under Dirichlet priors that are nested: a word's prior
is centred on the words that share its first five bytes, theirs on those that
share four, theirs on all tokens; so an unseen form of a known stem scores like
the stem, and a word seen a few times by chance scores near nothing. Half
a standard error is taken off. A toxic passage is modelled as ordinary text with a
tenth of toxic tokens, which gives every other token a small negative score.

One linear scan then finds all maximal scoring segments of a text (each as large
as it can be, none overlapping). Under the training documents that are not
toxic, a best segment follows an extreme-value law with parameters lambda and K:
lambda solves E[exp(lambda s)] = 1 for a token's score s, K follows from the
mean best segment. A segment of score S in a text of n tokens has the expected
number of chance equals ``E = K n exp(-lambda S)``. A text's evidence is the sum
of ``-ln E`` over its segments with E < 1, and a logistic curve fitted to the
training rows turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.blocks import Lookup
from logmetrics.llm.frames import col, without
from logmetrics.llm.words import ALNUM_WORDS, U, Words, cut, slices, text_buffers
from logmetrics.session import materialize

HEADS = (4, 5)
#: Share of toxic tokens in a toxic passage, weight of a prior in documents, least toxic documents that raise a score.
SHARE, PRIOR, SUPPORT = 0.1, 1.0, 3
#: Standard errors that are taken off the log-odds.
ERROR = 0.5
#: A passage is reported when fewer than this many as good are expected by chance.
SIGNIFICANT = 0.05
#: Bound on the labelled rows that a model learns from.
TRAIN_ROWS = 20_000
ADDED = ("tox_score", "tox_predicted", "tox_passages")


@dataclass(frozen=True)
class Model:
    """Token scores by level (words, five bytes, four bytes), then the calibration."""

    keys: tuple[np.ndarray, ...]
    scores: tuple[np.ndarray, ...]
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (-20.0, 0.0)


def token_scores(model: Model, words: Words, lookups: list[Lookup]) -> np.ndarray:
    """A score for each word: its own, else that of its longest known beginning, else the small negative one."""
    score = np.full(len(words.hash), np.log(1 - SHARE))
    for lookup, values, hashes in reversed(
        list(zip(lookups, model.scores, (words.hash, words.heads[1], words.heads[0]), strict=True))
    ):
        at, key = lookup.find(hashes)
        score[at] = values[key]
    return score


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first place, last place, score).

    ``places`` are the tokens with positive ``scores``, ascending; every token
    between two of them scores ``drift``. Each candidate keeps the running total
    before it and at its end; a new one joins the nearest earlier candidate that
    starts lower, if that one also ends lower, and tries again. Candidates know
    their own nearest earlier one that starts lower, so the search skips what
    cannot qualify and the whole scan is linear.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # total before, at the end, first, last, nearest lower
    total, at = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total += drift * (place - at - 1)
        at = place
        low, high, first = total, total + score, place
        total = high
        lower = len(kept) - 1
        while True:
            while lower >= 0 and kept[lower][0] >= low:
                lower = kept[lower][4]
            if lower < 0 or kept[lower][1] >= high:
                kept.append((low, high, first, place, lower))
                break
            low, _, first, _, above = kept[lower]
            del kept[lower:]
            lower = above
    return [(first, last + 1, high - low) for low, high, first, last, _ in kept]


def _lookups(model: Model) -> list[Lookup]:
    return [Lookup(k) for k in model.keys]


def _texts(texts: pa.Array, model: Model, lookups: list[Lookup]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(number of words, segments) of each text."""
    data, offsets = text_buffers(texts)
    drift = float(np.log(1 - SHARE))
    for begin, end in slices(offsets):
        words = cut(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], ALNUM_WORDS, HEADS)
        score = token_scores(model, words, lookups)
        high = np.flatnonzero(score > 0)
        cuts = np.searchsorted(high, words.first).tolist()
        values, first = score[high].tolist(), words.first.tolist()
        for k in range(end - begin):
            own = high[cuts[k] : cuts[k + 1]] - first[k]
            found = segments(own.tolist(), values[cuts[k] : cuts[k + 1]], drift) if len(own) else []
            yield first[k + 1] - first[k], found


def evidence(model: Model, words: int, found: list[tuple[int, int, float]]) -> float:
    """Sum of -ln E over the segments that chance would not reach once."""
    log_n = np.log(max(words, 1)) + model.log_k
    return float(sum(max(0.0, model.lam * s - log_n) for _, _, s in found))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per token and class, summed over a slice of the texts, with the token's beginnings."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = text_buffers(batch.column(0))
        for begin, end in slices(offsets):
            words = cut(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], ALNUM_WORDS, HEADS)
            doc = words.doc()
            for level, key in enumerate((words.hash, words.heads[1], words.heads[0])):
                order = np.lexsort((doc, key))
                key, own = key[order], doc[order]
                once = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: len(key)])
                key, own, at = key[once], own[once], order[once]
                heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
                if not len(heads):
                    continue
                bad = np.add.reduceat(toxic[begin + own].astype(np.int64), heads)
                every = np.diff(np.r_[heads, len(key)])
                above = (words.heads[1], words.heads[0], np.zeros(len(order), U))[level][at[heads]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heads), level, np.int32))]
                    + [pa.array(v.view(np.int64)) for v in (key[heads], above)]
                    + [pa.array(bad), pa.array(every)],
                    ["level", "key", "above", "bad", "every"],
                )


def _fit_tokens(counts: DataFrame, base: float) -> Model:
    """Token scores from (level, key, above, bad, every), beginnings first, by joins.

    All tokens whose four-byte beginning has a toxic document are fitted, the
    clean ones too; below any other beginning every token scores the drift.
    Fewer than SUPPORT toxic documents never lift a token above its beginning,
    but its clean documents lower it. To the driver come only the rows that
    score unlike their beginning.
    """
    drift = float(np.log(1 - SHARE))
    rest = float(np.log(base / (1 - base)))

    def fitted(rows: DataFrame, centre: Column) -> DataFrame:
        rows = rows.withColumn("mean", (F.col("bad") + PRIOR * centre) / (F.col("every") + PRIOR))
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("every") - F.col("bad") + 0.5))
        odds = F.log(F.col("mean") / (1 - F.col("mean"))) - rest - ERROR * error
        more = F.greatest(F.lit(0.0), F.exp(F.least(odds, F.lit(20.0))) - 1)
        score = F.when(more > 0, F.log(1 - SHARE + SHARE * more)).otherwise(drift)
        few = F.col("bad") < SUPPORT
        return rows.withColumn("score", F.when(few, F.least(score, "parent")).otherwise(score))

    level = fitted(counts.where("level = 2 AND bad > 0").withColumn("parent", F.lit(drift)), F.lit(base))
    levels = [level]
    for k in (1, 0):
        up = level.select(F.col("key").alias("above"), F.col("mean").alias("centre"), F.col("score").alias("parent"))
        level = fitted(counts.where(F.col("level") == k).join(up, "above"), F.col("centre"))
        levels.insert(0, level)
    keys, scores = [], []
    for level in levels:
        rows = level.where("score != parent").select("key", "score").toArrow()
        key = rows.column("key").to_numpy().view(U)
        order = np.argsort(key)
        keys.append(key[order])
        scores.append(rows.column("score").to_numpy()[order])
    return Model(tuple(keys), tuple(scores))


def _describe(model: Model):
    """For each training text: label, words, best segment, all segment scores, sums over tokens."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = _lookups(model)
        for batch in batches:
            rows = list(_texts(batch.column(0), model, lookups))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([[s for _, _, s in found] for _, found in rows], pa.list_(pa.float64())),
                ],
                ["toxic", "words", "segments"],
            )

    return describe


def _score_histogram(model: Model):
    """How often each token score (to 0.01) occurs in the texts."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups, total = _lookups(model), {}
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for begin, end in slices(offsets):
                part = offsets[begin : end + 1] - offsets[begin]
                words = cut(data[offsets[begin] : offsets[end]], part, ALNUM_WORDS, HEADS)
                value, count = np.unique(np.round(token_scores(model, words, lookups) * 100), return_counts=True)
                for v, c in zip(value.tolist(), count.tolist(), strict=True):
                    total[int(v)] = total.get(int(v), 0) + c
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["score", "n"]
        )

    return histogram


def solve_lambda(score: np.ndarray, count: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1; 1 if scores have no positive part or a mean over 0."""
    share = count / count.sum() if count.sum() else count
    if not len(score) or score.max() <= 0 or (score * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * score)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * score)).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with a light ridge, by Newton steps that never raise the loss."""
    design = np.c_[np.ones(len(x)), x]
    beta, ridge = np.zeros(2), np.array([1e-3, 1e-2])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * b * b).sum())

    now = loss(beta)
    for _ in range(200):
        z = design @ beta
        p = np.exp(-np.logaddexp(0, -z))
        grad = design.T @ (p - y) + ridge * beta
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-9 and loss(beta - size * step) > now:
            size /= 2
        if size <= 1e-9 or np.abs(step).max() < 1e-9:
            break
        beta = beta - size * step
        now = loss(beta)
    return float(beta[0]), float(beta[1])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> Model:
    """A model from labelled documents that are not held out.

    About ``rows`` of them at most, picked by a hash of the id; all of them when
    there are fewer. Token counts are summed on the executors; to the driver come
    tokens that score unlike their beginning and one row a training document,
    both bounded by ``rows``. Null labels and ids are passed over, of repeated
    labels the largest counts; without labels of both classes every text
    scores 0.
    """
    known = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(col(id_col).alias("key")).agg(F.max(col(label_col)).cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = docs.select(col(id_col).alias("key"), col(text_col).alias("text")).join(F.broadcast(known), "key")
    train = train.select("text", "toxic")
    sizes = dict(train.groupBy("toxic").count().collect())
    empty = Model(tuple(np.zeros(0, U) for _ in range(3)), tuple(np.zeros(0) for _ in range(3)))
    if not sizes.get(0) or not sizes.get(1):
        return empty
    counts = train.mapInArrow(_count_tokens, "level int, key bigint, above bigint, bad bigint, every bigint")
    counts = counts.groupBy("level", "key").agg(
        F.any_value("above").alias("above"), F.sum("bad").alias("bad"), F.sum("every").alias("every")
    )
    # Counts are exact, so the sums do not depend on the order of rows.
    base = sizes[1] / (sizes[0] + sizes[1])
    model = _fit_tokens(materialize(counts, "counts"), base)
    clean = train.where("toxic = 0")
    histogram = clean.mapInArrow(_score_histogram(model), "score bigint, n bigint").groupBy("score").agg(F.sum("n").alias("n"))
    histogram = np.array(sorted(tuple(r) for r in histogram.collect()), float).reshape(-1, 2)
    lam = solve_lambda(histogram[:, 0] / 100, histogram[:, 1])
    seen = train.mapInArrow(_describe(model), "toxic int, words bigint, segments array<double>").collect()
    best = [lam * max(r["segments"]) - np.log(r["words"]) for r in seen if r["toxic"] == 0 and r["segments"]]
    log_k = float(np.mean(best) - np.euler_gamma) if best else 0.0
    model = Model(model.keys, model.scores, lam, log_k)
    x = np.array([np.log1p(evidence(model, r["words"], [(0, 0, s) for s in r["segments"]])) for r in seen])
    y = np.array([float(r["toxic"] > 0) for r in seen])
    return Model(model.keys, model.scores, lam, log_k, _logistic(x, y))


def probability(model: Model, words: int, found: list[tuple[int, int, float]]) -> float:
    a, b = model.curve
    return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence(model, words, found)), -500, 500))))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``tox_score``, ``tox_predicted`` (1 at ``threshold`` or more) and ``tox_passages``.

    A passage is a range of words (from ``begin`` up to before ``end``) with its
    score and expected chance number. A null or empty text has no evidence and
    scores what the curve gives for none; columns named like the added ones are
    replaced; an empty table gives an empty one.
    """
    docs = without(docs, *ADDED)
    text_at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.StructType(
        [T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in ("score", "expected")]
    )
    kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
    schema = T.StructType(
        [*docs.schema.fields]
        + [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_predicted", T.IntegerType())]
        + [T.StructField("tox_passages", T.ArrayType(passage))]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        lookups = _lookups(own)
        for batch in batches:
            scores, passages = [], []
            for words, found in _texts(batch.column(text_at), own, lookups):
                scores.append(probability(own, words, found))
                log_n = np.log(max(words, 1)) + own.log_k
                chance = [(b, e, s, float(np.exp(min(700.0, log_n - own.lam * s)))) for b, e, s in found]
                passages.append(
                    [dict(zip(kind.names, c, strict=True)) for c in chance if c[3] < SIGNIFICANT]
                )
            value = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))]
                + [pa.array(passages, pa.list_(kind))],
                [*batch.schema.names, *ADDED],
            )

    return docs.mapInArrow(score, schema)


def drop_toxic_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        lookups = _lookups(own)
        for batch in batches:
            good = [probability(own, n, found) < threshold for n, found in _texts(batch.column(text_at), own, lookups)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
