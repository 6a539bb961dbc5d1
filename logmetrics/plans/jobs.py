"""The four jobs, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmetrics.functions.messages import (
    Tokenizer,
    tokenize_deleting_punctuation,
)
from logmetrics.operators import cluster, text
from logmetrics.operators.features import (
    apply_zscore,
    contamination,
    cyclic_time,
    fit_zscore,
    minmax_normalize,
    polar_to_xy,
    replace_sentinel,
    vector_sum,
)
from logmetrics.operators.forest import rcf_score
from logmetrics.operators.iforest import iforest_fit, iforest_outliers, iforest_score
from logmetrics.operators.intervals import Interval, inject_events, label_intervals
from logmetrics.operators.logs import build_log_frame, last_per_key
from logmetrics.operators.positions import chrono_split, row_index, sample_every
from logmetrics.operators.report import anomaly_report
from logmetrics.operators.sparse_cluster import sparse_kmeans
from logmetrics.operators.windows import WindowSpec, shingle, sliding_windows, window_slices
from logmetrics.session import materialize, sized_broadcast

#: Rows of word counts that one task merges.
COUNT_ROWS = 500_000


def log_anomalies(
    logs: DataFrame,
    vectors: DataFrame,
    *,
    faults: Sequence[Interval] = (),
    num_trees: int = 100,
    tree_size: int = 256,
    seed: int = 0,
) -> DataFrame:
    """Log records to (time, message, embedding_sum, rcf, event).

    Clean, keep the last message per time, inject the faults, embed, score.
    De-duplication comes before the costly steps. A message with no known word
    has no vector and so no score.
    """
    frame = last_per_key(build_log_frame(logs.select("log_time", "message", "seq")))
    frame = materialize(frame, "messages")
    if faults:
        frame = inject_events(frame, faults)
    words = sized_broadcast(vectors)
    embedded = materialize(
        text.embed_lookup(frame, words, key="time").select("time", "features"), "embedded"
    )
    points = embedded.filter(F.col("features").isNotNull())
    scores = rcf_score(
        points, "time", num_trees=num_trees, tree_size=tree_size, seed=seed, stored=True
    )
    sums = points.select("time", vector_sum(F.col("features")).alias("embedding_sum"))
    flagged = label_intervals(frame, list(faults), ts="time")
    return anomaly_report(flagged, "time", sums, scores.withColumnRenamed("score", "rcf"))


def log_clusters(
    docs: DataFrame,
    *,
    weighting: str = "tfidf",
    k: int = 6,
    max_iter: int = 10_000,
    seeds: Sequence[int] = (42,),
    lemmas: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Documents to (doc_id, cluster_label).

    ``tfidf`` uses default words and pairs; ``bm25`` uses single words with
    punctuation deleted and lemmas applied. Every document gets a label; one
    without a term is a zero vector. Vectors stay in long form: no row, task or
    driver object has the vocabulary's width.
    """
    n = text.corpus_size(docs).scalar()
    if weighting == "tfidf":
        counts = materialize(text.term_counts(docs) if counts is None else counts, "counts")
        weights = text.tfidf(counts, n, materialize(text.document_frequency(counts), "terms"))
    elif weighting == "bm25":
        counts = materialize(lemma_counts(docs, lemmas, counts=counts), "counts")
        weights = text.bm25_presence(counts, text.bm25_idf(counts, n))
    else:
        raise ValueError(weighting)
    stored = materialize(weights.select("doc_id", "term", "weight"), "weights")
    fit = sparse_kmeans(stored, docs, k=k, max_iter=max_iter, seeds=seeds)
    return fit.labels.select("doc_id", F.col("cluster_label").cast("long").alias("cluster_label"))


def log_elbow(
    logs: DataFrame,
    vectors: DataFrame,
    *,
    ks: Sequence[int] = (1, 2, 3, 4),
    starts: int = 10,
    max_iter: int = 300,
    seed: int = 0,
) -> DataFrame:
    """Log records to (k, inertia): clean, keep the last message per time, embed, cluster.

    All numbers of clusters and starts run in the same scans; the row of k = 2
    is the inertia of the two-cluster fit. Messages with no known word take no
    part.
    """
    frame = last_per_key(build_log_frame(logs.select("log_time", "message", "seq")))
    frame = materialize(frame, "messages")
    embedded = text.embed_lookup(frame, sized_broadcast(vectors), key="time")
    points = embedded.filter(F.col("features").isNotNull()).select("time", "features")
    return cluster.elbow(points, ks=ks, starts=starts, max_iter=max_iter, seed=seed, key="time")


def lemma_counts(
    docs: DataFrame,
    lemmas: DataFrame | None = None,
    tokens: Tokenizer = tokenize_deleting_punctuation,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, term, tf) of single words, replaced by their lemma where one is known.

    ``counts`` are the words already counted and stored, so that texts are cut
    only once; they are dealt out by document before words of one lemma are
    added up, so that a task's share does not grow with the table.
    """
    stored = counts
    if counts is None:
        counts = text.term_counts(docs, tokens=tokens, pairs=False)
    if lemmas is None:
        return counts
    joined = text.lemma_join(counts.withColumnRenamed("term", "token"), lemmas)
    if stored is not None:
        cores = stored.sparkSession.sparkContext.defaultParallelism
        joined = joined.repartition(max(cores, -(-stored.count() // COUNT_ROWS)), "doc_id")
    return joined.groupBy("doc_id", F.col("token").alias("term")).agg(F.sum("tf").alias("tf"))


def series_comparison(
    series: DataFrame,
    intervals: Sequence[Interval] | DataFrame,
    *,
    group: Sequence[str] = (),
    ts: str = "ts",
    value: str = "value",
    size: int = 48,
    num_trees: int = 200,
    tree_size: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Metric series to (series, ts, thousands, rcf, iforest, outlier, event).

    Both forests score the same shingled points; scores sit on the last row of
    a shingle, so the first ``size - 1`` rows of a series have none, and neither
    have rows whose shingle holds a missing value. Rows are numbered once and
    scores come back by that number, so equal times do no harm.
    """
    flagged = label_intervals(series, intervals, ts=ts)
    indexed = materialize(row_index(flagged, *group, ts), "indexed")
    shingled = materialize(
        shingle(indexed, *group, ts, value=value, size=size, series=group, indexed=True), "shingles"
    )
    whole = F.forall("features", lambda x: x.isNotNull())
    points = shingled.filter(whole).select("idx", "features")
    rcf = rcf_score(
        points, "idx", num_trees=num_trees, tree_size=tree_size, seed=seed, stored=True
    )
    nodes = materialize(iforest_fit(points, "idx", num_trees=num_trees, seed=seed), "nodes")
    raw = materialize(iforest_score(points, nodes).select("idx", "score"), "iforest")
    share = contamination(flagged).first()["contamination"] or 0.0
    outliers = iforest_outliers(raw, share, "idx")
    scaled = minmax_normalize(outliers, ["score"]).withColumnRenamed("score", "iforest")
    rows = indexed.withColumn("thousands", F.col(value) / F.lit(1000.0))
    scores = rcf.withColumnRenamed("score", "rcf").join(scaled, "idx", "full")
    return rows.join(scores, "idx", "left").drop("idx")


WEATHER_STEMS = {"wv (m/s)": "W", "max. wv (m/s)": "max W"}


def weather_windows(
    frame: DataFrame,
    *order: str,
    time: str = "Date Time",
    label: str = "T (degC)",
    direction: str = "wd (deg)",
    step: int = 6,
) -> tuple[DataFrame, WindowSpec]:
    """Weather rows to window slices (split, idx, inputs, labels) and their shape.

    Sample one row in six, fix sentinels, build wind and calendar features,
    split by time, scale with the train part's statistics, cut windows.
    """
    # Sampled rows are at positions 5, 11, 17, ...: their own position needs no second order.
    sampled = sample_every(frame, *order, step=step, name="idx", offset=step - 1)
    sampled = materialize(sampled.withColumn("idx", F.expr(f"(idx - {step - 1}) div {step}")), "sampled")
    fixed = replace_sentinel(sampled, list(WEATHER_STEMS))
    featured = cyclic_time(polar_to_xy(fixed, WEATHER_STEMS, direction), time)
    keys = {time, *order, "idx"}
    columns = [c for c in featured.columns if c not in keys]
    parts = chrono_split(featured, *order, indexed=True)
    stats = fit_zscore(parts, columns, F.col("split") == "train")
    scaled = apply_zscore(parts, stats, columns)
    spec = WindowSpec(columns=tuple(columns), label_columns=(label,))
    return window_slices(sliding_windows(scaled, spec), spec), spec

