"""Queries over the two forests and their reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from logmetrics.operators import forest as rf
from logmetrics.operators import iforest as ifo
from logmetrics.operators.features import minmax_normalize
from logmetrics.operators.intervals import Interval, label_intervals
from logmetrics.operators.report import anomaly_report
from logmetrics.operators.windows import shingle
from logmetrics.plans import inputs as i
from logmetrics.plans import jobs
from logmetrics.plans.catalog import query
from logmetrics.session import materialize, spread

SEED, TREES, SIZE = 7, 100, 256


def _sampled(trees: int, size: int, p: str = "") -> str:
    """SQL of the sampling: rounds of n // size disjoint groups in md5 order."""
    return f"""{p}shape AS (
  SELECT n, size, n // size AS per_round, ceil({trees} / (n // size))::BIGINT AS rounds
  FROM (SELECT count(*) AS n, least({size}, count(*)) AS size FROM events)),
{p}placed AS (
  SELECT event_id, event_type, round, size, per_round,
         row_number() OVER (PARTITION BY round
           ORDER BY md5('{SEED}:' || round || ':' || event_id), event_id) - 1 AS pos
  FROM events, (SELECT unnest(range(0, rounds)) AS round FROM {p}shape), {p}shape),
{p}sampled AS (
  SELECT event_id, (event_type = 'error')::INTEGER AS x,
         round * per_round + pos // size AS tree
  FROM {p}placed WHERE pos < per_round * size)"""


# With two distinct points every cut parts them: their displacements are b/a and
# a/b whatever the draws.
CODISP = f"""{_sampled(TREES, SIZE)},
sizes AS (SELECT tree, sum(x)::BIGINT AS ones, count(*) - sum(x)::BIGINT AS zeros
          FROM sampled GROUP BY tree),
codisps AS (
  SELECT tree, event_id,
    CASE WHEN ones = 0 OR zeros = 0 THEN 0.0::DOUBLE
         WHEN x = 1 THEN zeros::DOUBLE / ones ELSE ones::DOUBLE / zeros END AS codisp
  FROM sampled JOIN sizes USING (tree)),
means AS (
  SELECT e.event_id, score FROM events e LEFT JOIN
    (SELECT event_id, avg(codisp) AS score FROM codisps GROUP BY event_id) m
    ON e.event_id = m.event_id),
rcf AS (
  SELECT event_id, (score - (SELECT min(score) FROM means))
    / nullif((SELECT max(score) - min(score) FROM means), 0) AS score FROM means)"""


def _two_valued(spark, sf_dir):
    x = (F.col("event_type") == "error").cast("double")
    return i.events(spark, sf_dir).select("event_id", F.array(x).alias("features"))


@query(f"WITH {_sampled(TREES, SIZE)} SELECT event_id, tree FROM sampled")
def forest_sample(spark, sf_dir):
    points = i.events(spark, sf_dir).select("event_id")
    return rf.forest_sample(points, "event_id", num_trees=TREES, tree_size=SIZE, seed=SEED)


@query(f"WITH {_sampled(20, 64)} SELECT event_id, tree FROM sampled WHERE tree < 20")
def sample_trees(spark, sf_dir):
    points = i.events(spark, sf_dir).select("event_id")
    return rf.sample_trees(points, "event_id", num_trees=20, tree_size=64, seed=SEED)


@query(f"""WITH {_sampled(TREES, SIZE)},
leaves AS (SELECT tree, x, count(*) AS n FROM sampled GROUP BY tree, x)
SELECT tree, x::DOUBLE AS point, n FROM leaves""")
def rcf_build(spark, sf_dir):
    points = _two_valued(spark, sf_dir)
    sample = rf.forest_sample(points, "event_id", num_trees=TREES, tree_size=SIZE, seed=SEED)
    leaves = rf.rcf_build(sample, seed=SEED).filter(F.col("point").isNotNull())
    return leaves.select("tree", F.col("point")[0].alias("point"), "n")


@query(f"WITH {CODISP} SELECT tree, event_id, round(codisp, 6) AS codisp FROM codisps")
def codisp(spark, sf_dir):
    points = _two_valued(spark, sf_dir)
    sample = rf.forest_sample(points, "event_id", num_trees=TREES, tree_size=SIZE, seed=SEED)
    return rf.codisp(sample, "event_id", seed=SEED).withColumn("codisp", F.round("codisp", 6))


@query(f"WITH {CODISP} SELECT event_id, round(score, 6) AS score FROM means")
def mean_score_per_point(spark, sf_dir):
    points = _two_valued(spark, sf_dir)
    sample = rf.forest_sample(points, "event_id", num_trees=TREES, tree_size=SIZE, seed=SEED)
    scores = rf.codisp(sample, "event_id", seed=SEED)
    means = rf.mean_score_per_point(scores, points, "event_id")
    return means.withColumn("score", F.round("score", 6))


@query(f"WITH {CODISP} SELECT event_id, round(score, 6) AS score FROM rcf")
def rcf_score(spark, sf_dir):
    scores = rf.rcf_score(
        _two_valued(spark, sf_dir), "event_id", num_trees=TREES, tree_size=SIZE, seed=SEED
    )
    return scores.withColumn("score", F.round("score", 6))


@query()
def rcf_score_vectors(spark, sf_dir):
    points = i.vectors(spark, sf_dir)
    return rf.rcf_score(points, "vec_id", num_trees=TREES, tree_size=SIZE, seed=SEED)


def _hourly(spark, sf_dir):
    """Mean value per type and hour: the metric series of the anomaly jobs."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return (
        i.events(spark, sf_dir)
        .groupBy(F.col("event_type").alias("series"), hour)
        .agg(F.avg("value").alias("value"))
    )


def _series(spark, sf_dir):
    """Every event as a point of its type's series."""
    return i.events(spark, sf_dir).select(F.col("event_type").alias("series"), "ts", "value")


@query()
def series_anomaly_scores(spark, sf_dir):
    """Flagship: random cut forest over shingled metric series, with event flags."""
    flagged = label_intervals(_series(spark, sf_dir), i.FAULTS)
    points = materialize(
        shingle(flagged, "series", "ts", series=["series"], size=48), "shingles"
    )
    scores = rf.rcf_score(points, "idx", num_trees=200, tree_size=1000, seed=SEED, stored=True)
    return points.select("idx", "series", "ts", "value", "event").join(scores, "idx")


@query()
def series_comparison(spark, sf_dir):
    return jobs.series_comparison(_series(spark, sf_dir), i.FAULTS, group=["series"], seed=SEED)


@query()
def log_anomalies(spark, sf_dir):
    """Two faults are injected, from messages that are there: ten and thirty seconds."""
    words = materialize(i.word_vectors(spark, sf_dir), "words")
    logs = i.logs(spark, sf_dir)
    starts = logs.filter(F.col("seq").isin(40, 80)).select("log_time").orderBy("log_time").collect()
    faults = [
        Interval(name, row["log_time"], row["log_time"] + timedelta(seconds=seconds))
        for row, name, seconds in zip(starts, ("warning", "error"), (10, 30), strict=True)
    ]
    return jobs.log_anomalies(logs, words, faults=faults, seed=SEED)


FITTED = f"""{_sampled(50, 512)},
fitted AS (SELECT * FROM sampled WHERE tree < 50)"""


@query(f"""WITH {FITTED}
SELECT tree, count(*) AS n, (CASE WHEN count(DISTINCT x) = 2 THEN 3 ELSE 1 END)::BIGINT AS nodes
FROM fitted GROUP BY tree""")
def rcf_fit_series(spark, sf_dir):
    nodes = materialize(
        rf.rcf_fit(_two_valued(spark, sf_dir), "event_id", num_trees=50, tree_size=512, seed=SEED),
        "nodes",
    )
    return nodes.groupBy("tree").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("nodes")
    )


@query(f"""WITH {FITTED},
sizes AS (SELECT tree, sum(x)::BIGINT AS ones, count(*) - sum(x)::BIGINT AS zeros
          FROM fitted GROUP BY tree),
own AS (
  SELECT avg(CASE WHEN ones = 0 THEN zeros WHEN zeros = 0 THEN ones
                  ELSE zeros::DOUBLE / (ones + 1) END) AS one,
         avg(CASE WHEN zeros = 0 THEN ones WHEN ones = 0 THEN 0
                  ELSE ones::DOUBLE / (zeros + 1) END) AS zero
  FROM sizes)
SELECT event_id, round(CASE WHEN event_type = 'error' THEN one ELSE zero END, 6) AS score
FROM events, own""")
def rcf_score_against(spark, sf_dir):
    points = spread(_two_valued(spark, sf_dir), "event_id")
    nodes = materialize(
        rf.rcf_fit(points, "event_id", num_trees=50, tree_size=512, seed=SEED), "nodes"
    )
    return rf.rcf_score_against(points, nodes).select(
        "event_id", F.round("score", 6).alias("score")
    )


@query()
def rcf_score_against_vectors(spark, sf_dir):
    points = i.vectors(spark, sf_dir)
    nodes = materialize(rf.rcf_fit(points, "vec_id", num_trees=50, tree_size=512, seed=SEED), "nodes")
    return rf.rcf_score_against(points, nodes).select("vec_id", "score")


# --- isolation forest -------------------------------------------------------


def _mean_path(n: str) -> str:
    return (
        f"(CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) "
        f"+ 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} "
        f"WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    )


IFOREST = f"""{_sampled(200, 256, "i")},
isample AS (SELECT * FROM isampled WHERE tree < 200),
isizes AS (SELECT tree, count(*) AS n, sum(x)::BIGINT AS ones, count(*) - sum(x)::BIGINT AS zeros
           FROM isample GROUP BY tree),
lengths AS (
  SELECT max(n) AS psi,
    avg(CASE WHEN ones = 0 OR zeros = 0 THEN {_mean_path('n')} ELSE 1 + {_mean_path('ones')} END)
      AS one,
    avg(CASE WHEN ones = 0 OR zeros = 0 THEN {_mean_path('n')} ELSE 1 + {_mean_path('zeros')} END)
      AS zero
  FROM isizes),
iforest AS (
  SELECT event_id, ts, pow(2.0::DOUBLE, -(CASE WHEN event_type = 'error' THEN one ELSE zero END)
    / {_mean_path('psi')}) AS score
  FROM events, lengths)"""


def _iforest(spark, sf_dir):
    points = spread(_two_valued(spark, sf_dir), "event_id")
    nodes = materialize(ifo.iforest_fit(points, "event_id", seed=SEED), "nodes")
    return ifo.iforest_score(points, nodes).select("event_id", "score")


@query(f"WITH {IFOREST} SELECT event_id, round(score, 6) AS score FROM iforest")
def iforest_score(spark, sf_dir):
    return _iforest(spark, sf_dir).withColumn("score", F.round("score", 6))


@query()
def iforest_score_vectors(spark, sf_dir):
    points = i.vectors(spark, sf_dir)
    nodes = materialize(ifo.iforest_fit(points, "vec_id", seed=SEED), "nodes")
    return ifo.iforest_score(points, nodes).select("vec_id", "score")


@query("""SELECT round(quantile_cont(value, 0.95), 6) AS threshold FROM events""")
def iforest_threshold(spark, sf_dir):
    scores = i.events(spark, sf_dir).select("event_id", F.col("value").alias("score"))
    cut = ifo.iforest_threshold(scores, 0.05, "event_id")
    return cut.select(F.round("threshold", 6).alias("threshold"))


@query("""SELECT event_id, value AS score,
  CASE WHEN value > (SELECT quantile_cont(value, 0.95) FROM events) THEN 1 ELSE 0 END AS outlier
FROM events""")
def iforest_outliers(spark, sf_dir):
    scores = i.events(spark, sf_dir).select("event_id", F.col("value").alias("score"))
    return ifo.iforest_outliers(scores, 0.05, "event_id")


@query(f"""WITH {CODISP}, {IFOREST},
scaled AS (
  SELECT event_id, (score - (SELECT min(score) FROM iforest))
    / nullif((SELECT max(score) - min(score) FROM iforest), 0) AS iforest FROM iforest)
SELECT e.event_id, e.ts, e.value / 1000.0::DOUBLE AS thousands,
  CASE WHEN {i.IN_FAULT.replace('ts ', 'e.ts ')} THEN 1 ELSE 0 END AS event,
  round(rcf.score, 6) AS rcf, round(s.iforest, 6) AS iforest
FROM events e LEFT JOIN rcf ON e.event_id = rcf.event_id
LEFT JOIN scaled s ON e.event_id = s.event_id""")
def anomaly_report_rows(spark, sf_dir):
    rows = i.events(spark, sf_dir).select(
        "event_id", "ts", (F.col("value") / F.lit(1000.0)).alias("thousands")
    )
    rcf = rf.rcf_score(
        _two_valued(spark, sf_dir), "event_id", num_trees=TREES, tree_size=SIZE, seed=SEED
    ).select("event_id", F.round("score", 6).alias("rcf"))
    raw = materialize(_iforest(spark, sf_dir), "iforest")
    scaled = minmax_normalize(raw, ["score"]).select(
        "event_id", F.round("score", 6).alias("iforest")
    )
    return anomaly_report(label_intervals(rows, i.FAULTS), "event_id", rcf, scaled)


@query()
def injected_fault_scores(spark, sf_dir):
    """Mean score inside and outside of injected spikes: inside must be larger."""
    hours = _hourly(spark, sf_dir)
    flagged = label_intervals(hours, i.FAULTS)
    spiked = materialize(
        flagged.withColumn("value", F.col("value") + F.col("event") * F.lit(500.0)), "spiked"
    )
    scored = jobs.series_comparison(
        spiked.drop("event"), i.FAULTS, group=["series"], seed=SEED
    )
    return scored.groupBy("event").agg(
        F.avg("rcf").alias("rcf"), F.avg("iforest").alias("iforest"),
        F.count(F.lit(1)).alias("rows"),
    )

