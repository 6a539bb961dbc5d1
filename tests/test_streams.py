import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logmetrics.operators import forest as rf
from logmetrics.operators.logs import last_per_key
from logmetrics.operators.text import embed_lookup
from logmetrics.streaming import logs as streams

BASE = datetime(2021, 9, 15)
SCHEMA = "time timestamp_ntz, message string, seq long"


def test_stream_last_per_key_equals_batch_for_closed_keys(spark, tmp_path):
    rows = [(BASE + timedelta(minutes=k // 3), f"m{k}" if k % 4 else None, k) for k in range(600)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    out = str(tmp_path / "out")
    last = streams.stream_last_per_key(stream, delay="30 minutes")
    streams.append_to(last, out, str(tmp_path / "state")).awaitTermination()
    batch = last_per_key(spark.read.parquet(source))
    closed = batch.filter(F.col("time") <= F.lit(rows[-1][0] - timedelta(minutes=30)))
    got = sorted(map(tuple, spark.read.parquet(out).select("time", "message").collect()))
    assert got == sorted(map(tuple, closed.select("time", "message").collect()))
    assert len(got) == 170
    # What the watermark holds back is in the stored state: together all keys, each once.
    still = streams.open_keys(spark, str(tmp_path / "state"), stream.schema)
    assert still.columns == ["time", "message"] and still.count() == 30
    every = sorted(map(tuple, still.unionByName(spark.read.parquet(out)).collect()))
    assert every == sorted(map(tuple, batch.select("time", "message").collect()))


@pytest.fixture()
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()

    def land(k):
        records = [{"log_time": f"2021-09-15 00:0{k}:0{j}", "message": text}
                   for j, text in enumerate(["disk[1]: full", "disk ok", "unknown"])]
        body = {"searchTime": str(k), "logCount": 3, "is_VALID": True, "invalid_MSG": "",
                "log_type": "a", "logCmpList": records}
        (folder / f"{k}.json").write_text(json.dumps(body))

    return str(folder), land


def test_stream_scores_new_files_once(spark, tmp_path, landed):
    folder, land = landed
    vectors = spark.createDataFrame(
        [("disk", [1.0, 0.0]), ("full", [0.0, 9.0]), ("ok", [0.1, 0.1])], "token string, vector array<double>"
    )
    known = spark.createDataFrame([(k, "disk ok") for k in range(30)] + [(30, "disk disk ok")],
                                  "k long, message string")
    points = embed_lookup(known, vectors, key="k")
    forest = rf.rcf_fit(points, "k", num_trees=5, tree_size=31)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = streams.stream_envelopes(spark, folder, multi_line=True)
        keyed = stream.select(F.concat_ws("/", "searchTime", "pos").alias("row_key"), "message")
        streams.stream_log_scores(keyed, vectors, forest, out, state, key="row_key").awaitTermination()
        return {r["row_key"]: r["score"] for r in spark.read.parquet(out).collect()}

    land(1)
    first = run()
    assert set(first) == {"1/0", "1/1", "1/2"}
    assert first["1/2"] is None and first["1/0"] > first["1/1"]
    land(2)
    both = run()
    assert set(both) == {f"{k}/{j}" for k in (1, 2) for j in range(3)}
    assert both["1/0"] == pytest.approx(first["1/0"]) == pytest.approx(both["2/0"])


def test_scoring_is_dealt_out_by_rows_and_each_message_is_scored_once(spark, tmp_path, landed, monkeypatch):
    folder, land = landed
    vectors = spark.createDataFrame([("disk", [1.0, 0.0]), ("ok", [0.1, 0.1])], "token string, vector array<double>")
    known = spark.createDataFrame([(k, "disk ok" if k else "ok") for k in range(30)], "k long, message string")
    forest = rf.rcf_fit(embed_lookup(known, vectors, key="k"), "k", num_trees=3, tree_size=30)
    seen = []

    def score(points, packed):
        seen.append((points.rdd.getNumPartitions(), points.count()))
        return rf.rcf_score_against(points, packed)

    monkeypatch.setattr(streams, "rcf_score_against", score)
    monkeypatch.setattr(streams, "SCORE_ROWS", 1)
    for k in range(4):
        land(k)
    stream = streams.stream_envelopes(spark, folder, multi_line=True)
    keyed = stream.select(F.lit("same").alias("row_key"), "message")
    out = str(tmp_path / "out")
    streams.stream_log_scores(keyed, vectors, forest, out, str(tmp_path / "state"), key="row_key").awaitTermination()
    assert seen == [(12, 2)]  # twelve messages, two texts with a known word
    assert spark.read.parquet(out).count() == 12  # a repeated key repeats no row
