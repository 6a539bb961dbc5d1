"""Log jobs on streams: de-duplicate with bounded lateness, score new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logmetrics.operators.forest import rcf_pack, rcf_score_against
from logmetrics.operators.logs import build_log_frame, last_per_key
from logmetrics.operators.text import embed_lookup
from logmetrics.session import sized_broadcast
from logmetrics.sources.logs import ENVELOPE, envelope_rows

#: Messages that one task scores; a message is small in bytes but meets every tree.
SCORE_ROWS = 10_000


def stream_last_per_key(
    stream: DataFrame, key: str = "time", seq: str = "seq", delay: str = "1 hour"
) -> DataFrame:
    """Last non-null values per time key; a key is final ``delay`` after it.

    Watermarks need a zoned timestamp, so the key is one inside the query only.
    """
    zoned = stream.withColumn(key, F.col(key).cast("timestamp")).withWatermark(key, delay)
    last = last_per_key(zoned, key, seq)
    return last.withColumn(key, F.col(key).cast("timestamp_ntz"))


def open_keys(
    spark: SparkSession, checkpoint: str, columns: StructType, key: str = "time", seq: str = "seq"
) -> DataFrame:
    """Keys of a stopped :func:`stream_last_per_key` that its watermark still holds back.

    Read from the query's stored state, one row per key with the values seen so
    far, so that the end of the input loses nothing: these and the appended rows
    are all keys, each once. ``columns`` is the schema of the stream before the
    aggregate. Rows that came later than the watermark allows are in neither, as
    the engine drops them.
    """
    kinds = [f for f in columns.fields if f.name not in (key, seq)]
    state = spark.read.format("statestore").load(checkpoint)
    # The state holds, for each column, its last value and the place of that value.
    order = columns[seq].dataType.simpleString()
    fields = ",".join(f"v{k}:{f.dataType.simpleString()},o{k}:{order}" for k, f in enumerate(kinds))
    held = state.select(F.col(f"key.{key}").cast("timestamp_ntz").alias(key), F.col("value").cast(f"struct<{fields}>"))
    return held.select(key, *[F.col(f"value.v{k}").alias(f.name) for k, f in enumerate(kinds)])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is available now and append it as parquet (exactly once)."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_envelopes(
    spark: SparkSession, path: str, *, multi_line: bool = False, max_files: int = 1000
) -> DataFrame:
    """Landed responses as a stream of log rows, cleaned."""
    envelopes = (
        spark.readStream.schema(ENVELOPE)
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
    return build_log_frame(envelope_rows(envelopes))


def stream_log_scores(
    stream: DataFrame,
    vectors: DataFrame,
    forest: DataFrame,
    path: str,
    checkpoint: str,
    *,
    key: str,
    message: str = "message",
) -> StreamingQuery:
    """Embed each micro-batch and score it against a stored forest.

    Vectors to score are dealt out by rows, as their bytes say nothing of the
    work. A message has one vector and so one score, found once in a batch and
    joined back by the message's hash. A batch overwrites its own ``batch=N`` folder, so a batch that is run again
    after a failure leaves no double rows.
    """
    packed = rcf_pack(forest)
    words = sized_broadcast(vectors)

    def score(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read three times below
        hashed = F.unhex(F.sha2(F.col(message), 256)).alias("_message")
        texts = batch.select(hashed, message).dropDuplicates(["_message"])
        embedded = embed_lookup(texts, words, key="_message", text=message).select("_message", "features")
        cores = batch.sparkSession.sparkContext.defaultParallelism
        known = embedded.filter(F.col("features").isNotNull())
        known = known.repartition(max(cores, -(-batch.count() // SCORE_ROWS)))
        scores = rcf_score_against(known, packed).select("_message", "score")
        scored = batch.withColumn("_message", hashed).join(scores, "_message", "left").drop("_message")
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
