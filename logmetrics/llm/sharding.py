"""Shards of randomly ordered rows: a two-pass external shuffle, DataFrame functions only.

Pass one scatters rows by seeded hashes: the shard is the one whose hash with
the row's key is largest (so one more shard takes rows only into itself and none
move between the others), and inside a shard a second hash of the row's position
picks a bucket of about ``bucket_bytes``. Pass two collects each bucket, orders
it by hash, shuffles it with a Fisher-Yates shuffle and writes it to its shard's
folder. Slots count through a shard's buckets in order.

Buckets are sized from the measured bytes, so no task holds more than a few of
them; the second hash goes by position, so rows that are all alike spread too.
The position comes from the input's splits: ``docs`` must read a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmetrics.llm.frames import col, without
from logmetrics.session import materialize, scratch_path

ADDED = ("shard", "bucket", "place", "slot", "grown_shard")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is largest; a null key hashes as its own value."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("string"), F.lit("\u0000"))
    draws = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards)]
    return F.greatest(*draws)["k"] if shards > 1 else F.lit(0)


def text_bytes(text_col: str) -> Column:
    """Bytes of the text (none for null) plus 8."""
    return F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("bigint") + 8


def shuffle_shards(
    docs: DataFrame,
    shards: int,
    key_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
    bucket_bytes: int = 8 << 20,
    path: str | None = None,
) -> DataFrame:
    """Write ``docs`` as shuffled shards below ``path`` and return the written rows.

    Added columns: ``shard``; ``slot``, the row's place in its shard, gapless
    from 0; ``grown_shard``, the shard with one more shard. The files of a shard
    hold its rows in slot order.

    Null keys share a shard, null and empty texts count 8 bytes, equal keys share
    a shard, rows that are all alike each keep a slot, an empty table gives an
    empty one, columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, *ADDED)
    measured = docs.agg(F.sum(text_bytes(text_col)).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-measured // (shards * bucket_bytes)))
    path = path or scratch_path(spark, "shards")
    place = F.monotonically_increasing_id()
    rows = docs.withColumn("place", place).withColumn("shard", shard_of(col(key_col), shards, seed))
    bucket = F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(buckets))
    rows = rows.withColumn("bucket", (F.col("shard") * F.lit(buckets) + bucket).cast("bigint"))
    row = F.struct(F.xxhash64("place", F.lit(seed + 1)).alias("order"), "place", *[col(c) for c in docs.columns])
    # The order inside a bucket, and of buckets inside a task, does not depend on
    # the order in which rows arrive, so the seeded shuffle repeats exactly.
    # As many tasks as buckets, so that a task's share follows the buckets' size.
    dealt = rows.repartition(shards * buckets, "bucket")
    full = dealt.groupBy("bucket").agg(F.collect_list(row).alias("rows")).sortWithinPartitions("bucket")
    by_order = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).when(
        a["place"] < b["place"], -1
    ).otherwise(1)
    mixed = full.select("bucket", F.shuffle(F.array_sort("rows", by_order), seed).alias("rows"))
    out = mixed.select("bucket", F.posexplode("rows").alias("place", "row"))
    shard = F.expr(f"bucket div {buckets}").cast("int").alias("shard")
    out = out.select(*[F.col("row")[c].alias(c) for c in docs.columns], "bucket", "place", shard)
    out.sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(path)
    written = spark.read.schema(out.schema).parquet(path)
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = materialize(offsets, "offsets")
    slots = written.join(offsets, "bucket").withColumn("slot", F.col("before") + F.col("place"))
    slots = slots.withColumn("grown_shard", shard_of(col(key_col), shards + 1, seed))
    return slots.select(*[col(c) for c in docs.columns], "shard", "slot", "grown_shard")
