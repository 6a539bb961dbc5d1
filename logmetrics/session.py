"""Session helpers: time zone, shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on; all can change at run time.

    Timestamps here are zone-less and epoch conversions read them as UTC.

    Joins are planned on measured sizes only. Estimates made before the run
    take exploded terms to be as small as the texts' file and would broadcast
    them; so only hints (see :func:`sized_broadcast`) and the sizes adaptive
    execution sees may lead to a broadcast, and a join whose measured
    partitions are small enough hashes one side instead of sorting both.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32m")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    return spark


def spread(scan: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """Deal the rows of a plain scan out over the cores when it has fewer tasks,
    and over more tasks than cores when each would have more than ``rows``.

    For costly per-row work on few large row groups; what a task holds does not
    grow with the table. A scan with enough tasks is left alone. Not for frames
    that already shuffle: asking for their task count would run them.
    """
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, *keys)


def sized_broadcast(table: DataFrame, limit: int = 64 * 1024 * 1024) -> DataFrame:
    """``table`` with a broadcast hint when it measures below ``limit`` bytes.

    One pass over a stored table; a larger one keeps no hint and joins by
    shuffle.
    """
    parts = []
    for field in table.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            parts.append(F.greatest(F.size(column), F.lit(0)) * 8)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2)
    row = sum(parts, F.lit(8 * len(table.columns) + 32)).cast("long")
    measured = table.agg(F.sum(row).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(table) if measured <= limit else table


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logmetrics-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/logmetrics/{label}-{uuid.uuid4().hex}"


#: Whether shuffle files go as soon as their query ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "stage", cleared: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later stages see the same rows whatever executors are lost, and a plan that
    uses the result twice does not compute it twice. Columnar, so each reader
    still prunes columns and pushes filters. ``cleared`` drops the shuffle files
    of the write with its end, for loops that would pile them up; nothing that is
    still to run may share them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if cleared else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete the folders of tables that :func:`materialize` returned and nothing reads any more.

    For loops that replace a table step by step. Frames derived from a stored
    one, and others, are left alone.
    """
    for df in stored:
        path = df.__dict__.pop("_stored_path", None)
        if path is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver runs from."""
    context = spark.sparkContext
    if getattr(context, "_logmetrics_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="logmetrics-")) / "logmetrics.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._logmetrics_shipped = True
