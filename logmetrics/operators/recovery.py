"""Where an interrupted run goes on, and what to report about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resume_point(state: DataFrame, rate: float) -> DataFrame:
    """Adds ``rewound_epoch`` = int(epochs * rate), not below 0, and the epoch to
    go on from, which is that one for a run in recovery and else 0."""
    rewound = F.greatest(F.floor(F.col("epochs") * F.lit(float(rate))), F.lit(0)).cast("long")
    return state.withColumn("rewound_epoch", rewound).withColumn(
        "resume_epoch", F.when(F.col("recovery"), rewound).otherwise(F.lit(0)).cast("long")
    )


def restore_epoch(resumed: DataFrame, checkpoints: DataFrame, weights: str = "latest") -> DataFrame:
    """Adds the checkpoint to load; null when the run is not in recovery.

    ``latest`` takes the newest weights although the epoch is rewound, as the
    reference does; ``resume_epoch`` takes the weights of the epoch resumed from.
    """
    if weights not in ("latest", "resume_epoch"):
        raise ValueError(weights)
    newest = checkpoints.select("run_id", F.col("epoch").cast("long").alias("_newest"))
    chosen = F.col("_newest") if weights == "latest" else F.col("resume_epoch")
    return (
        resumed.join(newest, "run_id", "left")
        .withColumn("load_epoch", F.when(F.col("recovery"), chosen))
        .drop("_newest")
    )


# The texts of the reports.
COMPLETED, POINT = " completed. (recovery)", " recovery point."
NOT_FOUND = "Not found recovery point."


def recovery_epochs(resumed: DataFrame, text: str = COMPLETED) -> DataFrame:
    """One row per recovered epoch, "i of max" and ``text`` (``COMPLETED`` or ``POINT``)."""
    # sequence(1, 0) would count down, so runs without epochs are left out first.
    some = resumed.filter(F.col("recovery") & (F.col("resume_epoch") > 0))
    return some.select(
        "run_id",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("resume_epoch"))).alias("epoch"),
        F.col("max_epochs").cast("long").alias("max_epochs"),
    ).withColumn(
        "line",
        F.concat(
            F.lit("Epoch "), F.col("epoch").cast("string"), F.lit("/"),
            F.col("max_epochs").cast("string"), F.lit(text),
        ),
    )


def recovery_report(resumed: DataFrame) -> DataFrame:
    """One row per run: resumed share in percent, latest and target epoch, note.

    The latest epoch is the rewound one whether or not the run is in recovery;
    the history's own target (``history_target``, runs in recovery only) is the
    last epoch itself, the interrupt report's the one after it.
    """
    share = F.col("resume_epoch") / F.nullif(F.col("epochs"), F.lit(0)) * F.lit(100)
    return resumed.select(
        "run_id",
        F.when(F.col("recovery"), F.floor(share).cast("long")).alias("recover_rate"),
        F.col("rewound_epoch").alias("interrupt_latest"),
        (F.col("epochs") + 1).cast("long").alias("interrupt_target"),
        F.when(F.col("recovery"), F.col("epochs").cast("long")).alias("history_target"),
        F.when(F.col("recovery"), "recovery").otherwise(NOT_FOUND).alias("note"),
    )


def history_table(ledger: DataFrame) -> DataFrame:
    """(run_id, part, epoch, metric, value): ``val_`` metrics are the validation part.

    One value for each metric of an epoch: an epoch trained again after a resume
    counts as last trained, and closing rows (``recovery`` = false) do not count.
    """
    trained = ledger.filter((F.col("epoch") > 0) & F.col("recovery"))
    last = trained.groupBy("run_id", "epoch").agg(F.max_by("metrics", "seq").alias("metrics"))
    long = last.select(
        "run_id", F.col("epoch").cast("long").alias("epoch"), F.explode("metrics")
    )
    held = F.col("key").startswith("val_")
    return long.select(
        "run_id",
        F.when(held, "validation").otherwise("train").alias("part"),
        "epoch",
        F.when(held, F.substring("key", 5, 1000)).otherwise(F.col("key")).alias("metric"),
        "value",
    )


def history_bounds(history: DataFrame, shift: float = 0.05) -> DataFrame:
    """Axis bounds per run and metric over both parts."""
    return history.groupBy("run_id", "metric").agg(
        (F.min("value") - F.lit(shift)).alias("low"),
        (F.max("value") + F.lit(shift)).alias("high"),
    )
