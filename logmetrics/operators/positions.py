"""Positions in an order: row numbers, slices, splits and chunk halos.

A plain ``row_number() over (order by ..)`` sends every row to one task. Here
the rows are range partitioned on the whole order (unique tiebreak included, so
a timestamp shared by a third of the rows still spreads), sorted inside each
partition, and numbered by partition offset plus place in the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmetrics.operators.selection import row_at
from logmetrics.session import materialize

# monotonically_increasing_id(): partition in the bits above 33, place below.
_PLACE_BITS = 33
_PLACE_MASK = (1 << _PLACE_BITS) - 1


def row_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Add the zero-based position of each row in ``order`` (must be unique).

    The sorted rows are written once: sampled range bounds may differ between
    two runs of the same plan, and the counts must match the rows they number.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    stored = materialize(ordered, "ordered")
    part = F.shiftright("_slot", _PLACE_BITS).alias("_part")
    # One row per range partition, so this window and the broadcast are bounded
    # by the number of shuffle partitions.
    offsets = (
        stored.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
        )
    )
    place = F.col("_slot").bitwiseAND(F.lit(_PLACE_MASK))
    return (
        stored.withColumn("_part", F.shiftright("_slot", _PLACE_BITS))
        .join(F.broadcast(offsets), "_part")
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place).alias(name))
    )


def shuffled_index(
    df: DataFrame, key: str, *, seed: int, n: int, rounds: int = 1, name: str = "pos"
) -> DataFrame:
    """Position of each row in ``rounds`` repeatable random orders.

    Order ``r`` sorts by ``md5(seed:r:key)`` and then by key, so the same seed
    gives the same permutation under any partitioning. Hash prefixes are even
    by construction (``key`` is unique), so prefix buckets need no range
    sampling: count per prefix, add up, number inside the prefix.
    """
    digits = 2
    while digits < 5 and n * rounds > 50_000 * 16**digits:
        digits += 1
    hashed = df.withColumn(
        "round",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")))
        if rounds > 1
        else F.lit(0).cast("long"),
    ).withColumn("_hash", round_hash(seed, F.col("round"), F.col(key)))
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    # At most 16**digits rows per round; more than one round only happens for
    # inputs smaller than the forest itself.
    offsets = (
        bucketed.groupBy("round", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "round",
            "_bucket",
            (
                F.sum("_n").over(Window.partitionBy("round").orderBy("_bucket")) - F.col("_n")
            ).alias("_before"),
        )
    )
    inside = Window.partitionBy("round", "_bucket").orderBy("_hash", key)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["round", "_bucket"])
        .select(
            *df.columns,
            "round",
            (F.col("_before") + F.col("_rn") - 1).alias(name),
        )
    )


def round_hash(seed: int, round_: Column, key: Column) -> Column:
    """The hash whose order is the random order of one round."""
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), round_.cast("string"), key.cast("string")).cast("binary")
    )


def sample_every(
    df: DataFrame, *order: str, offset: int = 5, step: int = 6, name: str = "idx"
) -> DataFrame:
    """Keep the rows at positions offset, offset+step, offset+2*step, ..."""
    idx = F.col(name)
    return row_index(df, *order, name=name).filter((idx >= offset) & ((idx - offset) % step == 0))


def slice_rows(
    df: DataFrame, *order: str, start: int = 0, stop: int | None = None, name: str = "idx"
) -> DataFrame:
    """Rows at positions start (included) to stop (excluded)."""
    indexed = row_index(df, *order, name=name).filter(F.col(name) >= start)
    return indexed if stop is None else indexed.filter(F.col(name) < stop)


def head_rows(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows (a per-task top-n, no full sort)."""
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, idx: str, n: int = 30) -> DataFrame:
    """The last ``n`` rows by a position column."""
    return df.orderBy(F.col(idx).desc()).limit(n)


def tail_numbered(df: DataFrame, *order: str, n: int = 30, name: str = "line_no") -> DataFrame:
    """The last ``n`` rows of an order with their 1-based place in it.

    A count and a per-task top-n on the order's own columns; only ``n`` rows are
    sorted and numbered.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    back = [F.col(f"`{c}`").desc() for c in order]
    place = F.row_number().over(Window.orderBy(*back))
    return df.orderBy(*back).limit(n).withColumn(name, total - place + 1)


def take_record(df: DataFrame, *order: str, index: int) -> DataFrame:
    """The row with this 1-based ordinal; no row below 1 or above the count.

    Found by counting (see :func:`logmetrics.operators.selection.row_at`): the
    table is neither sorted nor written.
    """
    return row_at(df, index - 1, *order)


def take_entry(entries: Column, index: Column | int) -> Column:
    """Array form of :func:`take_record`: null below 1 or above the size."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.when(i >= 1, F.try_element_at(entries, i))


def chrono_split(
    df: DataFrame,
    *order: str,
    train: float = 0.7,
    validation: float = 0.9,
    name: str = "idx",
    indexed: bool = False,
) -> DataFrame:
    """Tag rows train, validation or test by position.

    ``indexed`` rows have their position in ``order`` as column ``name`` already.

    The cut points are floors of double products, as in the reference: 90 * 0.7
    is below 63 in double arithmetic.
    """
    placed = df if indexed else row_index(df, *order, name=name)
    n = placed.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    split = (
        F.when(F.col(name) < F.floor(n * F.lit(train)), "train")
        .when(F.col(name) < F.floor(n * F.lit(validation)), "validation")
        .otherwise("test")
    )
    return placed.withColumn("split", split)


def with_halo(
    df: DataFrame, idx: str, *, size: int, chunk: int = 4096, following: bool = False
) -> DataFrame:
    """Cut a long order into equal chunks that overlap by ``size - 1`` rows.

    Adds ``_chunk`` and ``_halo``. A row frame of ``size`` rows inside a chunk
    then sees the rows it needs, with no window over the whole series; the
    copies have ``_halo = true`` and must not produce output.
    """
    if chunk < size - 1:
        raise ValueError("chunk must hold at least size - 1 rows")
    home = F.expr(f"`{idx}` div {chunk}")
    place = F.col(idx) % chunk
    if following:
        copied, other = place < size - 1, home - 1
    else:
        copied, other = place >= chunk - (size - 1), home + 1
    homes = F.when(copied, F.array(home, other)).otherwise(F.array(home))
    return df.withColumn("_chunk", F.explode(homes)).withColumn(
        "_halo", F.col("_chunk") != home
    )
