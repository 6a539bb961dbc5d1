"""Named event intervals (closed at both ends) against a time column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmetrics.session import materialize, release, sized_broadcast


@dataclass(frozen=True)
class Interval:
    event: str
    start: datetime
    end: datetime
    suffix: str | None = None


def label_intervals(
    df: DataFrame,
    intervals: Sequence[Interval] | DataFrame,
    *,
    ts: str = "ts",
    name: str = "event",
) -> DataFrame:
    """Flag rows whose time lies in any interval: 1, else 0.

    A list in the caller's program becomes an expression on each row: no join,
    no shuffle. A table goes through :func:`sweep_intervals`, whatever its size;
    its rows never come to the driver. Either way an interval with an open
    (null) bound holds nothing, times are compared without a zone, and a column
    of the flag's name is replaced.
    """
    if isinstance(intervals, DataFrame):
        return sweep_intervals(df, intervals, ts=ts, name=name)
    spans = _disjoint([(i.start, i.end) for i in intervals])
    inside = _any([_at(ts).between(_stamp(a), _stamp(b)) for a, b in spans])
    return df.withColumn(name, F.when(inside, 1).otherwise(0))


def sweep_intervals(
    df: DataFrame, intervals: DataFrame, *, ts: str = "ts", name: str = "event"
) -> DataFrame:
    """Flag rows by the number of intervals open at their time.

    Starts (+1), rows (0) and ends (-1) are range partitioned on (time, kind,
    row hash): the open count before a partition is a sum over earlier
    partitions, the count inside it a running sum. Work is one sort of rows
    plus twice the intervals, whatever their overlap.
    """
    kept = [f for f in df.schema.fields if f.name != name or name == ts]
    hashed = [F.col(f"`{f.name}`") for f in kept if "map<" not in f.dataType.simpleString()]
    rows = df.select(
        F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("_row"),
        F.xxhash64(*hashed).alias("_spread"),
        _at(ts).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("_step"),
    )
    real = intervals.filter(F.col("start") <= F.col("end"))
    empty = F.lit(None).cast(rows.schema["_row"].dataType)
    opens = F.struct(_at("start").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_s"))
    closes = F.struct(_at("end").alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).alias("_s"))
    edges = (
        real.select(F.inline(F.array(opens, closes)))
        .groupBy("_at", "_kind")
        .agg(F.sum("_s").alias("_step"))
        .withColumns({"_row": empty, "_spread": F.lit(0).cast("long")})
    )
    # The hash spreads rows of one hot timestamp over several partitions.
    keyed = rows.unionByName(edges)
    order = ["_at", "_kind", "_spread"]
    stored = materialize(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "sweep",
    ).withColumn("_part", F.shiftright("_slot", 33))
    before = stored.groupBy("_part").agg(F.sum("_step").alias("_sum")).select(
        "_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_open")
    )
    running = F.sum("_step").over(
        Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        stored.withColumn("_run", running)
        .join(F.broadcast(before), "_part")
        .filter(F.col("_row").isNotNull())
        .select("_row.*", F.when(F.col("_open") + F.col("_run") > 0, 1).otherwise(0).alias(name))
    )


def inject_events(
    df: DataFrame,
    intervals: Sequence[Interval],
    *,
    ts: str = "time",
    message: str = "message",
) -> DataFrame:
    """Overwrite messages inside each interval, in order.

    The new text is the message at exactly ``start`` plus a blank and the
    suffix; a later interval reads and overwrites the result of earlier ones.
    Times must be unique (see ``last_per_key``). A start without a row is an
    error. The intervals are a list in the caller's program; only the rows at
    their starts come to the driver.
    """
    starts = sorted({i.start for i in intervals})
    found = (
        df.filter(F.col(ts).isin([_stamp(s) for s in starts]))
        .groupBy(ts)
        .agg(F.max(message).alias(message))
        .collect()
    )
    original = {r[ts]: r[message] for r in found}
    texts: list[tuple[Interval, str | None]] = []
    for interval in intervals:
        if interval.start not in original:
            raise KeyError(f"no row at the start of {interval.event}: {interval.start}")
        base = original[interval.start]
        for earlier, text in texts:
            if earlier.end is not None and earlier.start <= interval.start <= earlier.end:
                base = text
        suffix = interval.event if interval.suffix is None else interval.suffix
        texts.append((interval, None if base is None else f"{base} {suffix}"))
    # The last interval that covers a row wins; one flat choice, however many there are.
    choices = [
        F.when(
            F.col(ts).between(_stamp(interval.start), _stamp(interval.end)),
            F.struct(F.lit(text).cast("string").alias("text")),
        )
        for interval, text in reversed(texts)
        if interval.end is not None
    ]
    kept = F.struct(F.col(message).cast("string").alias("text"))
    return df.withColumn(message, F.coalesce(*choices, kept)["text"])


def _micros(column: str) -> Column:
    """Microseconds of a time without a zone, counted from a time before all others."""
    days = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") + 1_000_000
    clock = (F.hour(column) * 3600 + F.minute(column) * 60).cast("bigint") * 1_000_000
    second = (F.expr(f"extract(SECOND FROM `{column}`)") * 1_000_000).cast("bigint")
    return days * 86_400_000_000 + clock + second


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each interval (ord, s, e) as few aligned stretches: 2**level moments beginning at place * 2**level."""
    for batch in batches:
        number, low, high = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in range(3))
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        for level in range(63):
            left = (low <= high) & (low & 1 == 1)
            out.append((number[left], level, low[left]))
            low[left] += 1
            right = (low <= high) & (high & 1 == 0)
            out.append((number[right], level, high[right]))
            high[right] -= 1
            going = low <= high
            number, low, high = number[going], low[going] >> 1, high[going] >> 1
            if not len(number):
                break
        levels = np.concatenate([np.full(len(n), level, np.int32) for n, level, _ in out])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([n for n, *_ in out])), pa.array(levels), pa.array(np.concatenate([p for *_, p in out]))],
            ["ord", "level", "place"],
        )


def inject_events_of_table(
    df: DataFrame,
    intervals: DataFrame,
    *,
    ts: str = "time",
    message: str = "message",
) -> DataFrame:
    """:func:`inject_events` with a table (ord, event, start, end, suffix) of any size; ``ord`` is unique.

    Every interval falls into a few aligned stretches of time per length; a
    moment lies in one stretch of each length. So the last interval that covers
    a row is the largest ``ord`` among the stretches above its time, kept once
    per stretch, and the one that an interval's own start lies in is found the
    same way among smaller ordinals. Texts follow from chains of such starts,
    whose links double in length each round. Intervals never come to the driver
    and no interval meets all rows inside it.

    Times of ``df`` must be unique; a start without a row is an error; an
    interval without an end, or one that ends before it starts, covers nothing;
    a missing suffix is the event's name.
    """
    table = intervals.select(
        F.col("ord").cast("bigint").alias("ord"),
        F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("end").cast("timestamp_ntz").alias("end"),
        F.coalesce("suffix", "event").alias("suffix"),
    )
    rows = df.select(_at(ts).alias("_t"), F.col(message).cast("string").alias("base"))
    begun = materialize(table.join(rows, F.col("start") == F.col("_t"), "left"), "starts")
    lost = begun.where("_t IS NULL").select("ord", F.col("start").cast("string").alias("start")).orderBy("ord").first()
    if lost is not None:
        raise KeyError(f"no row at the start of interval {lost['ord']}: {lost['start']}")
    spans = begun.where("start <= end").select("ord", _micros("start").alias("s"), _micros("end").alias("e"))
    stretches = materialize(spans.mapInArrow(_aligned, "ord bigint, level int, place bigint"), "stretches")
    levels = sorted(r["level"] for r in stretches.select("level").distinct().collect())  # 63 at most

    def above(times: DataFrame) -> DataFrame:
        """Every time with the stretches it lies in."""
        each = times.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
        return each.withColumn("place", F.expr("shiftright(at, level)"))

    # The nearest smaller ordinal among the stretches above each start.
    asked = above(begun.select("ord", _micros("start").alias("at")))
    held = stretches.select("level", "place").distinct()
    asked = asked.join(held, ["level", "place"], "left_semi").select("level", "place", "ord", F.lit(1).alias("kind"))
    sorted_ = Window.partitionBy("level", "place").orderBy("ord", F.col("kind").desc())
    before = F.last(F.when(F.col("kind") == 0, F.col("ord")), ignorenulls=True).over(sorted_)
    both = stretches.select("level", "place", "ord", F.lit(0).alias("kind")).unionByName(asked)
    parents = both.withColumn("up", before).where("kind = 1").groupBy("ord").agg(F.max("up").alias("up"))
    chain = begun.join(parents, "ord", "left").select(
        "ord", "up", F.when(F.col("up").isNull(), F.col("base")).alias("base"), F.concat(F.lit(" "), "suffix").alias("tail")
    )
    chain = materialize(chain, "chain")
    while not chain.where("up IS NOT NULL").isEmpty():
        upper = chain.select(
            F.col("ord").alias("_o"), F.col("up").alias("_up"), F.col("base").alias("_base"), F.col("tail").alias("_tail")
        )
        linked = chain.join(upper, F.col("up") == F.col("_o"), "left")
        root = F.col("up").isNull()
        longer = materialize(
            linked.select(
                "ord",
                F.when(~root, F.col("_up")).alias("up"),
                F.when(root, F.col("base")).otherwise(F.col("_base")).alias("base"),
                F.when(root, F.col("tail")).otherwise(F.concat("_tail", "tail")).alias("tail"),
            ),
            "chain",
        )
        release(chain)
        chain = longer
    texts = chain.select("ord", F.concat("base", "tail").alias("_text"))
    tops = stretches.groupBy("level", "place").agg(F.max("ord").alias("ord"))
    times = above(rows.select("_t", _micros("_t").alias("at")))
    last = times.join(sized_broadcast(tops), ["level", "place"]).groupBy("_t").agg(F.max("ord").alias("ord"))
    new = last.join(sized_broadcast(materialize(texts, "texts")), "ord").select("_t", "_text", F.lit(True).alias("_hit"))
    changed = F.when(F.col("_hit"), F.col("_text")).otherwise(F.col(message).cast("string"))
    out = df.join(new, _at(ts) == F.col("_t"), "left").withColumn(message, changed)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def attach_scores(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores put back on the source rows; rows without a score keep null."""
    return rows.join(scores, key, "left")


def _at(column: str) -> Column:
    """A time without a zone; times with one are read in the session's zone."""
    return F.col(column).cast("timestamp_ntz")


def _any(tests: list[Column]) -> Column:
    """Whether any test holds, as a balanced tree of any length."""
    if len(tests) <= 1:
        return tests[0] if tests else F.lit(False)
    return _any(tests[: len(tests) // 2]) | _any(tests[len(tests) // 2 :])


def _stamp(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _disjoint(spans: list[tuple[datetime, datetime]]) -> list[tuple[datetime, datetime]]:
    merged: list[tuple[datetime, datetime]] = []
    known = [s for s in spans if s[0] is not None and s[1] is not None]
    for start, end in sorted(s for s in known if s[0] <= s[1]):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged

