"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame functions only.

Sources, ordered by code point, weigh a repeating list of weights and share the
words of all documents; what a source would get beyond ``most`` times its own
words is shared anew among the others, by weight.

Each source's documents stand in a seeded order (by the hash of id and text) and
its words are cut into blocks of equally many. Blocks are the seats: the next
one goes to the source with the highest quotient target / (2 * seats + 1). All
but a few seats around the last quotient follow from a divisor in closed form;
only those few are ranked. The seats of the first 1, 2, ... shards give each
shard whole numbers of blocks from each source, and a shard takes its source's
next blocks in the seeded order, round and round.

Positions come from sums per (source, hash range), of slim rows without texts:
hash ranges are even whatever source, id or text is frequent, rows alike are
summed before the shuffle, and no window spans more than one range's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmetrics.llm.frames import col, without
from logmetrics.operators.positions import row_index
from logmetrics.session import materialize, sized_broadcast

#: Words are runs of anything but space, tab and line or page breaks.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST = 3
SHARDS = 16
SEED = 23
#: Words in a block at most; fewer where the smallest source is small.
BLOCK_WORDS = 1024
#: Rows that one hash range of a source should hold.
RANGE_ROWS = 4096
ADDED = ("size", "source_size", "target", "taken", "pieces")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _whole(number: int) -> Column:
    return F.lit(number).cast("decimal(19,0)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, nr, weight, target).

    A source's share of all words by weight, at most ``most`` times its own; the
    excess is shared anew by weight until no source is above.
    """
    ranked = row_index(sizes.select((F.col("source").isNull()).alias("_last"), "source", "source_size"), "_last", "source", name="nr")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nr") % len(weights) + 1).cast("int")).cast("bigint")
    sources = materialize(ranked.drop("_last").withColumn("weight", weight), "sources")
    limit = F.col("source_size") * most
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    capped, words, shares = -1, total, None
    while True:  # every round stops one more source at least, or is the last
        # Exact in whole numbers: weight * words / shares against the limit.
        full = F.lit(False) if shares is None else F.col("weight") * _whole(words) > limit * _whole(shares)
        row = sources.agg(
            F.count_if(full).alias("full"),
            F.sum(F.when(full, limit)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("shares"),
        ).first()
        if row["full"] == capped or not row["shares"]:
            break
        capped, words, shares = row["full"], total - (row["held"] or 0), row["shares"]
    share = (F.col("weight") * words).cast("double") / F.lit(shares or 1)
    return sources.withColumn("target", F.least(share, limit.cast("double")))


def block_words(sources: DataFrame, most: int = BLOCK_WORDS) -> int:
    """Words of a block: a 256th of the smallest source that has words, 1 at least."""
    least = sources.where("source_size > 0").agg(F.min("source_size").alias("n")).first()["n"] or 1
    return max(1, min(most, least // 256))


def shard_quotas(sources: DataFrame, shards: int = SHARDS, words: int = 1) -> DataFrame:
    """``sources`` with ``cuts``: the first block of each shard, and the end, among the source's awards.

    Seats are given to the highest quotients, ties to the earlier source: shard
    k gets those between the first k and k + 1 shares of all blocks.
    """
    whole = sources.agg(F.sum("source_size").alias("n"), F.count_if(F.col("target") > 0).alias("k")).first()
    total, k = whole["n"] or 1, whole["k"]  # targets share out all words
    seats = ((whole["n"] or 0) + words // 2) // words
    house = F.array(*[F.lit(s * seats // shards).cast("bigint") for s in range(1, shards + 1)])
    rounds = sources.where("target > 0").select("nr", "target", F.posexplode(house).alias("shard", "house"))
    # With divisor d a source has target / d seats, half a seat more or less. So the divisor
    # that fills the house lies between these two; seats in between are ranked, others are sure.
    quotient = lambda seat: F.col("target") / (2 * seat + 1)
    low = F.greatest(F.lit(0), F.floor(F.col("target") * (F.col("house") - k / 2.0) / total - 0.5) - 1)
    high = F.ceil(F.col("target") * (F.col("house") + k / 2.0) / total + 0.5) + 1
    sure = rounds.withColumn("sure", F.least(low, F.col("house")).cast("bigint"))
    open_ = sure.select(
        "shard", "house", "nr", "target", "sure", F.explode(F.sequence(F.col("sure"), high.cast("bigint"))).alias("seat")
    ).withColumn("quotient", quotient(F.col("seat")))
    left = sure.groupBy("shard").agg((F.first("house") - F.sum("sure")).alias("left"))
    by = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), "nr", "seat")
    won = open_.withColumn("place", F.row_number().over(by)).join(F.broadcast(left), "shard").where("place <= left")
    extra = won.groupBy("shard", "nr").agg(F.count(F.lit(1)).alias("extra"))
    seated = sure.join(extra, ["shard", "nr"], "left").select(
        "nr", "shard", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("seats")
    )
    ends = seated.groupBy("nr").agg(F.sort_array(F.collect_list(F.struct("shard", "seats")))["seats"].alias("cuts"))
    none = F.array_repeat(F.lit(0).cast("bigint"), shards)
    cuts = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("cuts", none))
    return sources.join(ends, "nr", "left").withColumn("cuts", cuts)


def word_places(rows: DataFrame, sizes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(source, hash, size, more columns) with ``before``: words of the source ahead of each row.

    ``sizes`` has the rows ``n`` of each source. The order in a source is by
    hash and then by the remaining columns. Rows alike in all columns are
    counted before they move and spread again after.
    """
    names = rows.columns
    ranges = F.ceil(F.col("n") / range_rows)
    bucket = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32))
    alike = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_alike"))
    counts = sized_broadcast(sizes.select(F.col("source").alias("_s"), "n"))
    alike = alike.join(counts, F.col("source").eqNullSafe(F.col("_s"))).select(*names, "_alike", bucket.alias("_range"))
    alike = materialize(alike, "ranges")
    words = F.col("size") * F.col("_alike")
    # One row per source and range, a few thousand documents each.
    sums = alike.groupBy("source", "_range").agg(F.sum(words).alias("_words"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("source", "_range", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead")), "sums")
    inside = Window.partitionBy("source", "_range").orderBy("hash", *[c for c in names if c not in ("source", "hash")])
    within = F.coalesce(F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = alike.withColumn("_within", within)
    sums = sized_broadcast(sums.withColumnsRenamed({"source": "_s", "_range": "_r"}))
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_alike") - 1)).alias("_copy")
    spread = joined.select(*names, "_ahead", "_within", copy)
    return spread.select(*names, (F.col("_ahead") + F.col("_within") + F.col("_copy") * F.col("size")).alias("before"))


def order_hash(id_col: str, text_col: str, seed: int) -> Column:
    """What a source's rows are ordered by; null ids and texts count as empty ones."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def _pieces(most: int, words: int) -> Column:
    """Spans of a row that the shards take: in each round of its source, its words meet the shards' blocks."""
    limit = F.col("source_size") * most
    first = lambda k: F.least(F.col("cuts")[k] * words, limit)
    end = F.least(F.element_at("cuts", -1) * words, limit)

    def meet(start: Column) -> Column:
        """Pieces of one round, in which the row's words begin at ``start`` of all the source's taken words."""
        stop = F.least(start + F.col("size"), end)
        # Shards whose blocks begin at or before a word; cuts ascend.
        at = lambda word: F.size(F.filter("cuts", lambda c: c * words <= word)) - 1
        shards = F.sequence(at(start), F.least(at(stop - 1), F.size("cuts") - 2))
        spans = F.transform(
            shards,
            lambda k: F.struct(
                k.alias("shard"),
                (F.greatest(first(k), start) - start).alias("begin"),
                (F.least(first(k + 1), stop) - start).alias("end"),
            ),
        )
        spans = F.filter(spans, lambda p: p["end"] > p["begin"])
        none = F.array().cast("array<struct<shard:int,begin:bigint,end:bigint>>")
        return F.when((F.col("size") > 0) & (start < end), spans).otherwise(none)

    return F.flatten(F.array(*[meet(F.col("before") + F.col("source_size") * r) for r in range(most)]))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    shards: int = SHARDS,
    seed: int = SEED,
    words: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, pieces), one row for each of ``docs``.

    ``size`` is the number of words; ``target`` the words wanted of its source;
    ``taken`` the words of this row that the mix takes, repeats counted;
    ``pieces`` lists (shard, begin, end) word spans of the row, one for each
    shard and round that takes them. A source's taken words differ from its
    target by about a block (``words``, by default at most a 256th of the
    smallest source); no row is taken more than ``most`` times.

    A null text has no words, is never taken and stays; a null source is a
    source of its own, the last one; a null id counts as an empty one; repeated
    rows are taken like any others; an empty table gives an empty one; other
    columns are not carried (texts do not move: join by id, or see
    :func:`mixed_texts`). The result depends on ids, texts and sources only, not
    on how the rows are split.
    """
    slim = docs.select(
        col(source_col).cast("string").alias("source"),
        col(id_col).alias("id"),
        n_words(col(text_col)).alias("size"),
        order_hash(id_col, text_col, seed).alias("hash"),
    )
    slim = materialize(slim, "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "sizes")
    placed = word_places(slim, sizes, range_rows)
    sources = source_targets(sizes, weights, most)
    words = words or block_words(sources)
    quotas = materialize(shard_quotas(sources, shards, words), "quotas")
    quotas = sized_broadcast(quotas.select(F.col("source").alias("_s"), "source_size", "target", "cuts"))
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("_s")))
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["end"] - p["begin"])
    return (
        joined.withColumn("pieces", _pieces(most, words))
        .withColumn("taken", taken)
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), *ADDED, "hash")
    )


def mixed_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    **options,
) -> DataFrame:
    """The mix itself: a row of ``docs`` for each piece a shard takes, its text the piece's words.

    Added: ``shard``, ``begin`` and ``end``; columns of these names are
    replaced. Words are joined by single spaces. Rows and pieces meet by the
    hash that orders them; of rows alike in id, text and source one lends its
    other columns to all their pieces.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, seed=seed, **options)
    pieces = mixed.select(F.col("hash").alias("_hash"), col(source_col).alias("_s"), F.explode("pieces").alias("_p"))
    docs = without(docs, "shard", "begin", "end")
    once = docs.withColumn("_h", order_hash(id_col, text_col, seed)).dropDuplicates(["_h", source_col])
    same = (F.col("_hash") == F.col("_h")) & F.col("_s").eqNullSafe(col(source_col).cast("string"))
    words = F.regexp_extract_all(col(text_col), F.lit(WORD), F.lit(0))
    begin, end = (F.col(f"_p.{c}").cast("int") for c in ("begin", "end"))
    piece = F.array_join(F.slice(words, begin + 1, end - begin), " ").alias(text_col)
    return pieces.join(once, same).select(
        *[piece if c == text_col else col(c) for c in docs.columns],
        *[F.col(f"_p.{c}").alias(c) for c in ("shard", "begin", "end")],
    )
