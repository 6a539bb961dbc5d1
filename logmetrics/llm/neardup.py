"""Near-duplicate classes: DartMinHash signatures, banded joins, checked links.

A document is a weighted set: its shingles of five words, each weighing one plus
the binary logarithm of how often it occurs. Darts are thrown at the plane of
weight and rank of every shingle; where and how many is a function of the
shingle alone, so two documents agree on every dart that falls in the region
both cover. A document keeps, for each of its signature's coordinates, the dart
of lowest rank below its weight; two documents keep the same one with a
probability equal to their weighted Jaccard similarity. The ranks looked at
shrink with the document's total weight, so a document catches about
``k (ln k + 4)`` darts whatever its length; the few that leave a coordinate
empty look twice as far.

Bands of four coordinates are joined. A bucket's documents are first compared
with its leader, the one whose buckets are largest, that is the text most
others were made from; a group of thousands costs about one comparison a
member. A bucket is settled when all its members are in one class. In every
other bucket each two members of different classes are compared: the members
are dealt into blocks of bounded size, those of the leader's class apart from
the others, and block meets block as two packed records, so no list of pairs is
made. Blocks of the leader's class never meet each other.

Pairs whose signatures agree in under 60 % of their coordinates are dropped (a
pair of similarity 0.8 does so once in 100,000 times), all others are checked
with the exact similarity of the whole texts, in the first bucket that they
share. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.frames import col, without
from logmetrics.llm.words import BLANK_WORDS, U, cut, grams, mix, seeded, slices, text_buffers
from logmetrics.session import materialize

SHINGLE = 5
BANDS, BAND_ROWS = 20, 4
#: Least share of coordinates in which the signatures of a checked pair agree.
AGREE = 0.6
#: About how many members, and bytes of their texts, a block of a mixed bucket has.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Length of the first cell of the rank axis; the next ones double.
FIRST = 2.0**-6


def shingle_weights(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all texts, each shingle of a text once.

    A text of fewer than five words, but not none, has one shingle of them all.
    """
    words = cut(data, offsets, BLANK_WORDS)
    full = grams(words.hash, SHINGLE)
    at = np.flatnonzero(words.left()[: len(full)] >= SHINGLE)
    doc, value = words.doc()[at], full[at]
    counts = words.counts
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        if len(short):
            doc = np.r_[doc, short]
            value = np.r_[value, grams(words.hash, size)[words.first[short]]]
    key = mix(value + doc.astype(U) * U(0x9E3779B97F4A7C15))
    _, index, count = np.unique(key, return_index=True, return_counts=True)
    return doc[index], value[index], 1 + np.log2(count)


def _unit(values: np.ndarray) -> np.ndarray:
    return (values >> U(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Distribution function of the number of darts in a cell of this area."""
    ks = np.arange(1, int(mean + 12 * mean**0.5 + 24))
    return np.cumsum(np.exp(-mean + np.r_[0, np.cumsum(np.log(mean / ks))]))


def _cells(low: float, first: float, high: float) -> list[tuple[float, float]]:
    """Cells from ``low`` on: one of length ``first``, then doubling, until ``high`` is covered."""
    cells, end = [], first
    while low < high:
        cells.append((low, end))
        low, end = end, end * 2
    return cells


def _darts(doc, shingle, weight, far, k: int):
    """(text, coordinate, rank, dart) of the darts within each text's region up to rank ``far[text]``."""
    out = []
    for v, (w_low, w_high) in enumerate(_cells(0.0, 1.0, weight.max(initial=0))):
        tall = np.flatnonzero(weight > w_low)
        for c, (r_low, r_high) in enumerate(_cells(0.0, FIRST, far.max(initial=0))):
            own = tall[far[doc[tall]] > r_low]
            if not len(own):
                continue
            seed = mix(shingle[own] + seeded(1, 1000 * v + c)[0])
            table = _poisson((w_high - w_low) * (r_high - r_low))
            unit = _unit(seed)
            some = np.flatnonzero(unit > table[0])
            number = np.searchsorted(table, unit[some])
            seed, own = np.repeat(seed[some], number), np.repeat(own[some], number)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
            seed = mix(seed + (nth.astype(U) + U(1)) * U(0xD1B54A32D192ED03))
            rank = r_low + (r_high - r_low) * _unit(seed)
            seed = mix(seed)
            height = w_low + (w_high - w_low) * _unit(seed)
            ok = np.flatnonzero((height < weight[own]) & (rank <= far[doc[own]]))
            dart = mix(seed[ok])
            out.append((doc[own[ok]], (dart >> U(32)) % U(k), rank[ok], dart))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, U, float, U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(doc, shingle, weight, n: int, k: int) -> np.ndarray:
    """n x k darts; rows of texts without shingles are 0."""
    out = np.zeros((n, k), U)
    total = np.bincount(doc, weight, minlength=n)
    throws = k * (np.log(k) + 4)
    far = np.divide(throws, total, out=np.zeros(n), where=total > 0)
    while len(doc):
        d, j, rank, dart = _darts(doc, shingle, weight, far, k)
        slot = d * k + j.astype(np.int64)
        order = np.lexsort((rank, slot))
        slot = slot[order]
        heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        out.reshape(-1)[slot[heads]] = dart[order[heads]]
        empty = np.zeros(n, bool)
        empty[doc] = True
        empty &= (out == 0).any(axis=1)
        again = empty[doc]
        doc, shingle, weight = doc[again], shingle[again], weight[again]
        far = far * 2 * empty
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """n x bands keys of equally many coordinates each."""
    n, k = signature.shape
    rows = signature.reshape(n, bands, k // bands)
    key = np.broadcast_to(seeded(bands, 3), (n, bands)).copy()
    for r in range(k // bands):
        key = mix(key + rows[:, :, r] * U(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _sign(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for begin, end in slices(offsets):
                part, n = offsets[begin : end + 1] - offsets[begin], end - begin
                doc, shingle, weight = shingle_weights(data[offsets[begin] : offsets[end]], part)
                has = np.bincount(doc, minlength=n) > 0
                darts = signatures(doc, shingle, weight, n, bands * rows)
                keys = band_keys(darts, bands)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1), pa.int64())
                )
                short = (darts >> U(48)).astype(np.uint16)
                size = np.diff(part).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), lists]
                    + [pa.array([row.tobytes() for row in short], pa.binary()), pa.array(size)],
                    ["id", "digest", "keys", "darts", "size"],
                ).filter(pa.array(has))

    return sign


def similarities(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(a)
    texts = pa.array([*a, *b], pa.binary()).cast(pa.string())
    doc, shingle, weight = shingle_weights(*text_buffers(texts))
    pair = doc % n
    total = np.bincount(pair, weight, minlength=n)
    key = mix(shingle + pair.astype(U) * U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    key, pair, weight = key[order], pair[order], weight[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), minlength=n)
    return np.divide(common, total - common, out=np.zeros(n), where=total > 0)


def _check(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Only one slice's texts are Python objects at a time, however large the batch.
            a, b = (pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            for begin, end in slices(np.concatenate([[0], np.cumsum(a + b)])):
                part = batch.slice(begin, end - begin)
                a, b = (part.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
                linked = similarities(a, b) >= threshold
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(linked)], ["node", "leader", "linked"])

    return check


def _alike(least: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16) for k in (2, 3))
            agree = (a == b).reshape(batch.num_rows, -1).mean(axis=1) if batch.num_rows else np.zeros(0)
            yield batch.select(["node", "leader"]).filter(pa.array(agree >= least))

    return alike


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(tile, its rows) for each stretch of rows of one tile, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        tile = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end == begin:
                continue
            if held and now != tile[begin]:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = tile[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield int(now), pa.Table.from_batches(held)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of ``a`` agrees with each row of ``b``."""
    if len(a) * len(b) <= 64:
        return (a[:, None] == b[None]).sum(axis=2)
    total = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        total += x[:, None] == y
    return total


def _meet(least: float):
    """One row for each tile that has pairs to check: the texts they need, and the pairs as places among these."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, table in _runs(batches):
            band = table.column("band")[0].as_py()
            sides = []
            for k in range(table.num_rows):
                rows = table.column("rows")[k].values
                n = len(rows)
                node, label = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label"))
                darts = np.frombuffer(b"".join(rows.field("darts").to_pylist()), np.uint16).reshape(n, -1)
                sides.append((node, label, darts, rows.field("keys").flatten().to_numpy().reshape(n, -1)))
            (a, a_label, a_darts, a_keys), (b, b_label, b_darts, b_keys) = sides[0], sides[-1]
            x, y = np.nonzero((agreement(a_darts, b_darts) >= least * a_darts.shape[1]) & (a_label[:, None] != b_label))
            if len(sides) == 1:
                x, y = x[x < y], y[x < y]
            first = [(a_keys[p] == b_keys[q]).argmax(axis=1) == band for p, q in zip(_parts(x), _parts(y), strict=True)]
            first = np.concatenate([np.zeros(0, bool), *first])
            x, y = x[first], y[first]
            if not len(x):
                continue
            nodes, at = np.unique(np.r_[a[x], b[y]], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tile], pa.int64()), pa.array([nodes.tolist()], pa.list_(pa.int64()))]
                + [pa.array([at.astype(np.uint32).tobytes()], pa.binary())],
                ["tile", "nodes", "pairs"],
            )

    return meet


def _parts(values: np.ndarray, most: int = 1 << 16) -> list[np.ndarray]:
    return [values[k : k + most] for k in range(0, len(values), most)]


def _check_tiles(threshold: float):
    """Links of each tile that join what no earlier link of the tile has joined."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _runs(batches):
            # The row of the pairs comes first, then the texts by node.
            x, y = np.frombuffer(table.column("pairs")[0].as_py(), np.uint32).astype(np.int64).reshape(2, -1)
            texts = table.slice(1).combine_chunks()
            found = texts.column("node").to_numpy()
            nodes, of = np.unique(found, return_inverse=True)
            links = tile_links(texts.column("text").combine_chunks(), of, len(nodes), x, y, threshold)
            if links:
                one, two = (nodes[list(k)] for k in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["node", "leader"])

    return check


def tile_links(texts: pa.Array, of: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs among (x, y) of similarity ``threshold`` or more, without those that earlier ones connect.

    ``of`` is the node of each text; a node can have several, any of which may be alike.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    data, offsets = text_buffers(texts)
    parts = []
    for begin, end in slices(offsets):
        part = offsets[begin : end + 1] - offsets[begin]
        doc, shingle, weight = shingle_weights(data[offsets[begin] : offsets[end]], part)
        parts.append((doc + begin, shingle, weight))
    doc, shingle, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(doc, kind="stable")
    doc, shingle, weight = doc[order], shingle[order], weight[order]
    names, place = np.unique(shingle, return_inverse=True)
    ends = np.searchsorted(doc, np.arange(len(of) + 1))
    total = np.bincount(doc, weight, minlength=len(of))
    own, group, links = np.zeros(len(names)), np.arange(n), []
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    starts = np.searchsorted(x, np.arange(n + 1))
    for t, node in enumerate(of.tolist()):
        wanted = np.zeros(n, bool)
        wanted[y[starts[node] : starts[node + 1]]] = True
        wanted &= group != group[node]
        others = np.flatnonzero(wanted[of])
        if not len(others):
            continue
        mine = slice(ends[t], ends[t + 1])
        own[place[mine]] = weight[mine]
        for k in others.tolist():
            if group[of[k]] == group[node]:
                continue
            its = slice(ends[k], ends[k + 1])
            common = np.minimum(own[place[its]], weight[its]).sum()
            if common >= threshold * (total[t] + total[k] - common) and common > 0:
                links.append((node, int(of[k])))
                group[group == group[of[k]]] = group[node]
        own[place[mine]] = 0
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, least node of its connected component) for every node of ``edges`` (a, b).

    Least labels spread over the edges and then jump to their label's label, so
    the number of rounds follows the logarithm of a component's width.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    label = materialize(label.select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.a).select("node", "label", F.least("label", "near").alias("lower"))
        up = label.select(F.col("node").alias("lower"), F.col("label").alias("above"))
        step = step.join(up, "lower").select("node", F.col("label").alias("was"), "above")
        step = materialize(step, "labels")
        moved = step.where(F.col("above") != F.col("was")).limit(1).count()
        label = step.select("node", F.col("above").alias("label"))
        if not moved:
            return label


def _classes(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")))


def _mixed_links(
    nodes: DataFrame, members: DataFrame, leaders: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float
) -> DataFrame:
    """Links between members of different ``classes`` of a bucket, enough to connect what is linked."""
    parts = nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    named = members.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lead = leaders.join(classes, leaders.lead == classes.node, "left")
    lead = lead.select("key", F.coalesce("label", "lead").alias("lead"))
    named = materialize(named.join(lead, "key").withColumn("near", F.col("label") == F.col("lead")), "named")
    sums = [
        f(F.when(F.col("near") == side, value)).cast("double").alias(name)
        for side, end in ((True, "near"), (False, "far"))
        for f, value, name in ((F.count, F.lit(1), f"n_{end}"), (F.sum, F.col("size"), f"size_{end}"))
    ]
    mixed = named.groupBy("key").agg(*sums).where("n_far > 0")
    near, far = (
        F.greatest(F.ceil(F.col(f"n_{e}") / BLOCK), F.ceil(F.coalesce(f"size_{e}", F.lit(0.0)) / BLOCK_BYTES)).cast("int")
        for e in ("near", "far")
    )
    small = (F.col("n_near") + F.col("n_far") <= BLOCK) & (F.col("size_near") + F.col("size_far") <= BLOCK_BYTES)
    mixed = mixed.select(
        "key", F.when(small, 0).otherwise(near).alias("p"), F.when(small, 1).otherwise(F.greatest(far, F.lit(1))).alias("q")
    )
    # Blocks under p are of the leader's class, the q others of the rest.
    salt = F.xxhash64("node", F.lit(5))
    block = F.when((F.col("p") > 0) & F.col("near"), F.pmod(salt, F.greatest("p", F.lit(1))))
    block = block.otherwise(F.col("p") + F.pmod(salt, F.col("q"))).cast("int")
    dealt = named.join(mixed, "key").select("key", "band", "node", "label", "p", "q", block.alias("block"))
    dealt = dealt.join(nodes.select("node", "darts", "keys"), "node")
    row = F.struct("node", "label", "darts", "keys")
    blocks = dealt.groupBy("key", "band", "p", "q", "block").agg(F.collect_list(row).alias("rows"))
    low = F.when(F.col("block") < F.col("p"), F.col("p")).otherwise(F.lit(0))
    blocks = blocks.withColumn("other", F.explode(F.sequence(low, F.col("p") + F.col("q") - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    blocks = blocks.select(tile.alias("tile"), "band", "rows")
    tiles = blocks.repartition(int(parts), "tile").sortWithinPartitions("tile")
    tiles = tiles.mapInArrow(_meet(AGREE), "tile bigint, nodes array<bigint>, pairs binary")
    tiles = materialize(tiles, "tiles")
    needed = tiles.select("tile", F.explode("nodes").alias("node")).join(texts, "node")
    needed = needed.select("tile", "node", "text", F.lit(None).cast("binary").alias("pairs"))
    heads = tiles.select("tile", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("string").alias("text"), "pairs")
    rows = heads.union(needed).repartition(int(parts), "tile").sortWithinPartitions("tile", F.col("node").asc_nulls_first())
    return materialize(rows.mapInArrow(_check_tiles(threshold), "node bigint, leader bigint"), "links")


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the column ``node``, another for each text: the least id that has it.

    Where several texts have the same least id, one of them gets it and the
    others numbers above all ids; their common id joins them later on.
    """
    plain = nodes.withColumn("node", F.col("least"))
    again = nodes.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again, "again")
    if not again.limit(1).count():
        return plain
    several = nodes.select("digest", "least").join(again, "least")
    firsts = several.groupBy("least").agg(F.min("digest").alias("first"))
    above = nodes.agg(F.max("least").alias("n")).first()["n"] + 1
    others = several.join(firsts, "least").where(F.col("digest") != F.col("first"))
    others = materialize(others.select("digest", (F.monotonically_increasing_id() + above).alias("other")), "others")
    numbered = nodes.join(others, "digest", "left").withColumn("node", F.coalesce("other", "least"))
    return materialize(numbered.drop("other"), "numbered")


def _labelled(docs: DataFrame, threshold: float, bands: int, band_rows: int) -> DataFrame:
    """(id, digest, own, label) of every text with words, ``docs`` being (id, text).

    ``own`` is the least node among texts that links join, ``label`` among those
    that links or a common id join, which is the least id there.
    """
    texts = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    signed = texts.select("id", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(
        _sign(bands, band_rows), "id bigint, digest binary, keys array<bigint>, darts binary, size bigint"
    )
    signed = materialize(signed, "signatures")
    # One node for each distinct text, whatever the number of its copies.
    first = [F.any_value(c).alias(c) for c in ("keys", "darts", "size")]
    nodes = _numbered(materialize(signed.groupBy("digest").agg(F.min("id").alias("least"), *first), "nodes"))
    rows = nodes.select("node", "size", F.posexplode("keys").alias("band", "raw"))
    rows = rows.select("node", "size", "band", F.xxhash64("band", "raw").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(rows.join(shared, "key"), "members")
    width = members.groupBy("node").agg(F.sum("n").alias("width"))
    needed = width.select("node").join(nodes.select("node", "least", "digest"), "node")
    texts = docs.where(F.col("text").isNotNull()).withColumn("_digest", F.unhex(F.md5("text")))
    held = texts.join(needed, (F.col("id") == F.col("least")) & (F.col("_digest") == F.col("digest")))
    held = materialize(held.select("node", "text").dropDuplicates(["node"]), "texts")
    order = F.struct("width", -F.col("node"))
    leaders = members.join(width, "node").groupBy("key").agg(F.max_by("node", order).alias("lead"))
    leaders = materialize(leaders, "leaders")
    pairs = members.join(leaders, "key").where("node != lead")
    # Similarity is symmetric: each unordered pair is checked once.
    pairs = pairs.select(F.least("node", "lead").alias("node"), F.greatest("node", "lead").alias("leader")).distinct()
    sign = nodes.select("node", "darts")
    fresh = pairs.join(sign, "node").join(sign.select(F.col("node").alias("leader"), F.col("darts").alias("other")), "leader")
    fresh = fresh.select("node", "leader", "darts", "other").mapInArrow(_alike(AGREE), "node bigint, leader bigint")
    one, two = held, held.select(F.col("node").alias("leader"), F.col("text").alias("other"))
    checked = fresh.join(one, "node").join(two, "leader").select("node", "leader", "text", "other")
    checked = checked.mapInArrow(_check(threshold), "node bigint, leader bigint, linked boolean")
    links = materialize(checked.where("linked").select("node", "leader").distinct(), "links")
    def by_links(links: DataFrame) -> DataFrame:
        classes = _classes(links)
        met = _mixed_links(nodes, members, leaders, classes, one, threshold)
        # Every pair of unlike classes in a mixed bucket has been looked at, so no bucket is left.
        return links.union(met) if met.limit(1).count() else links

    links = by_links(links)
    # Nothing but the write follows the join, so that a hot text's copies can be split over tasks.
    copies = materialize(signed.select("id", "digest").join(nodes.select("digest", "node"), "digest"), "copies")
    # Rows with the same id are one document, whatever their texts.
    bounds = copies.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    same = materialize(copies.join(bounds, "id").where("node != low").select("node", F.col("low").alias("leader")).distinct(), "same")
    own = _classes(links).withColumnRenamed("label", "own")
    label = _classes(links.union(same)) if same.limit(1).count() else own.withColumnRenamed("own", "label")
    out = copies.join(own, "node", "left").join(label, "node", "left")
    return out.select("id", "digest", F.coalesce("own", "node").alias("own"), F.coalesce("label", "node").alias("label"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(id, class_id) for every row: class_id is the least id among the near copies.

    Documents are near copies when a chain of links joins them; a link is a
    weighted Jaccard similarity of ``threshold`` or more, or an equal text.
    A text without words (null, empty, blank) and a row without an id are alone
    (class_id is the row's own id); rows with the same id are one document;
    an empty table gives an empty one; other columns are not looked at.
    """
    docs = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    labelled = _labelled(docs, threshold, bands, band_rows)
    copies = labelled.groupBy("id").agg(F.min("label").alias("class_id"))
    out = docs.select("id").join(copies, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """The document with the least id of each class of :func:`near_duplicates`, with all its columns.

    Where rows with that id have texts that no chain of links joins, one row of
    each such text stays (of texts that one does join, that with the least md5;
    of equal texts any row), so that no text is lost. An id without any word
    keeps one of its rows. Rows without an id all stay.
    """
    slim = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    labelled = materialize(_labelled(slim, threshold, bands, band_rows), "labelled")
    kept = labelled.where("id = label").groupBy("id", "own").agg(F.min("digest").alias("_digest"))
    wordless = slim.select("id").where("id IS NOT NULL").distinct().join(labelled, "id", "left_anti")
    wordless = wordless.withColumn("_digest", F.lit(None).cast("binary"))
    kept = kept.select("id", "_digest").unionByName(wordless).withColumnRenamed("id", "_id")
    # Texts move once; which rows stay is known by then.
    same = F.col("_digest").isNull() | (F.unhex(F.md5(col(text_col))) == F.col("_digest"))
    stay = docs.join(kept, col(id_col).cast("bigint") == F.col("_id")).where(same).dropDuplicates(["_id", "_digest"])
    return stay.drop("_id", "_digest").unionByName(docs.where(col(id_col).isNull()))
