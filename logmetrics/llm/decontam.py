"""Benchmark decontamination with a broadcast set of hashed test n-grams.

A-Z are lowered and words are runs of ASCII digits and letters and of any
non-ASCII characters. A window is 13 consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. Each worker slides over the
hashed words of whole texts, looks every window up in the set, compares the
words of each hit with the item's, and marks the words inside.

The set is broadcast only up to ``limit`` bytes of benchmark text, measured
first, repeats once. Of a larger benchmark long items are cut into runs that
overlap by a window, runs are dealt into parts that each measure below the
limit, and the parts scan the documents one after the other, each adding its
hits; documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.blocks import Lookup
from logmetrics.llm.frames import col, without
from logmetrics.llm.words import ALNUM_WORDS, covered, cut, grams, slices, text_buffers
from logmetrics.session import materialize

ADDED = ("n_words", "hit_spans", "hit_items")
#: New windows in a run of a long item.
RUN = 4096
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Index:
    """The windows of some items, by length: hash -> words -> item ids."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.items: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        self.lookups: dict[int, Lookup] = {}
        for item, text in items:
            words = normal_words(text.encode())
            size = min(window, len(words))
            if not size:
                continue
            joined = pa.array([b" ".join(words).decode()])
            data, offsets = text_buffers(joined)
            table = self.items.setdefault(size, {})
            for at, key in enumerate(grams(cut(data, offsets, ALNUM_WORDS).hash, size).tolist()):
                table.setdefault(key, {}).setdefault(b" ".join(words[at : at + size]), set()).add(item)
        for size, table in self.items.items():
            self.lookups[size] = Lookup(np.array(sorted(table), np.uint64))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Words of each text, which of all words are hit, and the items found in each text."""
        words = cut(data, offsets, ALNUM_WORDS)
        hit, left, doc = np.zeros(len(words.hash), bool), words.left(), words.doc()
        found: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        for size, lookup in self.lookups.items():
            at, key = lookup.find(grams(words.hash, size))
            inside = left[at] >= size
            at, key = at[inside], key[inside]
            real = np.zeros(len(at), bool)
            for k, (w, entry) in enumerate(zip(at.tolist(), lookup.keys[key].tolist(), strict=True)):
                text = data[words.start[w] : words.end[w + size - 1]].tobytes()
                owners = self.items[size][entry].get(b" ".join(normal_words(text)))
                if owners:
                    real[k] = True
                    found[doc[w]] |= owners
            hit |= covered(at[real], size, len(hit))
        return words.counts, hit, found


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [{"begin": b, "end": e} for b, e in edge.reshape(-1, 2).tolist()]


def _scan(items, window: int, text_at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items.value, window)
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            counts, spans, names = [], [], []
            before = [batch.column(n).to_pylist() for n in ADDED[1:]] if ADDED[1] in batch.schema.names else None
            for begin, end in slices(offsets):
                n, hit, found = index.scan(
                    data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
                )
                stop = np.cumsum(n)
                any_hit = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit, out=any_hit[1:])
                some = any_hit[stop] > any_hit[stop - n]
                for k in range(end - begin):
                    own, items_found = hit[stop[k] - n[k] : stop[k]] if some[k] else None, found[k]
                    if before is not None:
                        own = np.zeros(n[k], bool) if own is None else own.copy()
                        for s in before[0][begin + k]:
                            own[s["begin"] : s["end"]] = True
                        items_found |= set(before[1][begin + k])
                    spans.append([] if own is None else _spans(own))
                    names.append(sorted(items_found))
                counts.append(n)
            keep = [k for k, name in enumerate(batch.schema.names) if name not in ADDED]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep]
                + [
                    pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)),
                    pa.array(spans, pa.list_(_SPAN)),
                    pa.array(names, pa.list_(pa.string())),
                ],
                [batch.schema.names[k] for k in keep] + list(ADDED),
            )

    return scan


def item_runs(items: DataFrame, window: int, run: int) -> DataFrame:
    """(item, text) rows with the same windows, none of much more than ``run`` words."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    n = F.size("words")
    cuts = F.transform(
        F.sequence(F.lit(0), F.expr(f"(size(words) - {window}) div {run}")),
        lambda k: F.array_join(F.slice("words", (k * run + 1).cast("int"), run + window - 1), " "),
    )
    runs = F.when(n < run + window, F.array("text")).otherwise(cuts)
    return items.withColumn("words", words).select("item", F.explode(runs).alias("text")).distinct()


def _dealt(items: DataFrame, window: int, limit: int) -> list[DataFrame]:
    """Items in parts that each measure at most ``limit`` bytes, but for single runs of longer words."""
    bytes_ = F.sum(F.octet_length("text") + F.octet_length("item") + 64).alias("bytes")
    items = materialize(items.distinct(), "items")
    size = items.agg(bytes_).first()["bytes"] or 0
    if size <= limit:
        return [items]
    items = materialize(item_runs(items, window, RUN), "runs")
    rows, parts = items.count(), -(-size // limit)
    while True:
        parts *= 2
        part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        most = items.groupBy(part.alias("part")).agg(bytes_, F.count(F.lit(1)).alias("n"))
        if most.where((F.col("bytes") > limit) & (F.col("n") > 1)).isEmpty() or parts > 64 * rows:
            return [items.where(part == k) for k in range(parts)]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    limit: int = 32 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges inside any window) and ``hit_items``.

    ``hit_items`` are the ids, as sorted strings, of items with an occurring
    window. A null or empty text has no words and no hits; items without an id
    or without words are passed over, repeated items count once; an empty table
    on either side gives no hits; columns named like the added ones are replaced.
    """
    items = items.select(col(item_id).cast("string").alias("item"), F.coalesce(col(item_text), F.lit("")).alias("text"))
    items = items.where(F.col("item").isNotNull())
    parts = _dealt(items, window, limit)
    docs = without(docs, *ADDED)
    schema = T.StructType(
        [*docs.schema.fields]
        + [T.StructField("n_words", T.LongType())]
        + [T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("begin", "end")])))]
        + [T.StructField("hit_items", T.ArrayType(T.StringType()))]
    )
    text_at = docs.columns.index(text_col)
    for own in parts:
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])
        docs = docs.mapInArrow(_scan(held, window, text_at), schema)
        if len(parts) > 1:
            docs = materialize(docs, "decontamination")
    return docs


def contamination(found: DataFrame) -> DataFrame:
    """The counts of :func:`find_contamination`: n_hit, n_items, contaminated (a 20th of the words at least)."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["begin"]))
    found = without(found, "n_hit", "n_items", "contaminated").withColumn("n_hit", hit)
    return found.withColumns(
        {
            "n_items": F.size("hit_items").cast("bigint"),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents; all others unchanged."""
    return contamination(find_contamination(docs, items, **options)).where(~F.col("contaminated")).select(*map(col, docs.columns))


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Result of :func:`find_contamination` with the hit words cut out of the text.

    Everything from a span's first to its last word goes, what stands around it
    stays as it is; a text without hits is unchanged.
    """
    text_at, spans_at = found.columns.index(text_col), found.columns.index("hit_spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for k, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans:
                    data = texts[k].encode()
                    words = cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM_WORDS)
                    kept, at = [], 0
                    for s in spans:
                        kept.append(data[at : words.start[s["begin"]]])
                        at = words.end[s["end"] - 1]
                    texts[k] = b"".join([*kept, data[at:]]).decode()
            yield batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, pa.string()))

    return found.mapInArrow(strip, found.schema)
