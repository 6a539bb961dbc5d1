"""Text features in long form: (doc, term, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.functions.messages import Tokenizer, ngrams, tokenize_default
from logmetrics.operators.positions import row_index
from logmetrics.session import materialize, sized_broadcast

# Fixed value: negative BM25 idf becomes this share of the average idf.
BM25_FLOOR_SHARE = 0.25
#: Bytes of text that one task cuts into terms, which are several times the text.
TEXT_BYTES = 8 * 1024 * 1024
#: Counts of (doc, term) that stand in one chunk, where no text is at hand to measure.
CHUNK_ROWS = 2_000_000
#: Types of chunk, bucket and packed terms or frequencies.
SENT = (pa.int32(), pa.int32(), pa.binary())


def term_counts(
    df: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    tokens: Tokenizer = tokenize_default,
    pairs: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """(doc, term, tf) over words and, with ``pairs``, adjacent pairs.

    Tokens are a column of their own so that each text is split once. The texts
    are hashed by document before they are split: counting by (doc, term) then
    needs no shuffle of the terms, which are several times the text. The texts
    are measured first and dealt out so that a task's terms do not grow with them.

    With ``chunks`` (see :func:`text_chunks`) rows also have a ``_chunk``, which
    holds whole documents and is one task; :func:`tfidf` takes such counts.
    """
    if chunks is None:
        keys, placed = [doc], df.select(doc, text).repartition(text_chunks(df, text), doc)
    else:
        keys, placed = ["_chunk", doc], _in_chunks(df.select(doc, text), chunks, doc)
    split = placed.select(*keys, tokens(F.col(text)).alias("_tokens"))
    terms = ngrams(F.col("_tokens")) if pairs else F.col("_tokens")
    exploded = split.select(*keys, F.explode(terms).alias("term")).filter(F.col("term").isNotNull())
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def text_chunks(df: DataFrame, text: str = "text") -> int:
    """Pieces of about ``TEXT_BYTES`` of text, and one a core at least."""
    measured = df.agg(F.sum(F.octet_length(F.col(text))).alias("bytes")).first()["bytes"] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-measured // TEXT_BYTES))


def _in_chunks(rows: DataFrame, chunks: int, doc: str) -> DataFrame:
    chunk = F.pmod(F.xxhash64(doc), F.lit(chunks)).cast("int").alias("_chunk")
    return rows.select(chunk, *rows.columns).repartitionById(chunks, "_chunk")


def document_frequency(counts: DataFrame, chunks: int | None = None) -> DataFrame:
    """Documents per term, from distinct (doc, term) rows; combines before the shuffle.

    Counts of :func:`term_counts` with the same ``chunks`` send their terms packed.
    """
    if chunks is not None:
        schema = T.StructType([counts.schema["term"], T.StructField("df", T.LongType())])
        return _sent(counts, chunks).groupBy("_bucket").applyInArrow(_sum_documents, schema)
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(df: DataFrame) -> DataFrame:
    """Number of documents, one per row."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def document_length(
    df: DataFrame, *, doc: str = "doc_id", text: str = "text", tokens: Tokenizer = tokenize_default
) -> DataFrame:
    return df.select(F.col(doc), F.size(tokens(F.col(text))).cast("long").alias("doc_len"))


def vocabulary(counts: DataFrame, chunks: int | None = None) -> DataFrame:
    """(term, df, term_id): distinct terms with their place in code-point order."""
    return row_index(document_frequency(counts, chunks), "term", name="term_id")


def tfidf(
    counts: DataFrame,
    n_docs: Column,
    terms: DataFrame | None = None,
    doc: str = "doc_id",
    chunks: int | None = None,
) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to length one.

    ``n_docs`` is a literal or a scalar subquery. With a stored (term, df) table
    ``terms`` beside stored ``counts`` the two are joined. Further columns of
    ``terms``, such as ``term_id``, stay on the result. A table that measures
    small is broadcast; counts then stay where they are, document by document. A
    large one joins by shuffle, where adaptive execution splits hot terms.

    Without ``terms`` counts stay in chunks of whole documents. Each chunk sends
    its distinct terms, packed and sorted, to their hash buckets once, and gets
    back only their document frequencies in the same order. Counts of
    :func:`term_counts` with the same ``chunks`` are not moved or written (both
    ends cut the texts into terms); others are written, and dealt out here. With
    ``terms`` and ``chunks`` the buckets look the terms up there, and rows of a
    document stand together.
    """
    if terms is None or chunks is not None:
        return _tfidf_in_chunks(counts, n_docs, doc, chunks, terms)
    table = _terms(counts, terms)
    idf = (F.ln((n_docs + 1) / (F.col("df") + F.lit(1.0))) + 1).alias("_idf")
    extra = [c for c in table.columns if c not in ("term", "df")]
    raw = counts.join(table.select("term", idf, *extra), "term").withColumn(
        "_w", F.col("tf") * F.col("_idf")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", "tf", *extra, (F.col("_w") / length).alias("weight"))


def _bucket(chunks: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("_bucket")


def _sent(counts: DataFrame, chunks: int) -> DataFrame:
    """(_chunk, _bucket, _packed): the distinct terms of each chunk, by hash bucket."""
    rows = counts.select("_chunk", _bucket(chunks), "term")
    return rows.mapInArrow(_send_terms, "_chunk int, _bucket int, _packed binary")


def _tfidf_in_chunks(
    counts: DataFrame, n_docs: Column, doc: str, chunks: int | None, terms: DataFrame | None = None
) -> DataFrame:
    if chunks is None:
        counts = materialize(counts.select(doc, "term", "tf").filter(F.col("term").isNotNull()), "counts")
        parallel = counts.sparkSession.sparkContext.defaultParallelism
        chunks = max(parallel, -(-counts.count() // CHUNK_ROWS))
        counts = _in_chunks(counts, chunks, doc)
    sent = _sent(counts, chunks).groupBy("_bucket")
    schema = "_chunk int, _bucket int, _packed binary"
    if terms is None:
        extra, back = [], sent.applyInArrow(_count_documents, schema)
    else:
        extra = [c for c in terms.columns if c not in ("term", "df")]
        own = terms.select(_bucket(chunks), "term", "df", *extra)
        back = sent.cogroup(own.groupBy("_bucket")).applyInArrow(_look_up, schema)
    back = back.repartitionById(chunks, "_chunk").withColumn("_docs", n_docs.cast("double"))
    rows = counts.select("_chunk", _bucket(chunks), F.col(doc).alias("_doc"), "term", "tf")
    weight = T.StructField("weight", T.DoubleType())
    fields = [T.StructField("_doc", counts.schema[doc].dataType), counts.schema["term"], counts.schema["tf"]]
    fields += [terms.schema[c] for c in extra]
    pairs = rows.groupBy("_chunk").cogroup(back.groupBy("_chunk"))
    return pairs.applyInArrow(_weigh, T.StructType([*fields, weight])).withColumnRenamed("_doc", doc)


def _pack(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _by_bucket(terms: pa.Array, buckets: np.ndarray) -> np.ndarray:
    """Order of distinct terms by bucket, then code point: the same at both ends of the way."""
    order = pc.sort_indices(terms).to_numpy()
    return order[np.argsort(buckets[order], kind="stable")]


def _send_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each chunk and bucket with their documents in the chunk, one row each."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    for chunk in pc.unique(table["_chunk"]).to_pylist():
        own = table.filter(pc.equal(table["_chunk"], chunk))
        codes, terms = _codes(own["term"])
        buckets = np.empty(len(terms), np.int32)
        buckets[codes] = own["_bucket"].to_numpy()
        order = _by_bucket(terms, buckets)
        terms, n, buckets = terms.take(pa.array(order)), np.bincount(codes)[order], buckets[order]
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(buckets)], strict=True):
            packed = _pack(term=terms[start:end], n=pa.array(n[start:end]))
            row = {"_chunk": [chunk], "_bucket": buckets[start : start + 1], "_packed": [packed]}
            yield pa.RecordBatch.from_pydict(row, pa.schema(dict(zip(row, SENT, strict=True))))


def _documents(sent: pa.Table) -> tuple[list[np.ndarray], pa.Array, np.ndarray]:
    """A bucket's terms: their codes as each chunk sent them, the terms, their document frequencies."""
    parts = [_unpack(x) for x in sent["_packed"]]
    coded = pa.chunked_array([p["term"] for p in parts]).dictionary_encode()
    codes = [c.indices.to_numpy() for c in coded.chunks]
    every, n = np.concatenate(codes), np.concatenate([p["n"].to_numpy() for p in parts])
    df = np.zeros(every.max() + 1, np.int64)
    np.add.at(df, every, n)
    return codes, coded.chunk(0).dictionary, df


def _sum_documents(sent: pa.Table) -> pa.Table:
    _, terms, df = _documents(sent)
    return pa.table([terms, pa.array(df)], ["term", "df"])


def _count_documents(sent: pa.Table) -> pa.Table:
    """Document frequencies of a bucket's terms, back to each chunk in the order it sent them."""
    codes, _, df = _documents(sent)
    packed = pa.array([_pack(df=pa.array(df[c])) for c in codes], pa.binary())
    return pa.table([sent["_chunk"], sent["_bucket"], packed], ["_chunk", "_bucket", "_packed"])


def _look_up(sent: pa.Table, terms: pa.Table) -> pa.Table:
    """The stored columns of a bucket's terms, back to each chunk in the order it sent them."""
    stored, packed = terms.drop(["_bucket", "term"]).combine_chunks(), []
    for part in (_unpack(x) for x in sent["_packed"]):
        own = stored.take(pc.index_in(part["term"], value_set=terms["term"].combine_chunks()))
        packed.append(_pack(**{c: own[c].combine_chunks() for c in own.column_names}))
    return pa.table([sent["_chunk"], sent["_bucket"], pa.array(packed, pa.binary())], ["_chunk", "_bucket", "_packed"])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode(null_encoding="encode")
    return np.concatenate([c.indices.to_numpy() for c in coded.chunks]), coded.chunk(0).dictionary


def _weigh(rows: pa.Table, back: pa.Table) -> pa.Table:
    """The weights of a chunk's documents, from its rows and its terms' document frequencies.

    What came back beside these stays; terms that were not found have no row.
    """
    codes, terms = _codes(rows["term"])
    buckets = np.empty(len(terms), np.int32)
    buckets[codes] = rows["_bucket"].to_numpy()
    parts = [_unpack(back["_packed"][int(k)]) for k in np.argsort(back["_bucket"].to_numpy())]
    found = pa.Table.from_batches(parts)
    place = np.empty(len(terms), np.int64)
    place[_by_bucket(terms, buckets)] = np.arange(len(terms))
    extra = [c for c in found.column_names if c != "df"]
    if extra:
        known = found["df"].is_valid().to_numpy()[place[codes]]
        docs, _ = _codes(rows["_doc"])
        order = np.argsort(docs, kind="stable")
        order = order[known[order]]
        rows, codes = rows.take(pa.array(order)), codes[order]
    df = found["df"].to_numpy().astype(np.float64)[place]
    idf = np.log((back["_docs"][0].as_py() + 1) / (df + 1.0)) + 1
    weight = rows["tf"].to_numpy() * idf[codes]
    docs = _codes(rows["_doc"])[0] if len(rows) else codes
    length = np.sqrt(np.bincount(docs, weight * weight))
    columns = [rows["_doc"], rows["term"], rows["tf"], *(found[c].take(pa.array(place[codes])) for c in extra)]
    return pa.table([*columns, pa.array(weight / length[docs])], ["_doc", "term", "tf", *extra, "weight"])


def bm25_idf(counts: DataFrame, n_docs: Column, terms: DataFrame | None = None) -> DataFrame:
    """ln(n - df + 0.5) - ln(df + 0.5); negative values become a share of the average."""
    table = _terms(counts, terms)
    raw = table.withColumn(
        "_raw",
        F.ln(n_docs.cast("double") - F.col("df") + F.lit(0.5)) - F.ln(F.col("df") + F.lit(0.5)),
    )
    average = raw.agg(F.avg("_raw").alias("a")).scalar()
    floor = F.lit(BM25_FLOOR_SHARE) * average
    return raw.select(
        *table.columns, F.when(F.col("_raw") < 0, floor).otherwise(F.col("_raw")).alias("idf")
    )


def bm25_presence(counts: DataFrame, idf: DataFrame, doc: str = "doc_id") -> DataFrame:
    """idf of each term a document holds; terms it does not hold have no row."""
    kept = idf.drop("df").withColumnRenamed("idf", "weight")
    return counts.select(doc, "term").join(kept, "term")


def _terms(counts: DataFrame, terms: DataFrame | None) -> DataFrame:
    stored = materialize(document_frequency(counts), "terms") if terms is None else terms
    return sized_broadcast(stored)


def to_feature_vector(
    weights: DataFrame,
    width: Column,
    doc: str = "doc_id",
    weight: str = "weight",
    docs: DataFrame | None = None,
    together: bool = False,
) -> DataFrame:
    """Long weights with ``term_id`` to one sparse vector per document.

    One document's terms come together, which its own text bounds; the
    vocabulary never leaves the cluster, only its size ``width`` is a scalar.
    With ``docs`` every one of them has a vector, those without a term a zero one.
    Rows of a document that stand ``together``, as :func:`tfidf` in chunks gives
    them, are not moved.
    """
    if together and docs is None:
        rows = weights.select(doc, width.cast("int").alias("_w"), F.col("term_id").cast("int"), F.col(weight).cast("double"))
        schema = T.StructType([weights.schema[doc], T.StructField("features", VectorUDT())])
        return rows.mapInArrow(_gathered, schema)
    entries = weights.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct("term_id", weight))).alias("_entries")
    )
    if docs is not None:
        entries = docs.select(doc).join(entries, doc, "left")
    rows = entries.select(
        doc, width.cast("int").alias("_w"), F.col("_entries.term_id").alias("_p"), F.col(f"_entries.{weight}").alias("_v")
    )
    schema = T.StructType([entries.schema[doc], T.StructField("features", VectorUDT())])
    return rows.mapInArrow(_sparse, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of rows that stand together by document; the last one's wait for more."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        docs, _ = _codes(table.column(0))
        last = len(docs) - int(np.argmax(docs[::-1] != docs[-1])) if (docs != docs[-1]).any() else 0
        if last:
            yield from _grouped(table.slice(0, last), docs[:last])
        held = table.slice(last).combine_chunks().to_batches()[0]
    if held is not None:
        yield from _grouped(pa.Table.from_batches([held]), np.zeros(held.num_rows, np.int32))


def _grouped(table: pa.Table, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(docs)]))
    sorted_rows = table.take(pa.array(np.lexsort((table.column(2).to_numpy(), group)))).combine_chunks()
    offsets = pa.array(np.r_[starts, len(docs)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, sorted_rows.column(c).combine_chunks()) for c in (2, 3)]
    firsts = table.select([0, 1]).take(pa.array(starts)).combine_chunks()
    columns = [*(c.combine_chunks() for c in firsts.columns), *lists]
    yield from _sparse(iter([pa.RecordBatch.from_arrays(columns, [*firsts.column_names, "_p", "_v"])]))


def vector_entries(vectors: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, size, term_id, weight): the stored entries of sparse vectors, one row each."""
    schema = T.StructType(
        [vectors.schema[doc], T.StructField("size", T.LongType())]
        + [T.StructField(n, T.ArrayType(t)) for n, t in (("_p", T.LongType()), ("_v", T.DoubleType()))]
    )
    parts = vectors.select(doc, "features").mapInArrow(_entries, schema)
    pairs = F.arrays_zip(F.col("_p").alias("term_id"), F.col("_v").alias("weight"))
    return parts.select(doc, "size", F.inline(pairs).alias("term_id", "weight"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, size, places, values = batch.column(1).flatten()
        columns = [batch.column(0), size.cast(pa.int64()), places.cast(pa.list_(pa.int64())), values]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "size", "_p", "_v"])


def vocabulary_size(terms: DataFrame) -> Column:
    return terms.agg(F.count(F.lit(1)).cast("int").alias("w")).scalar()


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors as their stored form, from whole columns; a missing list has no entries."""
    for batch in batches:
        doc, width, places, values = batch.columns
        n = len(places)
        counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, column.flatten().cast(kind))
            for column, kind in ((places, pa.int32()), (values, pa.float64()))
        ]
        kind = pa.array(np.zeros(n, np.int8))  # fixed value: sparse
        vectors = pa.StructArray.from_arrays([kind, width, *lists], ["type", "size", "indices", "values"])
        yield pa.RecordBatch.from_arrays([doc, vectors], [batch.schema.names[0], "features"])


def lemma_join(
    tokens: DataFrame, lemmas: DataFrame, *, token: str = "token", lemma: str = "lemma"
) -> DataFrame:
    """Tokens replaced by their lemma, unchanged when unknown.

    ``lemmas`` has one row per token; pass it through ``session.sized_broadcast``
    so that a small table moves no tokens.
    """
    known = lemmas.select(F.col(token).alias("_t"), F.col(lemma).alias("_l"))
    return (
        tokens.join(known, F.col(token) == F.col("_t"), "left")
        .withColumn(token, F.coalesce("_l", token))
        .drop("_t", "_l")
    )


def embed_lookup(
    df: DataFrame,
    vectors: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "message",
    tokens: Tokenizer = tokenize_default,
    combine: str = "sqrtn",
) -> DataFrame:
    """Fixed-length vector per distinct text: sum of known word vectors over
    sqrt(count) (``sqrtn``) or over count (``mean``); unknown words are skipped.

    Each distinct text is embedded once and joined back by its hash, so no text
    is copied per word. De-duplication leaves the rows partitioned by that hash;
    with a broadcast word table (see ``session.sized_broadcast``) counting and
    summing then need no further shuffle. The hash travels as its 32 bytes.
    """
    if combine not in ("sqrtn", "mean"):
        raise ValueError(combine)
    hashed = df.select(key, text, F.unhex(F.sha2(text, 256)).alias("_text"))
    exploded = (
        hashed.select("_text", text)
        .dropDuplicates(["_text"])
        .select("_text", F.explode(tokens(F.col(text))).alias("token"))
    )
    counts = exploded.groupBy("_text", "token").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    known = counts.join(vectors.select("token", "vector"), "token")
    scaled = F.transform("vector", lambda x: x.cast("double") * F.col("_n"))
    sums = known.groupBy("_text").agg(
        Summarizer.sum(array_to_vector(scaled)).alias("_sum"), F.sum("_n").alias("_words")
    )
    by = F.sqrt("_words") if combine == "sqrtn" else F.col("_words")
    embedded = sums.select(
        "_text", F.transform(vector_to_array("_sum"), lambda x: x / by).alias("features")
    )
    return hashed.join(embedded, "_text", "left").select(key, text, "features")
