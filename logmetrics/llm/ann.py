"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length one and rotated by one random orthogonal
matrix; its code is the sign of each coordinate, packed, with one correction
scalar: the inner product of the vector with its code. For a query, rotated the
same way and rounded at random to four bits, the inner product with a code is
four popcounts; divided by the scalar it estimates the cosine without bias, and
the scalar also bounds the error. In a block of vectors, those whose upper bound
is over the fifth largest lower bound are measured exactly on the original
vectors in double precision; nothing else is.

A block of queries meets a block of vectors in one task, each of a bounded
number of rows, whatever values they hold; every meeting keeps its five nearest
for each query, and those are merged. Codes are computed once and stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.frames import col
from logmetrics.session import materialize

#: Widths of the error bounds in standard deviations: of the code, of the query's rounding.
WIDTH = 3.0
QUERY_BITS = 4
QUERY_ROWS, VECTOR_ROWS = 2048, 4096
#: A query's finds are merged in so many parts first.
PARTS = 256


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """n x ceil(dim / 64) words of n x dim booleans."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), bool)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, inner product of each rotated unit vector with its code)."""
    dim = vectors.shape[1]
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / scale
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation(dim)
    return pack_bits(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def estimates(queries: np.ndarray, codes: np.ndarray, scalars: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines, error bounds), queries x codes."""
    scale = np.abs(queries).max(axis=1, keepdims=True)
    unit = queries / scale
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation(dim)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    # Rounding at random leaves no bias; the draws are fixed per coordinate.
    level = np.floor((turned - low) / step + np.random.default_rng(dim).random(dim)).astype(np.int64)
    level = np.clip(level, 0, (1 << QUERY_BITS) - 1)
    dots = np.zeros((len(queries), len(codes)), np.int32)
    for bit in range(QUERY_BITS):
        plane = pack_bits((level >> bit) & 1 == 1)
        for word in range(codes.shape[1]):
            both = np.bitwise_count(plane[:, word, None] & codes[None, :, word])
            dots += both.astype(np.int32) << bit
    ones = sum(np.bitwise_count(codes[:, w]).astype(np.int64) for w in range(codes.shape[1]))
    # sum of sign x value = 2 x (sum where the bit is set) - (sum of all values)
    raised = step * dots + low * ones[None, :]
    signed = (2 * raised - (low * dim + step * level.sum(axis=1, keepdims=True))) / np.sqrt(dim)
    spread = np.sqrt(np.maximum(1 - scalars**2, 0)) / np.sqrt(max(dim - 1, 1))
    rounding = step * 0.5 * np.ones_like(dots)
    return signed / scalars, WIDTH * np.sqrt(spread[None, :] ** 2 + rounding**2) / scalars


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, scaled first so that squares neither overflow nor vanish."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        dims = batch.column("dim").to_numpy()
        codes, scalars = [b""] * batch.num_rows, np.zeros(batch.num_rows)
        vectors = batch.column("vector")
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            code, scalar = encode(flat.reshape(len(at), dim))
            scalars[at] = scalar
            for k, c in zip(at.tolist(), code, strict=True):
                codes[k] = c.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(codes, pa.binary()), pa.array(scalars)], [*batch.schema.names, "code", "scalar"]
        )


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Stored rows (id, vector, dim, code, scalar) of every usable vector.

    Null and zero vectors and vectors with a null or non-finite component take
    no part, nor do rows without an id.
    """
    vector = col(vector_col).cast("array<double>")
    wide = F.lit(float("inf"))
    usable = (
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < wide))
        & F.exists(vector, lambda x: x != 0)
        & col(id_col).isNotNull()
    )
    rows = vectors.where(usable).select(
        col(id_col).cast("bigint").alias("id"), vector.alias("vector"), F.size(vector).alias("dim")
    )
    coded = rows.mapInArrow(_index, "id bigint, vector array<double>, dim int, code binary, scalar double")
    return materialize(coded, "codes")


def nearest_in(queries: tuple, block: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, block row, cosine) of each query's k nearest in a block, itself left out."""
    q_ids, q_vectors = queries
    ids, vectors, codes, scalars = block
    guess, error = estimates(q_vectors, codes, scalars, vectors.shape[1])
    own = q_ids[:, None] == ids[None, :]
    lower = np.where(own, -np.inf, guess - error)
    if lower.shape[1] > k:
        floor = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
        row, at = np.nonzero((guess + error >= floor[:, None]) & ~own)
    else:
        row, at = np.nonzero(~own)
    score = np.zeros(len(row))
    for begin in range(0, len(row), 1 << 17):
        part = slice(begin, begin + (1 << 17))
        score[part] = cosines(q_vectors[row[part]], vectors[at[part]])
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    best = rank < k
    return row[best], at[best], score[best]


def _meet(k: int):
    names = ["query_id", "vec_id", "score", "part"]
    empty = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, names)
        dim = right.column("dim")[0].as_py()
        matrix = lambda c: c.combine_chunks().flatten().to_numpy().reshape(-1, dim)
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(right.num_rows, -1)
        block = (right.column("id").to_numpy(), matrix(right.column("vector")), codes, right.column("scalar").to_numpy())
        q_ids, q_vectors = left.column("q_id").to_numpy(), matrix(left.column("q_vector"))
        found = []
        for begin in range(0, len(q_ids), 64):
            row, at, score = nearest_in((q_ids[begin : begin + 64], q_vectors[begin : begin + 64]), block, k)
            found.append((q_ids[row + begin], block[0][at], score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        part = np.full(len(columns[0]), right.column("block")[0].as_py() % PARTS, np.int32)
        return pa.table([pa.array(c) for c in (*columns, part)], names)

    return meet


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    vector_rows: int = VECTOR_ROWS,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` vectors of largest cosine to each query.

    Queries are the rows where ``is_query`` (of column ``id``) holds; candidates
    are all other rows of the same length. Ties go to the smaller id; fewer
    candidates than ``k`` give fewer rows; a row whose id repeats counts once
    for each distinct vector. See :func:`index` for the vectors that take no part.
    """
    coded = index(vectors, id_col, vector_col)
    asked = coded.where(is_query)
    counts = coded.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked"))
    counts = counts.select(
        "dim",
        F.ceil(F.col("n") / vector_rows).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("asked") / query_rows), F.lit(1)).cast("int").alias("groups"),
    )
    counts = materialize(counts, "blocks")
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.join(F.broadcast(counts), "dim").select(
        F.col("dim").alias("q_dim"),
        spread(F.col("groups"), 1).alias("q_group"),
        every(F.col("blocks")).alias("q_block"),
        F.col("id").alias("q_id"),
        F.col("vector").alias("q_vector"),
    )
    right = coded.join(F.broadcast(counts), "dim").select(
        "dim", every(F.col("groups")).alias("group"), spread(F.col("blocks"), 2).alias("block"), "id", "vector", "code", "scalar"
    )
    found = left.groupBy("q_dim", "q_group", "q_block").cogroup(right.groupBy("dim", "group", "block")).applyInArrow(
        _meet(k), "query_id bigint, vec_id bigint, score double, part int"
    )
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score")))
    best = F.slice(F.array_distinct(best), 1, k)
    parts = found.groupBy("query_id", "part").agg(best.alias("best")).select("query_id", F.inline("best"))
    ranked = parts.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b")["vec_id"].alias("vec_id"), F.col("b")["score"].alias("score")
    )
