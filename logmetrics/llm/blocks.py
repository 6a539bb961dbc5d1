"""Blocks of rows that travel as one compressed record, and packed number lists.

A block is up to ``rows`` consecutive rows of one input split. Operators that
need two rounds over the texts (ask a distributed index about the block's
phrases, then use the answers) let only packed phrases travel in the first
round and give every block its answers in the second. A phrase of a block is
sent once however often the block holds it, so a phrase that a third of all
documents share costs one entry a block.

Block numbers come from row positions, so ``docs`` must read a stored table;
the same splits then give the same blocks in either round and in repeated tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
BLOCK_ROWS = 1024


def with_block(docs: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with the block number in front, as column ``block``."""
    if rows & (rows - 1):
        raise ValueError("rows of a block must be a power of two")
    number = F.shiftright(F.monotonically_increasing_id(), rows.bit_length() - 1)
    return docs.select(number.alias("block"), *[F.col(f"`{c}`") for c in docs.columns if c != "block"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, its rows without the block column), for each stretch of rows of one block."""
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        rest = pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:]))
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > begin:
                yield int(block[begin]), rest.slice(begin, end - begin)


def packed(docs: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (block, payload) for each stretch of rows: all columns, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in runs(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "payload"],
            )

    return with_block(docs, rows).mapInArrow(pack, "block bigint, payload binary")


def unpacked(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as source:
        return source.read_next_batch()


def dealt(entries: DataFrame, buckets: int, answer: Callable) -> DataFrame:
    """Bring the rows of each bucket together and let ``answer`` work on a partition's batches."""
    return entries.repartition(buckets, "bucket").mapInArrow(answer, "block bigint, part binary")


def answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Every block with the list of its answers (null when there are none)."""
    lists = answers.groupBy("block").agg(F.collect_list("part").alias("parts"))
    return blocks.join(lists, "block", "left")


def bucket_count(docs: DataFrame) -> int:
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def bounds(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted ``bits``-bit values begins (buckets + 1 entries)."""
    cuts = [-(-(k << bits) // buckets) for k in range(buckets)]
    return np.concatenate([np.searchsorted(values, np.array(cuts, U)), [len(values)]])


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences of as few bytes as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=U(0)).astype(U)
    first, steps = int(values[0]), steps[1:]
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return first.to_bytes(8, "little") + bytes([width]) + body.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    width = data[8]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    steps = steps.reshape(-1).view("<u8").astype(U)
    steps[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(steps, dtype=U)


def pack_ints(values: np.ndarray) -> bytes:
    """64-bit integers in any order, as distances from the least."""
    if not len(values):
        return b""
    base = int(values.min())
    steps = (values - base).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    body = steps.view(np.uint8).reshape(-1, 8)[:, :width]
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + body.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    width = data[8]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return steps.reshape(-1).view("<i8") + int.from_bytes(data[:8], "little", signed=True)


def joined(parts: list[np.ndarray], dtype=U) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class Lookup:
    """Membership of many hashes in one sorted list: a bit map first, then a search."""

    def __init__(self, keys: np.ndarray, bits: int = 64) -> None:
        self.keys, self.shift = keys, U(bits - 20)
        self.map = np.zeros(1 << 20, bool)
        self.map[(keys >> self.shift).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``values`` that are keys, the key's index for each)."""
        if not len(self.keys):
            none = np.zeros(0, np.int64)
            return none, none
        at = np.flatnonzero(self.map[(values >> self.shift).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        hit = self.keys[index] == values[at]
        return at[hit], index[hit]
