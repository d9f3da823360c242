"""Bitmap sketches that tasks build in parts, Spark merges and every task may read.

A sketch is ``depth`` rows of ``2**log_cells`` cells. A cell counts the keys that fall into it, cut at two:
the count-min count as far as it matters for "seen" and "seen again". Tasks send sorted cells in parts of
bounded size, blocks of cells are merged by key, and the merged bitmap has a size fixed by the arguments.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of one block; blocks are merged apart from each other.
LOG_BLOCK = 21
#: Keys a task holds before it sends a part.
HELD = 1 << 21
#: Parts of one block merged at a time: many tasks are merged in two levels, so no group grows with the tasks.
FAN = 64

PART = "block long, seen binary, again binary"


def cells(keys: np.ndarray, other: np.ndarray, row: int, log_cells: int) -> np.ndarray:
    """Cell of each key in one row: two 64-bit hashes give as many rows as wanted."""
    mixed = (keys + np.uint64(row) * (other | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - log_cells)).astype(np.int64)


class Parts:
    """Collects cells of a task's keys and gives Arrow batches of PART."""

    def __init__(self, depth: int, log_cells: int):
        self.depth, self.log_cells, self.held, self.n = depth, log_cells, [[] for _ in range(depth)], 0

    def add(self, keys: np.ndarray, other: np.ndarray):
        kind = np.uint32 if self.log_cells <= 32 else np.int64
        for row, held in enumerate(self.held):
            held.append(cells(keys, other, row, self.log_cells).astype(kind))
        self.n += len(keys)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        self.n = 0
        log_block = min(LOG_BLOCK, self.log_cells)
        per_row = 1 << (self.log_cells - log_block)
        starts = np.arange(per_row) << log_block
        for row in range(self.depth):
            cell, self.held[row] = np.concatenate(self.held[row]), []
            cell.sort()
            again = np.zeros(len(cell), bool)
            again[1:] = cell[1:] == cell[:-1]
            more = np.unique(cell[again])
            cell = cell[~again]
            a, b = (np.append(np.searchsorted(x, starts.astype(x.dtype)), len(x)) for x in (cell, more))
            kept = [k for k in range(per_row) if a[k + 1] > a[k]]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([row * per_row + k for k in kept], pa.int64()),
                "seen": pa.array([_pack(cell[a[k] : a[k + 1]].astype(np.int64) - starts[k]) for k in kept], pa.binary()),
                "again": pa.array([_pack(more[b[k] : b[k + 1]].astype(np.int64) - starts[k]) for k in kept], pa.binary()),
            })


def _pack(at: np.ndarray) -> bytes:
    """Sorted positions as deflated gaps; a gap over 254 is a byte 255 and a number at the end."""
    gaps = np.diff(at, prepend=-1)
    small = np.minimum(gaps, 255).astype(np.uint8).tobytes()
    return zlib.compress(np.array([len(at)], np.uint32).tobytes() + small + gaps[gaps >= 255].astype(np.uint32).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    body = zlib.decompress(packed)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    gaps = np.frombuffer(body, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(body, np.uint32, offset=4 + n)
    return np.cumsum(gaps) - 1


def _merge(group: pa.Table) -> pa.Table:
    hits = [_unpack(packed) for column in ("seen", "again") for packed in group[column].to_pylist()]
    cell, count = np.unique(np.concatenate(hits), return_counts=True)
    return pa.table({
        "block": pa.array([group["block"][0].as_py()], pa.int64()),
        "seen": pa.array([_pack(cell)], pa.binary()), "again": pa.array([_pack(cell[count > 1])], pa.binary()),
    })


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row of PART for each block. With more than FAN input partitions, in two levels."""
    fans = -(-parts.rdd.getNumPartitions() // FAN)
    if fans > 1:
        salted = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(fans)).alias("fan"))
        parts = salted.applyInArrow(_merge, PART)
    return parts.groupBy("block").applyInArrow(_merge, PART)


class Bits:
    """A merged bitmap that tells whether keys may be in it; it never denies one that is. It travels deflated."""

    def __init__(self, rows: list[np.ndarray], log_cells: int):
        self.rows, self.log_cells = rows, log_cells

    def __getstate__(self):
        return [zlib.compress(row, 1) for row in self.rows], self.log_cells

    def __setstate__(self, state):
        packed, self.log_cells = state
        self.rows, size = [], 1 << max(0, self.log_cells - 3)  # told the size, zlib doesn't hold a row twice
        while packed:
            self.rows.append(np.frombuffer(zlib.decompress(packed.pop(0), bufsize=size), np.uint8))

    def may_hold(self, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        held = np.arange(len(keys))
        for row, bits in enumerate(self.rows):
            cell = cells(keys[held], other[held], row, self.log_cells)
            held = held[(bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[held] = True
        return out


def share(parts: DataFrame, depth: int, log_cells: int, which: str) -> Broadcast:
    """Merge parts and send the bitmap of cells ``seen`` or seen ``again``, depth * 2**log_cells bits, to all executors."""
    log_block = min(LOG_BLOCK, log_cells)
    bits = np.zeros((depth << log_cells) // 8, np.uint8)
    for block, packed in merge_parts(parts).select("block", which).collect():
        at = _unpack(bytes(packed))
        np.bitwise_or.at(bits, ((block << log_block) + at) >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return parts.sparkSession.sparkContext.broadcast(Bits(list(bits.reshape(depth, -1)), log_cells))
