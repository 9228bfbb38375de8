"""Count-min sketches that saturate at two, and Bloom filters, as bit planes built in tasks and merged by shuffle.

A sketch has `depth` rows of 2^bits cells; a cell holds 0, 1 or "2 or more" in two bit planes. The estimate of a
key is the least of its cells, and never below its true count. Its size depends on its parameters alone
(depth * 2^bits / 4 bytes), so it may be broadcast however large the corpus is. With more keys than cells it lets
more through that occurs once, but never loses what occurs twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

DEPTH, BITS, BLOCK_BITS = 4, 26, 21
MULTIPLIERS = tuple(K.mix(np.arange(1, 17, dtype=np.uint64)) | K.U64(1))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(keys * MULTIPLIERS[row]) >> K.U64(64 - bits)).astype(np.int64)


def set_bits(plane: np.ndarray, sorted_cells: np.ndarray) -> None:
    if len(sorted_cells):
        byte = sorted_cells >> 3
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        plane[byte[first]] |= np.bitwise_or.reduceat((1 << (sorted_cells & 7)).astype(np.uint8), first)


def get_bits(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (plane[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Sketch:
    """The planes of one task."""

    def __init__(self, depth: int = DEPTH, bits: int = BITS):
        self.depth, self.bits = depth, bits
        self.once = np.zeros((depth, 1 << (bits - 3)), np.uint8)
        self.twice = np.zeros((depth, 1 << (bits - 3)), np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for r in range(self.depth):
            c = np.sort(cells(keys, r, self.bits))
            new = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
            u = c[new]
            set_bits(self.twice[r], c[~new])
            set_bits(self.twice[r], u[get_bits(self.once[r], u)])
            set_bits(self.once[r], u)

    def blocks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        size = 1 << (min(BLOCK_BITS, self.bits) - 3)
        for r in range(self.depth):
            for b in range(self.once.shape[1] // size):
                one, two = (plane[r, b * size : (b + 1) * size] for plane in (self.once, self.twice))
                if one.any():
                    yield r, b, zlib.compress(one, 1), zlib.compress(two, 1)


BLOCK_SCHEMA = "row int, block int, part int, once binary, twice binary"


def block_batches(sketch: Sketch) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for r, b, one, two in sketch.blocks():
        yield pa.RecordBatch.from_pydict(
            {"row": pa.array([r], pa.int32()), "block": pa.array([b], pa.int32()), "part": pa.array([part], pa.int32()), "once": pa.array([one], pa.binary()), "twice": pa.array([two], pa.binary())}
        )


def sketch_tasks(frame: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], depth: int = DEPTH, bits: int = BITS) -> DataFrame:
    """One compressed sketch per task over the keys that keys_of finds in its batches."""

    def run(batches):
        sketch = Sketch(depth, bits)
        for batch in batches:
            for keys in keys_of(batch):
                sketch.add(keys)
        yield from block_batches(sketch)

    return frame.mapInArrow(run, BLOCK_SCHEMA)


def merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, block, part) to one for each, holding one block at a time."""
    have, one, two = None, None, None

    def done():
        row, block, part = have
        return pa.RecordBatch.from_pydict(
            {"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "once": pa.array([zlib.compress(one, 1)], pa.binary()), "twice": pa.array([zlib.compress(two, 1)], pa.binary())}
        )

    for batch in batches:
        for row, block, p, a, b in zip(*(batch.column(i).to_pylist() for i in range(5))):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if (row, block, p) != have:
                if have is not None:
                    yield done()
                have, one, two = (row, block, p), a.copy(), b.copy()
            else:
                two |= b | (one & a)
                one |= a
    if have is not None:
        yield done()


def merged(parts: DataFrame, fan_in: int = 64) -> DataFrame:
    """Merge tasks' sketches in rounds of so many at a time, so that no task reads them all."""
    left = parts.rdd.getNumPartitions()
    while True:
        last = left <= fan_in
        parts = parts.withColumn("part", F.lit(0) if last else F.floor(F.col("part") / fan_in).cast("int"))
        parts = parts.repartition("row", "block", "part").sortWithinPartitions("row", "block", "part").mapInArrow(merge_blocks, BLOCK_SCHEMA)
        if last:
            return parts
        left = -(-left // fan_in)


def collected(parts: DataFrame, plane: str, depth: int = DEPTH, bits: int = BITS) -> np.ndarray:
    """One plane of a merged sketch on the driver: depth * 2^bits / 8 bytes, whatever the corpus."""
    out = np.zeros((depth, 1 << (bits - 3)), np.uint8)
    size = 1 << (min(BLOCK_BITS, bits) - 3)
    for r in parts.select("row", "block", plane).toLocalIterator():
        out[r[0], r[1] * size : (r[1] + 1) * size] = np.frombuffer(zlib.decompress(r[2]), np.uint8)
    return out


def contains(planes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the plane has a key in all of its rows."""
    depth, bits = planes.shape[0], int(planes.shape[1]).bit_length() + 2
    hit = get_bits(planes[0], cells(keys, 0, bits))
    for r in range(1, depth):
        at = np.flatnonzero(hit)
        hit[at] = get_bits(planes[r], cells(keys[at], r, bits))
    return hit
