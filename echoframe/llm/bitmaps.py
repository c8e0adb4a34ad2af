"""Bitmaps of hashed items, small enough to broadcast: a filter with false positives, never false negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import schema_of

#: Greatest size of a bitmap; callers take another way beyond it.
BITMAP_BYTES = 64 << 20
#: Bits for each item: 3 % false positives at most.
BITS_PER_ITEM = 32


def fits(n: int, most: int = BITMAP_BYTES) -> bool:
    return (1 << max(16, (BITS_PER_ITEM * n - 1).bit_length())) <= 8 * most


def bitmap_of(items: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the n 64-bit hashes in the first column of items, built in slices by the executors."""
    bits = 1 << max(16, (BITS_PER_ITEM * n - 1).bit_length())
    out = schema_of("slice long, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.asarray(b.column(0)).view(np.uint64) & np.uint64(bits - 1)
            part = (at >> np.uint64(16)).astype(np.int64)
            for s in np.unique(part):
                flags = slices.setdefault(int(s), np.zeros(1 << 13, np.uint8))
                np.bitwise_or.at(flags, ((at[part == s] & np.uint64(0xFFFF)) >> np.uint64(3)).astype(np.int64), (1 << (at[part == s] & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int64()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], names=out.names)

    rows = items.select(F.col(items.columns[0]).alias("item")).withColumn("slice", F.expr(f"shiftright(item & {bits - 1}L, 16)")).repartition("slice").select("item").mapInArrow(run, out)
    got = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for s, x in rows.toLocalIterator():
        got[s] = np.frombuffer(bytes(x), np.uint8)
    return got.reshape(-1)


def in_bitmap(bitmap: np.ndarray, item: np.ndarray) -> np.ndarray:
    at = item & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
