"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines ends a chunk where it falls on a
quarter of its values, so boundaries move with the content when lines are put in or
taken out, and chunks have four lines on average. Chunks of two lines or more that
occur more than once in the corpus are removed after a comparison of their bytes, but for
their first occurrence (least doc_id, then place in the text).

A chunk is removed only if it begins and ends inside a repeated run, which most runs of a few
lines do not allow. With pairs=True every two lines in succession are a unit beside the
chunks, so all lines of a repeated run of two lines or more are removed.

Only hashes are counted over the whole corpus; a bitmap of the recurring ones, of checked
size, picks the chunks whose bytes are shuffled (beyond that size all chunks' bytes are).
Another bitmap picks the rows that lose chunks: only these are shuffled to meet the numbers
of their chunks, and the others never leave their task.

Defined results
---------------
* Lines end at \\n; what is kept is joined by \\n. A null text stays null; an empty one has one empty line.
* Chunks of one line are never removed, nor chunks without any byte that is not white space.
* Pairs are of lines that are not white space only; lines between the two that are belong to the pair. A pair that shares a line with its own first occurrence is not removed.
* A null doc_id comes after all others; rows with equal doc_id and text are treated alike.
* Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .bitmaps import BITMAP_BYTES, bitmap_of, fits, in_bitmap
from .frames import discard, fresh, schema_of, written

#: One line pair in so many ends a chunk.
SPREAD = 4
LAST = (1 << 63) - 1
#: Numbers of pairs begin here, those of chunks at 0; their hashes differ by SALT.
PAIRS = 1 << 40
SALT = np.uint64(0x5851F42D4C957F2D)


class Chunks:
    """Chunks of the rows of a block, as ranges of bytes and of lines; and, if asked for, pairs of lines."""

    def __init__(self, block: K.Block, pairs: bool = False):
        starts, ends, lines = block.lines()
        h = K.byte_hash(block.buf, starts, ends)
        row = K.rows_of(lines)
        before = np.concatenate([[np.uint64(0)], h[:-1]])
        before[lines[:-1]] = 0
        last = K.mix(before * np.uint64(0x9E3779B97F4A7C15) + h) % np.uint64(SPREAD) == 0
        last[lines[1:] - 1] = True
        to = np.flatnonzero(last)
        first = np.concatenate([[0], to[:-1] + 1]) if len(to) else to
        self.row = row[first]
        self.bounds = np.searchsorted(self.row, np.arange(block.n + 1))
        self.number = np.arange(len(first)) - self.bounds[self.row]
        self.lines = to - first + 1
        self.starts, self.ends = starts[first], ends[to]
        self.first, self.line_starts, self.line_ends, self.line_bounds = first, starts, ends, lines
        word = np.concatenate([[0], np.cumsum(K.NOT_SPACE[block.buf])])
        able = np.flatnonzero((self.lines > 1) & (word[self.ends] > word[self.starts]))
        at, to = self.starts[able], self.ends[able]
        #: Units that may be removed: row, number, bytes, hash.
        self.unit_row, self.unit_number, self.unit_starts, self.unit_sizes = self.row[able], self.number[able], at, to - at
        self.unit_hashes = K.byte_hash(block.buf, at, to)
        if pairs:
            full = np.flatnonzero(word[ends] > word[starts])
            same = np.flatnonzero(row[full[1:]] == row[full[:-1]])
            self.pair_first, self.pair_last = full[same], full[same + 1]
            of = row[self.pair_first]
            self.pair_bounds = np.searchsorted(of, np.arange(block.n + 1))
            at, to = starts[self.pair_first], ends[self.pair_last]
            self.unit_row = np.concatenate([self.unit_row, of])
            self.unit_number = np.concatenate([self.unit_number, PAIRS + np.arange(len(of)) - self.pair_bounds[of]])
            self.unit_starts, self.unit_sizes = np.concatenate([self.unit_starts, at]), np.concatenate([self.unit_sizes, to - at])
            self.unit_hashes = np.concatenate([self.unit_hashes, K.byte_hash(block.buf, at, to) ^ SALT])


def _hashes(docs: DataFrame, pairs: bool) -> DataFrame:
    out = schema_of("hash long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(Chunks(block, pairs).unit_hashes.view(np.int64))], names=out.names)

    return docs.mapInArrow(run, out)


FOUND = schema_of("doc_id long, row_key long, number long, hash long, chunk string")


def _candidates(docs: DataFrame, shared, pairs: bool) -> DataFrame:
    """Chunks and pairs that may recur, with their bytes. shared: a broadcast bitmap, or None for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(2)):
                c = Chunks(block, pairs)
                at = np.arange(len(c.unit_row)) if shared is None else np.flatnonzero(in_bitmap(shared.value, c.unit_hashes))
                part = b.select([0, 1]).slice(block.first, block.n).take(pa.array(c.unit_row[at]))
                size = c.unit_sizes[at]
                texts = K.strings(K.gather(block.buf, c.unit_starts[at], size), np.concatenate([[0], np.cumsum(size)])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(c.unit_number[at]), pa.array(c.unit_hashes[at].view(np.int64)), texts], names=FOUND.names)

    return docs.mapInArrow(run, FOUND)


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bitmap_bytes: int = BITMAP_BYTES, pairs: bool = False) -> DataFrame:
    """(doc_id, row_key, removed): numbers of the chunks and pairs to remove, for rows that lose any, as a table. row_key: xxhash64 of the text."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).alias("text"))
    recurring = written(_hashes(docs, pairs).groupBy("hash").count().where("count > 1").select("hash"), "lines")
    n = recurring.count()
    shared = df.sparkSession.sparkContext.broadcast(bitmap_of(recurring, n)) if fits(n, bitmap_bytes) else None
    found = written(_candidates(docs, shared, pairs).withColumn("place", F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "row_key", "number")), "chunks")
    first = written(found.groupBy("hash", "chunk").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    gone = found.join(first, ["hash", "chunk"]).where("place != first")
    own = "place.d = first.d AND place.row_key = first.row_key AND place.number = first.number + 1"
    gone = gone.where(f"number < {PAIRS} OR NOT ({own})")
    out = written(gone.groupBy("doc_id", "row_key").agg(F.collect_set("number").alias("removed")), "removals")
    discard(recurring, found, first)
    return out


def _each_with_removed(df: DataFrame, doc_id: str, text: str, bitmap_bytes: int, pairs: bool, run: Callable, out: T.StructType) -> DataFrame:
    """run(batches) over the rows of df, with a last column of the chunks and pairs to remove (null: none)."""
    hash_, id_, key, list_ = fresh(df, "_gone_hash", "_gone_id", "_gone_key", "_gone")
    gone = removals(df, doc_id, text, bitmap_bytes, pairs).withColumnsRenamed({"doc_id": id_, "row_key": key, "removed": list_})
    keyed = df.withColumn(hash_, F.xxhash64(df[doc_id].cast("long"), F.xxhash64(df[text])))
    n = gone.count()
    shared = df.sparkSession.sparkContext.broadcast(bitmap_of(gone.select(F.xxhash64(id_, key).alias("h")), n)) if fits(n, bitmap_bytes) else None
    nothing = pa.list_(pa.field("element", pa.int64(), False))

    def split(b: pa.RecordBatch, hit: bool) -> pa.RecordBatch:
        at = b.num_columns - 1
        flags = in_bitmap(shared.value, np.asarray(b.column(at)).view(np.uint64)) if shared is not None else np.ones(b.num_rows, bool)
        return b.filter(pa.array(flags == hit)).select(range(at))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield split(b, True)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (split(b, False) for b in batches)
        yield from run(p.append_column(list_, pa.nulls(p.num_rows, nothing)) for p in parts)

    own = keyed.mapInArrow(hits, df.schema)
    met = own.hint("merge").join(gone, own[doc_id].cast("long").eqNullSafe(gone[id_]) & (F.xxhash64(own[text]) == gone[key]), "left").drop(id_, key)
    done = met.mapInArrow(run, out)
    return done if shared is None else done.unionByName(keyed.mapInArrow(others, out))


def _kept(block: K.Block, lists: pa.Array, pairs: bool) -> tuple[Chunks, np.ndarray]:
    """The chunks of a block, and which lines are kept."""
    c = Chunks(block, pairs)
    row = np.repeat(np.arange(block.n), np.asarray(lists.value_lengths().fill_null(0)))
    number = np.asarray(lists.flatten()).astype(np.int64)
    chunk = number < PAIRS
    at = number[chunk] + c.bounds[row[chunk]]
    starts, ends = c.first[at], c.first[at] + c.lines[at]
    if pairs:
        at = number[~chunk] - PAIRS + c.pair_bounds[row[~chunk]]
        starts, ends = np.concatenate([starts, c.pair_first[at]]), np.concatenate([ends, c.pair_last[at] + 1])
    return c, ~K.cover(len(c.line_starts), starts, ends)


def _texts(block: K.Block, c: Chunks, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept lines, joined by a newline in each row, and bounds of the rows."""
    at = np.flatnonzero(kept)
    row = K.rows_of(c.line_bounds)[at]
    last = np.ones(len(at), bool)
    last[:-1] = row[1:] != row[:-1]
    size = c.line_ends[at] - c.line_starts[at] + ~last
    data = K.gather(np.append(block.buf, np.uint8(10)), c.line_starts[at], size)
    ends = np.concatenate([[0], np.cumsum(size)])
    data[(ends[1:] - 1)[~last]] = 10
    return data, ends[np.searchsorted(row, np.arange(block.n + 1))]


def apply(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bitmap_bytes: int = BITMAP_BYTES, pairs: bool = False) -> DataFrame:
    """The rows of df with recurring chunks, and pairs of lines if asked for, cut out of the text; all columns stay."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, gone = b.column(b.schema.get_field_index(text)), b.column(b.num_columns - 1)
            for block in K.blocks(col):
                c, kept = _kept(block, gone.slice(block.first, block.n), pairs)
                new = K.strings(*_texts(block, c, kept)).cast(pa.string())
                null = np.asarray(col.slice(block.first, block.n).is_null())
                if null.any():
                    new = new.take(pa.array(np.arange(block.n), mask=null))
                part = b.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([new if n == text else part.column(part.schema.get_field_index(n)) for n in names], names=names)

    return _each_with_removed(df, doc_id, text, bitmap_bytes, pairs, run, df.schema)


OUT = schema_of("doc_id long, n_lines long, n_chunks long, n_removed_lines long, kept_sha256 string")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bitmap_bytes: int = BITMAP_BYTES, pairs: bool = False) -> DataFrame:
    """One row per row of df: lines, chunks, removed lines, sha256 of the text that is left (of an empty one for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(1)):
                c, kept = _kept(block, b.column(2).slice(block.first, block.n), pairs)
                data, at = _texts(block, c, kept)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(block.first, block.n), pa.array(np.diff(c.line_bounds)), pa.array(np.diff(c.bounds)), pa.array(K.per_row(~kept, c.line_bounds)),
                    pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                ], names=OUT.names)

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _each_with_removed(docs, "doc_id", "text", bitmap_bytes, pairs, run, OUT)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), pairs=True)
