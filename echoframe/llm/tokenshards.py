"""Training-order materialisation: token-id sequences in a keyed pseudo-random order, as fixed-stride shards.

Texts become ids of a public byte-level vocabulary; each document ends with an
end-of-text id and is cut into sequences of fixed length, the last one filled up. A first
pass counts the sequences of every input block, so that each sequence has a number in file
and row order; a keyed Feistel network with cycle-walking turns numbers into global
slots, one to one. A second pass sends each sequence to the partition that holds its
range of slots, which Spark sorts, and which is streamed to binary files of fixed stride. Any
range of slots is then one sequential read.

Both passes encode: keeping the ids of the first one would take more disk than it saves time.

Defined results
---------------
* A null or empty text has no sequence. Repeated rows have sequences of their own.
* The order depends on the key, the number of sequences, and the order of rows in the files (by path), not on how the files are split into tasks.
* The manifest names key, vocabulary and a digest of all ids. A folder with another run's manifest is refused, unless overwrite=True empties it first.
* A shard appears whole or not at all; one that is there is left alone if its bytes are the same (size and CRC-32), and written anew otherwise.
* Frames that are no plain scan of files (behind a shuffle, a join, a limit) are written to the shared folder first, which fixes their order.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from . import textkernel as K
from .frames import schema_of, shared_dir, written

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
SEQUENCE = 256
#: Sequences in a shard: 32 MiB of two-byte ids.
SHARD_SEQUENCES = 65_536
ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of [0, n): a balanced Feistel network on the next even number of bits, walked on until it falls inside."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = K.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = np.asarray(x).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right ^ k) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


class ByteBpe:
    """A byte-level vocabulary; its units start at white space after something else, where its pattern always splits."""

    def __init__(self, ranks: bytes):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)  # bytes of each id
        self.sizes[list(table.values())] = list(map(len, table))

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls(f.read())

    def solve(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units end to end, and how many each has.

        Units that begin at white space and end with something else are encoded in one piece, as
        the pattern splits between them; the others one by one.
        """
        last = buf[ends - 1]
        size = ends - starts
        # a byte above 0x7F may end white space of several bytes
        odd = (last >= 0x80) & ((size < 3) | (buf[np.maximum(ends - 2, 0)] == 0xC2) | np.isin(buf[np.maximum(ends - 3, 0)], (0xE1, 0xE2, 0xE3)))
        plain = ~K.NOT_SPACE[buf[starts]] & K.NOT_SPACE[last] & ~odd & ~((last >= 0x1C) & (last <= 0x1F))
        counts = np.zeros(len(starts), np.int64)
        encode = self.encoding._core_bpe.encode_ordinary
        some = np.flatnonzero(plain)
        joined = K.gather(buf, starts[some], size[some])
        many = np.array(encode(joined.tobytes().decode()), np.int32)
        edge = np.concatenate([[0], np.cumsum(size[some])])
        at = np.searchsorted(np.concatenate([[0], np.cumsum(self.sizes[many])]), edge)
        counts[some] = np.diff(at)
        raw = buf.tobytes()
        rest = np.flatnonzero(~plain)
        alone = [encode(raw[s:e].decode()) for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        counts[rest] = [len(x) for x in alone]
        out = np.empty(int(counts.sum()), np.int32)
        where = np.repeat(plain, counts)
        out[where] = many
        out[~where] = [i for x in alone for i in x]
        return out, counts


class BpeEncoder(pieces.Encoder):
    def units(self, block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = block.buf
        space = ~K.NOT_SPACE[b]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if len(b) > 3:  # other white space before a space goes on with it
            p1, p2, p3 = b[2:-1], b[1:-2], b[:-3]
            wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80) | (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
            cut[3:] &= ~wide
            if b[0] == 0xC2 and b[1] in (0x85, 0xA0):
                cut[2] = False
        cut[block.bounds[:-1][np.diff(block.bounds) > 0]] = True
        return b, block.bounds, np.flatnonzero(cut)


_encoder: tuple[str, BpeEncoder] | None = None


def encoder_of(shared) -> BpeEncoder:
    """This worker's encoder of a broadcast vocabulary."""
    global _encoder
    key, ranks = shared.value
    if _encoder is None or _encoder[0] != key:
        _encoder = (key, BpeEncoder(ByteBpe(ranks)))
    return _encoder[1]


def shared_ranks(spark: SparkSession, path: str | None = None):
    """A broadcast of a vocabulary file's digest and bytes (about a megabyte), so that only the driver reads it."""
    with open(path or os.path.join(pieces.TOKENIZER_DIR, VOCABULARY), "rb") as f:
        ranks = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(ranks).hexdigest(), ranks))


def store(uri: str):
    """File system and path of a folder's URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ShardFile:
    """A file that is written as a stream under another name, and takes its own name once it is whole."""

    def __init__(self, uri: str, name: str):
        self.files, path = store(uri)
        self.target = f"{path}/{name}"
        self.files.create_dir(path, recursive=True)
        self.part = f"{self.target}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.part)
        self.size = self.crc = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)

    def close(self) -> None:
        """Puts the file in its place, unless one of the same bytes is there."""
        self.out.close()
        self.out = None
        if self._same():
            self.files.delete_file(self.part)
        else:
            self.files.move(self.part, self.target)

    def _same(self) -> bool:
        if self.files.get_file_info(self.target).size != self.size:
            return False
        crc = 0
        with self.files.open_input_stream(self.target) as f:
            while data := f.read(8 << 20):
                crc = zlib.crc32(data, crc)
        return crc == self.crc

    def drop(self) -> None:
        """Takes the unfinished file away."""
        if self.out is not None:
            self.out.close()
            self.files.delete_file(self.part)


def put(uri: str, name: str, data: bytes) -> None:
    """Writes a file whole; leaves one of the same bytes alone."""
    f = ShardFile(uri, name)
    f.write(data)
    f.close()


def claim(uri: str, manifest: dict, overwrite: bool) -> None:
    """Writes the manifest. A folder with another one is emptied if `overwrite`, else refused."""
    files, path = store(uri)
    if files.get_file_info(f"{path}/manifest.json").size is not None:
        with files.open_input_stream(f"{path}/manifest.json") as f:
            other = json.loads(f.read()) != manifest
        if other and not overwrite:
            raise ValueError(f"{uri} holds the shards of another run; overwrite=True replaces them")
        if other:
            files.delete_dir_contents(path)
    put(uri, "manifest.json", json.dumps(manifest).encode())


def _scanned(df: DataFrame) -> bool:
    """Whether df is a plain scan of files, so that each of its rows knows its file and comes in the file's order."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation"):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return bool(df.inputFiles())


def _counts(rows: DataFrame, ranks, length: int) -> DataFrame:
    """Sequences of each split of an input file, and a digest of its ids, which does not depend on the order of splits."""
    out = schema_of("file string, block long, n long, digest long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = encoder_of(ranks), {}
        for b in batches:
            files, starts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for block in K.blocks(b.column(3), pieces.TEXT_BYTES):
                ids, bounds = enc.encode(block)
                n = _sequences(np.diff(bounds), length).tolist()
                digest = K.span_hash(ids.astype(np.uint64), bounds[:-1], bounds[1:]).view(np.int64).tolist()
                for k in range(block.n):
                    at = files[block.first + k], starts[block.first + k]
                    old, held = sums.get(at, (0, 0))
                    sums[at] = old + n[k], held ^ digest[k]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=out.names)

    return rows.mapInArrow(run, out).groupBy("file", "block").agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"))


def _sequences(tokens: np.ndarray, length: int) -> np.ndarray:
    """Sequences of documents of so many ids; the end-of-text id is one more."""
    return np.where(tokens > 0, -(-(tokens + 1) // length), 0)


@dataclass(frozen=True)
class Splits:
    """Splits of the input files: sorted hashes of (file, block), and the number of the first sequence of each. 16 bytes a split."""

    keys: np.ndarray
    first: np.ndarray

    def number(self, key: int) -> int:
        return int(self.first[np.searchsorted(self.keys, key)])


PLACED = schema_of("part int, slot long, doc_id long, sequence long, ids binary")


def _placed(rows: DataFrame, ranks, length: int, end: int, splits, total: int, key: int, per_part: int) -> DataFrame:
    """Every sequence with its slot; ids of two bytes, not filled up. rows: (split, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder_of(ranks), {}
        for b in batches:
            split = np.asarray(b.column(0))
            for block in K.blocks(b.column(2), pieces.TEXT_BYTES):
                ids, bounds = enc.encode(block)
                tokens = np.diff(bounds)
                n = _sequences(tokens, length)
                acc = np.concatenate([[0], np.cumsum(n)])
                own = split[block.first : block.first + block.n]
                base = np.zeros(block.n, np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [block.n]])
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    at = int(own[s])
                    if at not in seen:
                        seen[at] = splits.value.number(at)
                    base[s:e] = seen[at] + acc[s:e] - acc[s]
                    seen[at] += int(acc[e] - acc[s])
                row = np.repeat(np.arange(block.n), n)
                number = np.arange(len(row)) - acc[:-1][row]
                full = np.flatnonzero(tokens > 0)
                stream = np.insert(ids.astype("<u2"), bounds[1:][full], end)
                left = np.minimum(tokens[row] + 1 - number * length, length)
                offsets = np.concatenate([[0], np.cumsum(2 * left)]).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(stream)])
                slot = feistel(base[row] + number, total, key)
                yield pa.RecordBatch.from_arrays([pa.array((slot // per_part).astype(np.int32)), pa.array(slot), b.column(1).slice(block.first, block.n).take(pa.array(row)), pa.array(number), data], names=PLACED.names)

    return rows.mapInArrow(run, PLACED)


OUT = schema_of("slot long, shard long, byte_offset long, doc_id long, sequence long, n_tokens long, crc32 long")
#: Partitions of the second pass; beyond it a partition writes several shards in a row.
MOST_PARTS = 100_000


def materialise(df: DataFrame, to: str, key: int = 20240229, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE, per_shard: int = SHARD_SEQUENCES, vocabulary: str | None = None, end: int = END_OF_TEXT, overwrite: bool = False) -> DataFrame:
    """Writes shards and a manifest to the folder `to` (a URI all machines reach), as the returned rows are computed: one per sequence."""
    spark = df.sparkSession
    ranks = shared_ranks(spark, vocabulary)
    if not _scanned(df):
        df = written(df.select(doc_id, text), "sequences")
    file, block = F.input_file_name(), F.input_file_block_start()
    rows = df.select(file.alias("file"), block.alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a few bytes for each split of an input file, as many as the driver plans anyway
    counts = _counts(rows, ranks, length).orderBy("file", "block").select(F.xxhash64("file", "block").alias("split"), "n", "digest").toArrow()
    n, keys = np.asarray(counts["n"], np.int64), np.asarray(counts["split"], np.int64)
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise RuntimeError("two splits have the same hash")
    splits = Splits(keys[order], (np.cumsum(n) - n)[order])
    total = int(n.sum())
    shards = max(1, -(-total // per_shard))
    per_part = per_shard * -(-shards // MOST_PARTS)
    stride = 2 * length
    digest = hashlib.sha256(np.ascontiguousarray(np.stack([n, np.asarray(counts["digest"], np.int64)])).astype("<i8").tobytes()).hexdigest()
    claim(to, {"sequences": total, "length": length, "dtype": "<u2", "stride": stride, "per_shard": per_shard, "shards": shards, "key": key, "end_of_text": end, "vocabulary": ranks.value[0], "input": digest}, overwrite)
    placed = _placed(df.select(F.xxhash64(file, block).alias("split"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), ranks, length, end, spark.sparkContext.broadcast(splits), total, key, per_part)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, due = None, None
        try:
            for b in batches:
                slot = np.asarray(b.column(1))
                if not len(slot):
                    continue
                due = int(slot[0]) // per_part * per_part if due is None else due
                if not (slot == np.arange(due, due + len(slot))).all():
                    raise RuntimeError(f"slots are missing or twice from {due} on")
                ids, at = K.bytes_of(b.column(4))
                data = np.full((len(slot), length), end, "<u2")
                size = np.diff(at) // 2
                data.reshape(-1)[np.repeat(np.arange(len(slot)) * length - at[:-1] // 2, size) + np.arange(len(ids) // 2)] = ids.view("<u2")
                shard = slot // per_shard
                for k in np.unique(shard).tolist():
                    own = data[shard == k].tobytes()
                    out = out or ShardFile(to, f"shard-{k:08d}.bin")
                    out.write(own)
                    if out.size == stride * min(per_shard, total - k * per_shard):
                        out.close()
                        out = None
                due += len(slot)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(shard), pa.array((slot % per_shard) * stride), b.column(2), b.column(3), pa.array(size), pa.array([zlib.crc32(x) for x in data], pa.int64())], names=OUT.names)
            if due is not None and due != total and due % per_part:
                raise RuntimeError(f"slots are missing from {due} on")
        finally:
            if out is not None:
                out.drop()

    parts = max(1, -(-total // per_part))
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("slot").mapInArrow(write, OUT)


def read(at: str, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences of the slots [start, start + count), in order, one shard's range at a time."""
    files, path = store(at)
    with files.open_input_stream(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["sequences"] if count is None else min(m["sequences"], start + count)
    while start < stop:
        shard, skip = divmod(start, m["per_shard"])
        n = min(stop - start, m["per_shard"] - skip)
        with files.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(skip * m["stride"])
            yield from np.frombuffer(f.read(n * m["stride"]), m["dtype"]).reshape(n, m["length"])
        start += n


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/echoframe-shards-{uuid.uuid4().hex}")
