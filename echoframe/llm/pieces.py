"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A piece table is read from a model file: pieces with log scores, byte pieces for
fallback, and the white-space marker, which stands for a space. The table is laid
out as a double array (`base`, `check`, `value`), and the segmentation of a text is
the one of greatest summed score. Pieces never have a space after another
character, so a text splits before each run of spaces into units that are solved
independently; equal units of a block are solved once, many at a time, in NumPy.

Defined results
---------------
* A space is put before a non-empty text, as the format asks, and taken away by decoding.
* A character without a piece becomes its UTF-8 bytes. The marker character itself,
  U+2581, always does, so that decode(encode(text)) == text for every text.
* Equal scores: the segmentation whose last piece is longest wins, from the end backwards.
* A null text has no ids (null) and decodes to null; an empty text has an empty list.
* Other columns pass through; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .frames import schema_of

TOKENIZER_DIR = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARKER = "▁"
#: Constants of the Zipf-Mandelbrot law, by which merge ranks become log scores: p ~ 1 / (rank + SHIFT).
SHIFT = 2.7
#: Bytes of text that are encoded together.
TEXT_BYTES = 4 << 20
#: Longer units are solved one by one.
WIDE = 96


def log_scores(pieces: list[tuple[bytes, float, int]]) -> list[tuple[bytes, float, int]]:
    """Pieces with log probabilities. Scores that are merge ranks (whole numbers from 0 down, as in merge models) become those of the law of SHIFT, a piece beyond the last rank having that one; others are log probabilities already."""
    if len(pieces) < 2 or any(s > 0 or s != int(s) for _, s, _ in pieces):
        return pieces
    weight = [1 / (SHIFT + min(-s, len(pieces))) for _, s, _ in pieces]
    total = math.log(sum(weight))
    return [(p, math.log(w) - total, i) for (p, _, i), w in zip(pieces, weight, strict=True)]


@dataclass
class PieceTable:
    """A double-array trie of pieces; broadcast to the executors (about 25 bytes a node)."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    single: np.ndarray
    byte_ids: np.ndarray
    pool: np.ndarray
    pool_at: np.ndarray
    split_newline: bool
    longest: int
    fallback: float

    @classmethod
    def build(cls, pieces: list[tuple[bytes, float, int]], byte_ids: dict[int, int], size: int) -> PieceTable:
        """pieces: (bytes with the marker as a space, score, id)."""
        if any(b" " in p.lstrip(b" ") for p, _, _ in pieces):
            raise ValueError("a piece has a space after another character")
        root: dict = {}
        for p, _, i in pieces:
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[-1] = i
        base, check, value = ([x] * (1 << 16) for x in (0, -1, -1))
        check[0] = 0
        queue, start = [(0, root)], 1
        for at, node in queue:
            value[at] = node.get(-1, -1)
            codes = sorted(c + 1 for c in node if c >= 0)
            if not codes:
                continue
            low, b, taken = codes[0], max(start - codes[0], 0), 0
            while True:
                while b + 257 >= len(check):
                    for x, fill in ((base, 0), (check, -1), (value, -1)):
                        x.extend([fill] * len(x))
                if check[b + low] >= 0:
                    taken += 1
                elif all(check[b + c] < 0 for c in codes):
                    break
                b += 1
            if taken > 0.9 * (b + low - start + 1):  # the slots before are nearly full
                start = b + low
            base[at] = b
            for c in codes:
                check[b + c] = at
                queue.append((b + c, node[c - 1]))
        for x, fill in ((base, 0), (check, -1), (value, -1)):
            x.extend([fill] * 258)  # a step from any slot stays inside
        base, check, value = (np.array(x, np.int32) for x in (base, check, value))
        scores = np.zeros(size)
        text = [b""] * size
        for p, s, i in pieces:
            scores[i], text[i] = s, p
        ids = np.full(256, -1, np.int32)
        for c, i in byte_ids.items():
            ids[c], text[i] = i, bytes([c])
        if (ids < 0).any():
            raise ValueError("a byte has no piece")
        at = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in text], out=at[1:])
        single = np.array([len(x.decode(errors='replace')) == 1 for x in text])
        return cls(base, check, value, scores, single, ids, np.frombuffer(b"".join(text), np.uint8), at, not any(b"\n" in p for p, _, _ in pieces), max([len(p) for p, _, _ in pieces], default=1), -2 * WIDE * (1 + float(np.abs(scores).max(initial=0))))

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n, byte_ids, pieces = m.get_piece_size(), {}, []
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                pieces.append((p.replace(MARKER, " ").encode(), m.get_score(i), i))
        return cls.build(log_scores(pieces), byte_ids, n)

    def solve(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of byte ranges: ids end to end, and how many each range has."""
        counts = np.zeros(len(starts), np.int64)
        sizes = ends - starts
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges = [0, 4, 6, 8, 10, 12, 16, 24, 40, WIDE]
        for low, high in zip(edges, edges[1:], strict=False):
            for at in np.array_split(np.flatnonzero((sizes > low) & (sizes <= high)), max(1, int(((sizes > low) & (sizes <= high)).sum()) * high // 1_000_000 + 1)):
                if len(at):
                    rows, order, ids = self._solve_many(buf, starts[at], sizes[at])
                    counts[at] = np.bincount(rows, minlength=len(at))
                    parts.append((at[rows], order, ids))
        for i in np.flatnonzero(sizes > WIDE):
            ids = self._solve_one(buf[starts[i] : ends[i]].tobytes())
            counts[i] = len(ids)
            parts.append((np.full(len(ids), i), np.arange(len(ids)), ids))
        if not parts:
            return np.zeros(0, np.int32), counts
        rows, order, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.cumsum(counts) - counts
        out = np.empty(len(ids), np.int32)
        out[place[rows] + order] = ids
        return out, counts

    def _solve_many(self, buf, starts, sizes):
        n, width, shortest = len(starts), int(sizes.max()), int(sizes.min())
        grid = np.zeros((width, n), np.int32)
        flat = np.cumsum(sizes) - sizes
        rows = np.repeat(np.arange(n), sizes)
        grid[np.arange(len(rows)) - flat[rows], rows] = K.gather(buf, starts, sizes)
        best = np.full((width + 1, n), -np.inf)
        back = np.zeros((width + 1, n), np.int16)
        piece = np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        for s in range(width):
            alive = np.flatnonzero((best[s] > -np.inf) & (sizes > s))
            if not len(alive):
                continue
            at, state, here = alive, np.zeros(len(alive), np.int32), best[s]
            single = np.zeros(n, bool)
            for j in range(s, min(width, s + self.longest)):
                nxt = self.base[state] + grid[j, at] + 1  # a zero beyond the end is no byte of a piece
                ok = self.check[nxt] == state
                if j >= shortest:
                    ok &= sizes[at] > j
                at, state = at[ok], nxt[ok]
                if not len(at):
                    break
                v = self.value[state]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    r, v = at[hit], v[hit]
                    if j - s < 4:
                        single[r[self.single[v]]] = True
                    cand = here[r] + self.scores[v]
                    better = cand > best[j + 1, r]
                    r, v = r[better], v[better]
                    best[j + 1, r], back[j + 1, r], piece[j + 1, r] = cand[better], s, v
            rest = alive[~single[alive]]
            if len(rest):  # the character's bytes
                first = grid[s, rest]
                size = np.minimum(1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0), sizes[rest] - s)
                cand = best[s, rest] + self.fallback
                better = cand > best[s + size, rest]
                r, e = rest[better], (s + size)[better]
                best[e, r], back[e, r], piece[e, r] = cand[better], s, -1
        # from the end backwards; then the order is turned round
        at, end, rows, ends, begins, ids = np.arange(n), sizes.copy(), [], [], [], []
        while len(at):
            b = back[end, at].astype(np.int64)
            rows.append(at), ends.append(end), begins.append(b), ids.append(piece[end, at])
            go = b > 0
            at, end = at[go], b[go]
        rows, ends, begins, ids = (np.concatenate(x) for x in (rows, ends, begins, ids))
        many = np.where(ids < 0, ends - begins, 1)
        where = np.lexsort((begins, rows))
        rows, begins, ids, many = rows[where], begins[where], ids[where], many[where]
        if (ids < 0).any():
            src = np.repeat(np.arange(len(ids)), many)
            step = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
            out, fallback = ids[src], ids[src] < 0
            out[fallback] = self.byte_ids[grid[begins[src][fallback] + step[fallback], rows[src][fallback]]]
            rows, ids = rows[src], out
        per = np.bincount(rows, minlength=n)
        return rows, np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per), ids

    def _solve_one(self, unit: bytes) -> np.ndarray:
        """As _solve_many, for one unit of any length: fewest fallbacks first, then the greatest score."""
        n = len(unit)
        base, check, value, scores, low = memoryview(self.base), memoryview(self.check), memoryview(self.value), memoryview(self.scores), len(self.check)
        lost, best, back, piece = [n + 1] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        lost[0] = 0
        for s in range(n):
            f, here = lost[s], best[s]
            if f > n:
                continue
            size = min(1 + (unit[s] >= 0xC0) + (unit[s] >= 0xE0) + (unit[s] >= 0xF0), n - s)
            state, single = 0, False
            for j in range(s, min(n, s + self.longest)):
                nxt = base[state] + unit[j] + 1
                if nxt >= low or check[nxt] != state:
                    break
                state = nxt
                v = value[state]
                if v >= 0:
                    single |= j + 1 == s + size
                    if f < lost[j + 1] or f == lost[j + 1] and here + scores[v] > best[j + 1]:
                        lost[j + 1], best[j + 1], back[j + 1], piece[j + 1] = f, here + scores[v], s, v
            if not single and (f + 1 < lost[s + size] or f + 1 == lost[s + size] and here > best[s + size]):
                lost[s + size], best[s + size], back[s + size], piece[s + size] = f + 1, here, s, -1
        out, e = [], n
        while e:
            b = back[e]
            out += [piece[e]] if piece[e] >= 0 else [int(self.byte_ids[c]) for c in reversed(unit[b:e])]
            e = b
        return np.array(out[::-1], np.int32)

class Encoder:
    """Encodes blocks of rows with a table. Equal units of a block, by their bytes, are solved once; nothing is kept between blocks."""

    def __init__(self, pieces):
        self.t = pieces

    def units(self, block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes to encode, bounds of the rows in them, and where units start."""
        full = np.diff(block.bounds) > 0
        heads = block.bounds[:-1][full]
        buf = np.insert(block.buf, heads, 32)
        bounds = block.bounds + np.concatenate([[0], np.cumsum(full)])
        n = len(buf)
        space = buf == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[bounds[:-1][full]] = True
        if self.t.split_newline:
            newline = np.flatnonzero(buf == 10)
            cut[newline] = True
            cut[newline[newline + 1 < n] + 1] = True
        return buf, bounds, np.flatnonzero(cut)

    def encode(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and each row's bounds among them."""
        buf, bounds, starts = self.units(block)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(block.n + 1, np.int64)
        coded = K.distinct(buf, np.append(starts, len(buf)))
        own, at = K.bytes_of(coded.dictionary)
        ids, counts = self.t.solve(own, at[:-1], at[1:])
        slot = np.asarray(coded.indices)
        size = counts[slot]
        out = K.gather(ids, (np.cumsum(counts) - counts)[slot], size)
        acc = np.concatenate([[0], np.cumsum(size)])
        return out, acc[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, and each row's bounds among them."""
        size = self.t.pool_at[ids + 1] - self.t.pool_at[ids]
        data = K.gather(self.t.pool, self.t.pool_at[ids], size)
        acc = np.concatenate([[0], np.cumsum(size)])
        at = acc[bounds]
        heads = at[:-1][np.diff(at) > 0]
        heads = heads[data[heads] == 32]
        return np.delete(data, heads), at - np.searchsorted(heads, at)


_encoder: tuple[str, Encoder] | None = None


def encoder_of(shared) -> Encoder:
    """This worker's encoder of a broadcast table."""
    global _encoder
    key, pieces = shared.value
    if _encoder is None or _encoder[0] != key:
        _encoder = (key, Encoder(pieces))
    return _encoder[1]


_tables: dict[tuple[str, float], PieceTable] = {}


def shared_table(spark: SparkSession, path: str | None = None):
    """A broadcast of the table of a model file; its size is bounded by the vocabulary."""
    path = path or os.path.join(TOKENIZER_DIR, MODEL)
    key = (path, os.path.getmtime(path))
    if key not in _tables:
        _tables[key] = PieceTable.load(path)
    return spark.sparkContext.broadcast((f"{key}", _tables[key]))


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + list(fields))


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", model: str | None = None) -> DataFrame:
    """Adds the ids of `text` as array<int>; all other columns pass through."""
    shared = shared_table(df.sparkSession, model)
    schema = with_columns(df.schema, T.StructField(out, T.ArrayType(T.IntegerType(), False)))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            for block in K.blocks(col, TEXT_BYTES):
                ids, bounds = enc.encode(block)
                null = np.asarray(col.slice(block.first, block.n).is_null())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                part = b.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [lists], names=[*keep, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "text", model: str | None = None) -> DataFrame:
    """Adds the text of `ids` as string; all other columns pass through."""
    shared = shared_table(df.sparkSession, model)
    schema = with_columns(df.schema, T.StructField(out, T.StringType()))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            sizes = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
            data, bounds = enc.decode(np.asarray(col.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            texts = K.strings(data, bounds).cast(pa.string())
            if col.null_count:
                texts = texts.take(pa.array(np.arange(len(col)), mask=np.asarray(col.is_null())))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [texts], names=[*keep, out])

    return df.mapInArrow(run, schema)


def same_rows(block: K.Block, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of the block equal data[at[i]:at[i+1]]."""
    same = np.diff(at) == np.diff(block.bounds)
    if same.all():
        return block.count(data != block.buf) == 0
    return np.array([x and bool((data[s:e] == block.buf[p:q]).all()) for x, s, e, p, q in zip(same.tolist(), at[:-1].tolist(), at[1:].tolist(), block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)], bool)


DIGEST = schema_of("doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")


def encode_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per row: code points, ids, byte ids, digest of the ids (int32, little-endian), and whether decoding gives the text back.

    A null text counts as an empty one here.
    """
    shared = shared_table(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        is_byte = np.zeros(len(enc.t.scores), bool)
        is_byte[enc.t.byte_ids] = True
        for b in batches:
            for block in K.blocks(b.column(1), TEXT_BYTES):
                ids, bounds = enc.encode(block)
                back, at = enc.decode(ids, bounds)
                same = same_rows(block, back, at)
                raw = ids.astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(block.first, block.n), pa.array(block.count(K.LEADS[block.buf])), pa.array(np.diff(bounds)), pa.array(K.per_row(is_byte[ids], bounds)),
                    pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string()), pa.array(same),
                ], names=DIGEST.names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGEST)



def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
