"""Substring dedup: recurring passages found by sharded Aho-Corasick automata.

Words are compared unchanged, in windows of 13. Steps:

1. Seeds. Of every window the least-hashed 6-gram is its seed, so equal windows have
   equal seeds; seeds of two rows at least recur. Only counts are shuffled. Of rows with
   equal texts only the first (least doc_id) goes on: windows of the others all start in it, too.
2. Candidates. A bitmap of the recurring seeds, of checked size, is broadcast and picks the
   windows that may recur; beyond its bound the seeds are joined back to their documents.
3. Confirmation. Candidate windows are counted by hash; those of several documents
   recur, and their first document is known. Runs of windows that are first in one
   document are its recurring passages; they hold every recurring window once.
4. Automata. Passages are dealt to shards by their first document; each shard compiles
   one automaton of the passages' 7-word blocks (any 13 words of a passage hold one)
   over numbers of words, and streams the documents that have a window of the shard through it. A hit is
   extended along its passage, word by word; 13 words or more in common are an occurrence.
   Shards with many documents are split by document.
5. Words in occurrences are removed.

Defined results
---------------
* A null text has no words. Texts of fewer than 13 words lose nothing.
* Rows with the same doc_id don't remove one another's words. A row with a null doc_id neither loses words nor counts as earlier.
* Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .bitmaps import BITMAP_BYTES, bitmap_of, fits, in_bitmap
from .frames import discard, schema_of, written

WINDOW = 13
SEED = 6
BLOCK = 7  # (WINDOW + 1) // 2: an aligned block lies in any window
#: Recurring windows in one automaton, about; documents that one task streams through it, about.
SHARD_WINDOWS = 250_000
SHARD_DOCS = 4_000
#: Items that a step of the search in one document makes at a time, about.
AT_ONCE = 1 << 18
#: Bytes of text that are cut into words at a time; hashing takes 40 bytes of memory for each.
TEXT_BYTES = 1 << 18
#: Greatest size of the broadcast list of later copies; beyond it they are joined away.
COPIES_BYTES = 64 << 20


class Words:
    """Words of a block of rows; windows and their seeds."""

    def __init__(self, block: K.Block):
        self.block = block
        self.starts, self.ends, self.bounds = block.segments(K.NOT_SPACE)
        self.hashes = K.byte_hash(block.buf, self.starts, self.ends)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return K.windows(self.hashes, self.bounds, WINDOW)

    def seeds(self, at: np.ndarray) -> np.ndarray:
        """The seed of the window at each place."""
        if not len(at):
            return np.zeros(0, np.uint64)
        n = len(self.hashes) - SEED + 1
        grams = K.span_hash(self.hashes, np.arange(n), np.arange(n) + SEED)
        out = grams[at]
        for j in range(1, WINDOW - SEED + 1):
            out = np.minimum(out, grams[at + j])
        return K.mix(out)


def _distinct(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of equal (row, value)."""
    if not len(row):
        return np.zeros(0, np.int64)
    by = np.lexsort((value, row))
    r, v = row[by], value[by]
    return by[np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])]


SEEDS = schema_of("doc_id long, row_key long, seed long")


def seeds_of(docs: DataFrame, with_row: bool, is_later: Callable) -> DataFrame:
    """Distinct seeds of each row of docs (doc_id, row_key, text) that is no later copy."""
    out = SEEDS if with_row else schema_of("seed long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(2), TEXT_BYTES):
                w = Words(block)
                at, _ = w.windows()
                row = K.rows_of(w.bounds)[at]
                at = at[~is_later(b, block)[row]]
                seed, row = w.seeds(at), K.rows_of(w.bounds)[at]
                first = _distinct(row, seed)
                cols = [pa.array(seed[first].view(np.int64))]
                if with_row:
                    part = b.slice(block.first, block.n).take(pa.array(row[first]))
                    cols = [part.column(0), part.column(1), *cols]
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return docs.mapInArrow(run, out)


def digest_rows(block: K.Block, w: Words, removed: np.ndarray) -> list[str]:
    """sha256 of each row's kept words, joined by one space."""
    rows = K.rows_of(w.bounds)
    kept = np.flatnonzero(~removed)
    size = w.ends[kept] - w.starts[kept] + 1
    data = np.insert(block.buf, len(block.buf), 32) if len(block.buf) else np.full(1, 32, np.uint8)
    src = K.gather(data, w.starts[kept], size)
    at = np.concatenate([[0], np.cumsum(size)])
    src[at[1:] - 1] = 32
    ends = np.searchsorted(rows[kept], np.arange(block.n + 1))
    return [hashlib.sha256(src[at[s] : max(at[s], at[e] - 1)]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


STAGED = schema_of("doc_id long, row_key long, text string, n_words long, n_removed long, kept_sha256 string")


def stage(docs: DataFrame, is_needed: Callable, is_later: Callable) -> DataFrame:
    """Rows of documents with a recurring window keep their text; the others are finished: nothing is removed, or all, from later copies of a text with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(2), TEXT_BYTES):
                w = Words(block)
                n = np.diff(w.bounds)
                later = is_later(b, block) & (n >= WINDOW)
                some = is_needed(b, block) & ~is_later(b, block) & (n >= WINDOW)
                sha = digest_rows(block, w, later[K.rows_of(w.bounds)])
                part = b.slice(block.first, block.n)
                text = part.column(2).take(pa.array(np.arange(block.n), mask=~some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, pa.array(n), pa.array(np.where(later, n, 0)), pa.array([None if s else x for s, x in zip(some.tolist(), sha, strict=True)], pa.string())], names=STAGED.names)

    return docs.mapInArrow(run, STAGED)


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key) of rows whose text an earlier document has, whole: keys of 96 bits and a length. No text is shuffled."""
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row_key", F.hash("text").alias("k2"), F.octet_length("text").alias("size"))
    key = ["row_key", "k2", "size"]
    first = written(keyed.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    out = written(keyed.join(first, key).where("doc_id > first").select("doc_id", "row_key").distinct(), "copies")
    discard(first)
    return out


def _flag(column: str) -> Callable:
    """A test of rows by a boolean column that was joined to them."""
    return lambda b, block: np.asarray(b.column(b.schema.get_field_index(column)).slice(block.first, block.n).fill_null(False))


def marked_later(docs: DataFrame, later: DataFrame, most: int) -> tuple[DataFrame, Callable]:
    """docs, and a test for later copies: by a broadcast list of checked size, or else by a joined column."""
    if 16 * later.count() > most:
        key = later.select(F.col("doc_id").alias("_ld"), F.col("row_key").alias("_lr"), F.lit(True).alias("later"))
        return docs.join(key, (F.col("doc_id") == F.col("_ld")) & (F.col("row_key") == F.col("_lr")), "left").drop("_ld", "_lr"), _flag("later")
    pairs = later.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.rec.fromarrays([np.asarray(pairs.column(0)), np.asarray(pairs.column(1))], names="d,r")))

    def is_later(b: pa.RecordBatch, block: K.Block) -> np.ndarray:
        known = shared.value
        if not len(known):
            return np.zeros(block.n, bool)
        ids = b.column(0).slice(block.first, block.n)
        mine = np.rec.fromarrays([np.asarray(ids.fill_null(0)), np.asarray(b.column(1).slice(block.first, block.n))], names="d,r")
        place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        return (known[place] == mine) & np.asarray(ids.is_valid())

    return docs, is_later


def marked_needed(docs: DataFrame, needed: DataFrame, most: int) -> tuple[DataFrame, Callable]:
    """docs, and a test for documents in needed (doc_id): by a broadcast bitmap (it may also let others through), or else by a joined column."""
    n = needed.count()
    if not fits(n, most):
        key = needed.select(F.col("doc_id").alias("_nd"), F.lit(True).alias("needed"))
        return docs.join(key, F.col("doc_id") == F.col("_nd"), "left").drop("_nd"), _flag("needed")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed.select(F.xxhash64("doc_id").alias("h")), n))
    hashed = docs.withColumn("_hash", F.xxhash64("doc_id"))

    def is_needed(b: pa.RecordBatch, block: K.Block) -> np.ndarray:
        ids = b.column(0).slice(block.first, block.n)
        h = np.asarray(b.column(b.schema.get_field_index("_hash")).slice(block.first, block.n)).view(np.uint64)
        return in_bitmap(shared.value, h) & np.asarray(ids.is_valid())

    return hashed, is_needed


WINDOWS = schema_of("doc_id long, window long")


def windows_of(rows: DataFrame, is_recurring: Callable, is_later: Callable) -> DataFrame:
    """Distinct candidate windows of each row that has a doc_id and is no later copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = is_recurring()
        for b in batches:
            for block in K.blocks(b.column(2), TEXT_BYTES):
                w = Words(block)
                at, h = w.windows()
                row = K.rows_of(w.bounds)[at]
                able = np.asarray(b.column(0).slice(block.first, block.n).is_valid()) & ~is_later(b, block)
                at, h, row = (x[able[row]] for x in (at, h, row))
                hit = np.flatnonzero(test(b, block, row, w.seeds(at)))
                hit = hit[_distinct(row[hit], h[hit])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, block.n).take(pa.array(row[hit])), pa.array(h[hit].view(np.int64))], names=WINDOWS.names)

    return rows.mapInArrow(run, WINDOWS)


PASSAGES = schema_of("first long, words string")


def passages_of(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, windows: recurring windows that are first in the row's document): runs of their first places, as words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(1), TEXT_BYTES):
                w = Words(block)
                at, h = w.windows()
                row = K.rows_of(w.bounds)[at]
                first = np.sort(_distinct(row, h))
                lists = b.column(2).slice(block.first, block.n)
                mine = K.mix(np.asarray(lists.flatten()).view(np.uint64) + np.repeat(np.arange(block.n), np.asarray(lists.value_lengths().fill_null(0))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keep = first[np.isin(K.mix(h[first] + row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), mine)]
                at, row = at[keep], row[keep]
                if len(at):
                    head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
                    s, e = at[head], at[np.append(np.flatnonzero(head)[1:] - 1, len(at) - 1)] + WINDOW
                    words = [" ".join(x.decode() for x in bytes(block.buf[w.starts[i] : w.ends[j - 1]]).split()) for i, j in zip(s.tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, block.n).take(pa.array(row[head])), pa.array(words, pa.string())], names=PASSAGES.names)

    return rows.mapInArrow(run, PASSAGES)


class Shard:
    """An automaton of the blocks of passages, over numbers of words.

    Words are numbered by their bytes, and 0 is any other word. A number is fed to the automaton as two digits of
    disjoint ranges, so that no node has many children and blocks only start where a word does.
    """

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.sizes, self.firsts = array("i"), array("q"), array("q")
        self.automaton = None

    def add(self, first: int, text: bytes) -> None:
        """One more passage, as words joined by one space; its first document."""
        numbers = self.numbers
        words = [numbers.setdefault(x, len(numbers) + 1) for x in text.split()]
        self.ids.extend(words)
        self.sizes.append(len(words))
        self.firsts.append(first)

    def compile(self) -> None:
        import ahocorasick

        self.ids, self.sizes = np.array(self.ids, np.int32), np.array(self.sizes, np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.known, rank = np.unique(np.array(self.firsts, np.int64), return_inverse=True)
        per = self.sizes // BLOCK
        passage = np.repeat(np.arange(len(per)), per)
        shift = BLOCK * (np.arange(len(passage)) - np.repeat(np.cumsum(per) - per, per))
        blocks = self.ids[(self.offsets[passage] + shift)[:, None] + np.arange(BLOCK)].reshape(-1, BLOCK)
        blocks, code = np.unique(blocks, axis=0, return_inverse=True)
        # places of blocks, in order of block and first document
        key = code.reshape(-1) * max(1, len(self.known)) + rank[passage]
        by = np.argsort(key, kind="stable")
        self.keys, self.passage, self.shift = key[by], passage[by], shift[by]
        self.bounds = np.searchsorted(self.keys, np.arange(len(blocks) + 1) * max(1, len(self.known)))
        self.base = math.isqrt(len(self.numbers)) + 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k in range(len(blocks)):
            self.automaton.add_word(self.digits(blocks[k]), k)
        if len(blocks):
            self.automaton.make_automaton()

    def digits(self, ids: np.ndarray) -> tuple[int, ...]:
        return tuple(np.stack([ids // self.base, self.base + ids % self.base], 1).reshape(-1).tolist())

    def lines(self, word: np.ndarray, code: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Distinct passages, each with where it would begin in the text, that hits (block `code` at `word`) lie on: passage << 32 | 2**31 + begin. Some hits at a time."""
        rank = np.searchsorted(self.known, firsts)
        rank = rank[self.known[np.minimum(rank, len(self.known) - 1)] == firsts]
        if not len(rank):
            return np.zeros(0, np.int64)
        found = [np.zeros(0, np.int64)]
        codes, which = np.unique(code, return_inverse=True)
        by = np.argsort(which, kind="stable")
        word, ends = word[by], np.cumsum(np.bincount(which))
        step = max(1, AT_ONCE // len(rank))
        for u in range(0, len(codes), step):
            some = codes[u : u + step]
            # places of a block: all of them, or those of each first document, whichever are fewer
            few = self.bounds[some + 1] - self.bounds[some] <= len(rank)
            keys = (some[~few, None] * len(self.known) + rank).reshape(-1)
            lo = np.concatenate([self.bounds[some[few]], np.searchsorted(self.keys, keys)])
            hi = np.concatenate([self.bounds[some[few] + 1], np.searchsorted(self.keys, keys, "right")])
            place = K.gather(np.arange(len(self.keys)), lo, hi - lo)
            place = place[np.isin(self.keys[place] % len(self.known), rank)]
            of = np.searchsorted(some, self.keys[place] // len(self.known)) + u
            times = ends[of] - np.where(of > 0, ends[of - 1], 0)
            # each place with every hit of its block
            total = np.cumsum(times)
            for a in range(0, int(total[-1]) if len(total) else 0, AT_ONCE):
                pair = np.arange(a, min(a + AT_ONCE, int(total[-1])))
                k = np.searchsorted(total, pair, "right")
                begin = word[ends[of[k]] - (total[k] - pair)] - self.shift[place[k]]
                found.append(np.unique((self.passage[place[k]] << 32) + (begin + (1 << 31))))
                if len(found) > 16:
                    found = [np.unique(np.concatenate(found))]
        return np.unique(np.concatenate(found))

    def spans(self, text: bytes, firsts: np.ndarray) -> tuple[list[int], list[int]]:
        """Word ranges of text, apart from each other, that are covered by occurrences of passages that are first in one of `firsts`."""
        get = self.numbers.get
        ids = np.array([get(x, 0) for x in text.split()], np.int32)
        n = len(ids)
        if n < WINDOW or not len(self.automaton):
            return [], []
        hits = np.array(list(self.automaton.iter(self.digits(ids))), np.int64).reshape(-1, 2)
        lines = self.lines(hits[:, 0] // 2 - BLOCK + 1, hits[:, 1], firsts)
        p, begin = lines >> 32, (lines & 0xFFFFFFFF) - (1 << 31)
        a, b = np.maximum(begin, 0), np.minimum(begin + self.sizes[p], n)
        p, begin, a, b = (x[b - a >= WINDOW] for x in (p, begin, a, b))
        d = np.zeros(n + 1, np.int64)
        total = np.cumsum(b - a)
        i = 0
        while i < len(p):
            j = max(i + 1, int(np.searchsorted(total, total[i] - (b[i] - a[i]) + AT_ONCE, "right")))
            size = b[i:j] - a[i:j]
            equal = K.gather(ids, a[i:j], size) == K.gather(self.ids, self.offsets[p[i:j]] + a[i:j] - begin[i:j], size)
            # runs of equal words end with their line
            tails = np.cumsum(size)
            edges = np.flatnonzero(np.diff(np.insert(equal, np.concatenate([[0], tails]), False)))
            s, e = edges[::2], edges[1::2]
            long = e - s >= WINDOW
            s, e = s[long], e[long]
            line = np.searchsorted(tails + np.arange(len(tails)), s, "right")
            back = a[i:j][line] - (tails - size)[line] - line
            np.add.at(d, s + back, 1)
            np.add.at(d, e + back, -1)
            i = j
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(d[:n]) > 0, [False]])))
        return edges[::2].tolist(), edges[1::2].tolist()


SPANS = schema_of("doc_id long, row_key long, lo long[], hi long[]")


def locate(dealt: DataFrame) -> DataFrame:
    """dealt (shard, salt, kind, doc_id, row_key, text, firsts), sorted within partitions: passages (kind 0, doc_id their first document) before documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for b in batches:
            out: list[tuple] = []
            keys = zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
            texts, firsts = b.column(5), b.column(6)
            # texts one by one: a batch of them as strings takes more memory than the automaton
            for i, (of, salt, kind, doc, row) in enumerate(keys):
                if (of, salt) != at:
                    at, shard = (of, salt), None  # the old automaton goes before the next one comes
                    shard = Shard()
                text = texts[i].as_buffer().to_pybytes()
                if kind == 0:
                    shard.add(doc, text)
                    continue
                if shard.automaton is None:
                    shard.compile()
                lo, hi = shard.spans(text, np.asarray(firsts[i].values))
                if lo:
                    out.append((doc, row, lo, hi))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.field("element", pa.int64(), False)) if k > 1 else pa.int64()) for k, c in enumerate(cols)], names=SPANS.names)

    return dealt.mapInArrow(run, SPANS)


OUT = schema_of("doc_id long, n_words long, n_removed long, kept_sha256 string")


def _finish(rows: DataFrame, with_text: bool) -> DataFrame:
    """rows (doc_id, text, lo, hi): the digest of what is left, or the text itself."""
    schema = schema_of("doc_id long, row_key long, n_removed long, text string") if with_text else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(2), TEXT_BYTES):
                w = Words(block)
                d = np.zeros(len(w.starts) + 1, np.int64)
                for k, step in ((3, 1), (4, -1)):
                    lists = b.column(k).slice(block.first, block.n)
                    sizes = np.asarray(lists.value_lengths().fill_null(0))
                    np.add.at(d, np.asarray(lists.flatten()).astype(np.int64) + np.repeat(w.bounds[:-1], sizes), step)
                gone = np.cumsum(d[:-1]) > 0
                part = b.slice(block.first, block.n)
                if with_text:
                    words = np.flatnonzero(~gone)
                    rows_ = K.rows_of(w.bounds)[words]
                    texts = [""] * block.n
                    for r in np.unique(rows_).tolist():
                        mine = words[rows_ == r]
                        texts[r] = b" ".join(block.buf[s:e].tobytes() for s, e in zip(w.starts[mine].tolist(), w.ends[mine].tolist(), strict=True)).decode()
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(K.per_row(gone, w.bounds)), pa.array(texts, pa.string())], names=schema.names)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.bounds)), pa.array(K.per_row(gone, w.bounds)), pa.array(digest_rows(block, w, gone), pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bitmap_bytes: int = BITMAP_BYTES, shard_windows: int = SHARD_WINDOWS, shard_docs: int = SHARD_DOCS, copies_bytes: int = COPIES_BYTES, with_text: bool = False) -> DataFrame:
    """One row per row of df: words, removed words, and the digest of the kept words.

    with_text: only the rows with removed words, as (doc_id, row_key, n_removed, text), row_key being xxhash64 of the old text.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).alias("text"))
    copies = later_copies(docs)
    source, is_later = marked_later(docs, copies, copies_bytes)
    known = source.where("doc_id IS NOT NULL")
    recurring = written(seeds_of(known, False, is_later).groupBy("seed").count().where("count > 1").select("seed"), "seeds")
    n = recurring.count()
    if fits(n, bitmap_bytes):
        shared = spark.sparkContext.broadcast(bitmap_of(recurring, n))

        def is_recurring():
            bitmap = shared.value
            return lambda b, block, row, seed: in_bitmap(bitmap, seed)

        probe = known
    else:
        own = seeds_of(known, True, is_later).join(recurring, "seed").groupBy("doc_id", "row_key").agg(F.collect_set("seed").alias("seeds"))
        probe = known.join(own, ["doc_id", "row_key"])

        def is_recurring():
            def test(b, block, row, seed):
                lists = b.column(b.schema.get_field_index("seeds")).slice(block.first, block.n)
                owner = np.repeat(np.arange(block.n), np.asarray(lists.value_lengths().fill_null(0))).astype(np.uint64)
                c = np.uint64(0x9E3779B97F4A7C15)
                return np.isin(K.mix(seed + row.astype(np.uint64) * c), K.mix(np.asarray(lists.flatten()).astype(np.int64).view(np.uint64) + owner * c))

            return test

        order = ["doc_id", "row_key", "text"]
        probe = probe.select(*order, *(c for c in probe.columns if c not in order))
    windows = windows_of(probe, is_recurring, is_later)
    found = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    found = written(found, "windows")
    shards = max(1, -(-found.count() // shard_windows))
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).cast("long")
    routes = windows.join(found, "window").where("doc_id > first").select("doc_id", "first").distinct().withColumn("shard", shard)
    routes = written(routes.groupBy("doc_id", "shard").agg(F.collect_list("first").alias("firsts")), "routes")
    needed = written(routes.select("doc_id").unionByName(found.select(F.col("first").alias("doc_id"))).distinct(), "needed")
    staged = written(stage(*marked_needed(source, needed, bitmap_bytes), is_later), "staged")
    able = staged.where("text IS NOT NULL").select("doc_id", "row_key", "text")
    # dealt by doc_id once, for dropping repeated rows and for the join
    once = able.repartition("doc_id").dropDuplicates(["doc_id", "row_key"])
    mine = found.groupBy("first").agg(F.collect_list("window").alias("windows"))
    passages = written(passages_of(once.join(mine, F.col("doc_id") == F.col("first")).select("doc_id", "text", "windows")).withColumn("shard", shard), "passages")
    salts = routes.groupBy("shard").count().select("shard", F.ceil(F.col("count") / shard_docs).cast("int").alias("salts")).where("salts > 1")
    salts = written(salts, "salts")
    of_docs = routes.join(salts, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "doc_id", "firsts")
    streamed = once.join(of_docs, "doc_id").select("shard", "salt", F.lit(1).alias("kind"), "doc_id", "row_key", "text", "firsts")
    of_passages = passages.join(salts, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("first").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), F.col("words").alias("text"), F.lit(None).cast("array<bigint>").alias("firsts"))
    dealt = of_passages.unionByName(streamed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = written(locate(dealt).groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi")), "spans")
    discard(copies, recurring, found, routes, needed, passages, salts)
    cut = able.join(spans, ["doc_id", "row_key"], "left").select("doc_id", "row_key", "text", "lo", "hi")
    done = staged.where("text IS NULL")
    if with_text:
        gone = done.where("n_removed > 0").select("doc_id", "row_key", "n_removed", F.lit("").alias("text"))
        return _finish(cut.where("lo IS NOT NULL").dropDuplicates(["doc_id", "row_key"]), True).unionByName(gone.distinct())
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(_finish(cut, False))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
