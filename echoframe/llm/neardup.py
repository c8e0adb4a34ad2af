"""MinHash near-dedup with circulant permutations, exact confirmation and components.

Signature: shingles fall on 2^32 places by a first permutation (sigma); a second one (pi),
shifted circularly by k, gives coordinate k: the least pi over the document's places.
Two permutations so give all coordinates; they are bijections of 32 bits that are computed, not
tables, so that sets of millions of shingles do not fill the places. Bands of coordinates are
bucket keys.

Equal shingle sets are one class before any banding. In each bucket the class with the
least id is the leader, and every member meets the leader only, so a bucket of n classes
makes n - 1 pairs. Links are confirmed on the full sets. Buckets whose members are then in
several components meet again: members outside the bucket's main component against the
members of other components. These pairs must pass a finer sketch, one bit of each of 4,096
more coordinates of the same two permutations, within the join itself; it rules out nearly
all pairs that are merely alike. The others are confirmed on the full sets, so every two
classes that share a bucket are in one component, or compared, or ruled out by the sketch.

With 50 bands of 6 coordinates a pair with a similarity of 0.8 shares no bucket with a
probability of 3e-7, one with 0.9 with 3e-17. The sketch's limit lies five standard deviations
below what a similarity of 0.8 gives (another 3e-7, for pairs outside one component only).

Defined results
---------------
* Words: A-Z lower-cased, runs of bytes other than space and \\x09-\\x0D. The set: distinct k-word shingles; fewer words: the whole sequence as one.
* No words, or a null text: an empty set, linked with nothing. A null doc_id: linked with nothing, its component is null, and it is kept.
* Rows with the same doc_id and text give equal result rows. Rows with one doc_id and different texts are one document in several versions: a link of one version links the document, and dedup() drops or keeps its rows together.
* Sets are compared as sets of 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .components import connect
from .frames import discard, fresh, schema_of, written

BANDS, ROWS = 50, 6
PERCENT = 80
#: Coordinates of the sketch, one bit each.
SKETCH = 4096
#: Bytes of text whose coordinates are computed together: their places stay in a core's cache.
SET_BYTES = 1 << 19
#: Bytes of text whose pairs are compared together.
PAIR_BYTES = 4 << 20


class Places:
    """sigma and pi, as bijections of 32 bits: xor-shifts and odd multipliers."""

    def __init__(self, shingles: np.ndarray, bounds: np.ndarray):
        self.starts = bounds[:-1][np.diff(bounds) > 0]
        at = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        at *= np.uint32(0x85EBCA6B)
        at ^= at >> np.uint32(13)
        at *= np.uint32(0xC2B2AE35)
        self.at = at
        self.a, self.b = np.empty_like(at), np.empty_like(at)

    def coordinate(self, k: int) -> np.ndarray:
        """Coordinate k of all rows with shingles: the least pi, shifted by k, over the row's places."""
        a, b = self.a, self.b
        np.add(self.at, np.uint32(k), out=a)
        np.right_shift(a, np.uint32(16), out=b)
        np.bitwise_xor(a, b, out=a)
        np.multiply(a, np.uint32(0x7FEB352D), out=a)
        np.right_shift(a, np.uint32(15), out=b)
        np.bitwise_xor(a, b, out=a)
        np.multiply(a, np.uint32(0x846CA68B), out=a)
        return np.minimum.reduceat(a, self.starts)


def shingle_sets(block: K.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and each row's bounds."""
    buf = K.LOWER[block.buf]
    starts, ends, words = block.segments(K.NOT_SPACE, buf)
    h = K.byte_hash(buf, starts, ends)
    at, shingle = K.windows(h, words, k)
    rows = K.rows_of(words)[at]
    few = np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < k))
    if len(few):
        shingle = np.concatenate([shingle, K.span_hash(h, words[few], words[few + 1])])
        rows = np.concatenate([rows, few])
    by = np.lexsort((shingle, rows))
    shingle, rows = shingle[by], rows[by]
    if len(rows):
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (rows[1:] != rows[:-1])])
        shingle, rows = shingle[new], rows[new]
    return shingle, np.searchsorted(rows, np.arange(block.n + 1))


def band_keys(shingles: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys, one line for each band, of the rows with shingles."""
    places = Places(shingles, bounds)
    n = len(places.starts)
    out = np.zeros((bands, n), np.uint64)
    for band in range(bands if n else 0):
        key = np.full(n, np.uint64(band + 1))
        for r in range(rows):
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + places.coordinate(band * rows + r).astype(np.uint64))
        out[band] = key
    return out


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCH bits for each row with shingles, as lines of 64-bit integers: a bit of each coordinate."""
    places = Places(shingles, bounds)
    out = np.zeros((len(places.starts), SKETCH // 64), np.uint64)
    for k in range(SKETCH if len(out) else 0):
        out[:, k // 64] |= (places.coordinate(k) & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
    return out.view(np.int64)


def sketch_limit(percent: int) -> int:
    """Bits in which two sets of this similarity differ at most, five deviations allowed for."""
    agree = (1 + percent / 100) / 2
    return int(SKETCH * (1 - agree) + 5 * (SKETCH * agree * (1 - agree)) ** 0.5) + 1


SKETCHED = schema_of("doc_id long, sketch long[]")


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, sketch) of texts (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(1), SET_BYTES):
                s, bounds = shingle_sets(block, k)
                lines = sketches(s, bounds)
                full = np.flatnonzero(np.diff(bounds) > 0)
                at = np.arange(len(lines) + 1, dtype=np.int32) * (SKETCH // 64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(block.first, block.n).take(pa.array(full)), pa.ListArray.from_arrays(pa.array(at), pa.array(lines.reshape(-1)))], names=SKETCHED.names)

    return texts.mapInArrow(run, SKETCHED)


SIGNED = schema_of("doc_id long, n_shingles long, k1 long, k2 long, bands long[]")


def sign(df: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """df (doc_id, text): set sizes, two 64-bit keys of the whole set, and bucket keys (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in K.blocks(b.column(1), SET_BYTES):
                s, bounds = shingle_sets(block, k)
                size = np.diff(bounds)
                keys = band_keys(s, bounds, bands, rows)
                acc1, acc2 = (np.concatenate([[np.uint64(0)], np.cumsum(K.mix(s ^ np.uint64(c)))]) for c in (0x1234567, 0x89ABCDEF01))
                full = (size > 0).astype(np.int64) * bands
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(block.first, block.n), pa.array(size), *(pa.array((a[bounds[1:]] - a[bounds[:-1]]).view(np.int64)) for a in (acc1, acc2)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32)), pa.array(keys.T.reshape(-1).view(np.int64))),
                ], names=SIGNED.names)

    return df.mapInArrow(run, SIGNED)


PAIR = schema_of("a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets have the similarity. texts: (doc_id, text)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def sets(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        coded = col.dictionary_encode()
        out: list[np.ndarray] = []
        for block in K.blocks(coded.dictionary):
            s, bounds = shingle_sets(block, k)
            out += np.split(s, bounds[1:-1])
        return np.asarray(coded.indices), out

    def alike(b: pa.RecordBatch) -> pa.RecordBatch:
        (i, left), (j, right) = sets(b.column(2)), sets(b.column(3))
        ok = np.zeros(len(i), bool)
        for n, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = left[p], right[q]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[n] = 100 * common >= percent * (len(x) + len(y) - common)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=PAIR.names).filter(pa.array(ok))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum([0, *np.diff(K.bytes_of(b.column(2))[1]) + np.diff(K.bytes_of(b.column(3))[1])])
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(size, size[first] + PAIR_BYTES, "right")) - 1)
                yield alike(b.slice(first, last - first))
                first = last

    return both.mapInArrow(run, PAIR)


def components(df: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(sign(docs, k, bands, rows), "signed")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(able.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = able.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    banded = reps.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").drop("last"), "buckets")
    members = written(banded.join(buckets, "band"), "members")  # of buckets with two classes at least
    sizes = members.select(F.col("doc_id").alias("leader"), F.col("n").alias("m")).distinct()
    fits = F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m)")
    pairs = written(members.where("doc_id != leader").select("leader", "doc_id", "n").distinct().join(sizes, "leader").where(fits).select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    ids = members.select("doc_id").distinct()
    texts = written(docs.join(ids, "doc_id", "left_semi").distinct(), "texts")
    links = written(confirm(pairs, texts, k, percent), "links")
    linked = connect(links)

    # buckets whose members are in several components
    placed = members.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    placed = written(placed, "placed")
    discard(buckets, members)
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    inside = written(placed.join(mixed, "band", "left_semi"), "mixed")
    main = inside.groupBy("band", "c").agg(F.count("*").alias("size")).groupBy("band").agg(F.max_by("c", F.struct("size", "c")).alias("main"))
    told = written(inside.join(main, "band").select("band", "doc_id", "n", "c", (F.col("c") == F.col("main")).alias("in_main")), "told")
    discard(placed, inside)
    # sketches are kept once a document; of its bucket keys 32 bits each tell which bucket of a pair is the first
    brief = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands")
    finer = written(sketched(texts.join(told.select("doc_id").distinct(), "doc_id", "left_semi"), k).join(reps.select("doc_id", brief), "doc_id"), "sketches")
    full = told.join(finer, "doc_id")
    out = full.where("NOT in_main").select("band", F.col("doc_id").alias("x"), F.col("n").alias("m"), F.col("c").alias("cx"), F.col("sketch").alias("xs"), F.col("bands").alias("xb"))
    differ = " + ".join(f"bit_count(sketch[{i}] ^ xs[{i}])" for i in range(SKETCH // 64))
    # a pair is met in the first bucket that it shares
    here = "element_at(filter(zip_with(bands, xb, (p, q) -> if(p = q, p, NULL)), v -> v IS NOT NULL), 1) = cast(shiftright(band, 32) AS int)"
    meet = full.join(out, "band").where(F.expr("c != cx AND (in_main OR doc_id < x)") & fits & F.expr(f"{differ} <= {sketch_limit(percent)} AND {here}"))
    meet = meet.select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()
    meet = written(meet.join(pairs, ["a", "b"], "left_anti"), "pairs")
    discard(told, finer)
    more = written(confirm(meet, texts, k, percent), "links")
    if not more.isEmpty():
        old, linked = linked, connect(links.unionByName(more))
        discard(old)

    final = written(classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component")), "final")
    discard(classes, pairs, texts, links, meet, more, linked)
    own = signed.select("doc_id", "n_shingles", "k1", "k2").join(final, ["k1", "k2", "n_shingles"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return own.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(df: DataFrame, k: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without near copies: of each component, the rows with the least doc_id. All columns stay.

    Rows with a null doc_id stay. Equal rows of the least doc_id all stay.
    """
    (name,) = fresh(df, "_gone")
    gone = components(df, k, percent, doc_id=doc_id, text=text).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, df[doc_id].cast("long") == gone[name], "left_anti")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
