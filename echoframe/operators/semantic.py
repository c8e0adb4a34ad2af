"""Semantic outliers: pairs whose cosine similarity lies far above the mean of all pairs.

The mean and deviation over all pairs need no pairs: with unit vectors u, the sum of their
dot products follows from the sum of u, and the sum of squares from the sum of the outer
products of u; one linear pass gives both. Only the search for outliers meets pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z_CUTOFF = 2.5
BLOCK_ROWS = 2_000
#: Bytes of query vectors in one broadcast block of a search.
QUERY_BYTES = 32 << 20


def scaled(dots: np.ndarray) -> np.ndarray:
    """Cosine from -1..1 to 0..100."""
    return (dots + 1) / 2 * 100


def unit_rows(vectors: list) -> np.ndarray:
    """Unit vectors in double; a zero vector stays zero."""
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.sqrt((m * m).sum(1, keepdims=True)) if m.size else np.ones((len(m), 1))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def cosine(a: str, b: str) -> Column:
    """Similarity of two array columns in percent; 0 for unequal lengths, empty or zero vectors."""
    x, y = F.transform(F.col(a), lambda v: v.cast("double")), F.transform(F.col(b), lambda v: v.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.when(norm == 0, 0.0).otherwise((dot(x, y) / F.nullif(norm, F.lit(0.0)) + 1) / 2 * 100))


def _vectors(df: DataFrame, idx: str, vector: str) -> DataFrame:
    return df.select(F.col(idx).cast("long").alias("idx"), F.col(vector).alias("v")).where("idx IS NOT NULL")


def pair_stats(df: DataFrame, idx: str = "idx", vector: str = "vector") -> DataFrame:
    """One row: n_pairs, mean and population deviation of the similarities of all pairs i < j.

    Vectors of another length than their partner, empty or zero ones have similarity 0 with it.
    """
    v = _vectors(df, idx, vector)
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("live", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("outer", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            rows = b.column(1).to_pylist()
            sizes = np.array([len(r or ()) for r in rows])
            for d in np.unique(sizes):
                u = unit_rows([rows[i] for i in np.flatnonzero(sizes == d)]) if d else np.zeros((int((sizes == 0).sum()), 0))
                live = int((np.abs(u).sum(1) > 0).sum()) if d else 0
                part = [len(u), live, u.sum(0), (u.T @ u).reshape(-1)]
                acc[int(d)] = [x + y for x, y in zip(acc[int(d)], part, strict=True)] if int(d) in acc else part
        yield pa.RecordBatch.from_pylist([{"dim": d, "n": n, "live": k, "total": t.tolist(), "outer": o.tolist()} for d, (n, k, t, o) in acc.items()], schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("live", pa.int64()), ("total", pa.list_(pa.float64())), ("outer", pa.list_(pa.float64()))]))

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        live, total, outer = int(pdf.live.sum()), sum(np.asarray(x) for x in pdf.total), sum(np.asarray(x) for x in pdf.outer)
        # sums over unordered pairs of live vectors, whose squared norms are 1
        dots = (float(total @ total) - live) / 2 if live else 0.0
        squares = (float(outer @ outer) - live) / 2 if live else 0.0
        pairs = live * (live - 1) / 2
        s1 = (dots + pairs) * 50
        s2 = (squares + 2 * dots + pairs) * 2500
        return pd.DataFrame([[int(pdf.n.sum()), s1, s2]], columns=["n", "s1", "s2"])

    by_dim = v.mapInArrow(partial, schema).groupBy("dim").applyInPandas(whole, "n long, s1 double, s2 double")
    all_ = by_dim.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s1"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum("s2"), F.lit(0.0)).alias("s2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.when(pairs > 0, F.col("s1") / F.nullif(pairs, F.lit(0.0))).otherwise(0.0)
    var = F.when(pairs > 0, F.greatest(F.col("s2") / F.nullif(pairs, F.lit(0.0)) - mean * mean, F.lit(0.0))).otherwise(0.0)
    return all_.select(pairs.cast("long").alias("n_pairs"), mean.alias("mean"), F.sqrt(var).alias("stddev"))


def _block_pairs(v: DataFrame, least: float | None, rows: int) -> DataFrame:
    """(idx1, idx2, similarity) of pairs i < j with a similarity of at least `least`; pairs of blocks are dealt to tasks."""
    n = v.count()
    blocks = max(1, -(-n // rows))
    base = v.withColumn("blk", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"))
    left = base.select(F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("j"), "idx", "v")
    right = base.select(F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"), F.col("idx").alias("idx_"), F.col("v").alias("v_"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            own = a.i.iloc[0] == a.j.iloc[0]
            ia, ib = a.idx.to_numpy(), b.idx_.to_numpy()
            da, db = a.v.map(lambda x: len(x) if x is not None else 0).to_numpy(), b.v_.map(lambda x: len(x) if x is not None else 0).to_numpy()
            sims = np.zeros((len(a), len(b)))
            for d in np.intersect1d(da, db):
                if d:
                    p, q = np.flatnonzero(da == d), np.flatnonzero(db == d)
                    x, y = unit_rows(a.v.iloc[p].tolist()), unit_rows(b.v_.iloc[q].tolist())
                    live = (np.abs(x).sum(1) > 0)[:, None] & (np.abs(y).sum(1) > 0)[None, :]
                    sims[np.ix_(p, q)] = np.where(live, scaled(x @ y.T), 0.0)
            keep = (ia[:, None] < ib[None, :]) if own else np.ones_like(sims, bool)
            if least is not None:
                keep &= sims >= least
            x, y = np.nonzero(keep)
            out.append(pd.DataFrame({"idx1": np.minimum(ia[x], ib[y]), "idx2": np.maximum(ia[x], ib[y]), "similarity": sims[x, y]}))
        return pd.concat(out) if out else pd.DataFrame({"idx1": pd.Series(dtype="int64"), "idx2": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, "idx1 long, idx2 long, similarity double")


def cosine_pairs(df: DataFrame, idx: str = "idx", vector: str = "vector", least: float | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs i < j with their similarity, or those from `least` on."""
    return _block_pairs(_vectors(df, idx, vector), least, rows)


def outliers(df: DataFrame, cutoff: float = Z_CUTOFF, idx: str = "idx", vector: str = "vector", rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs whose z-score reaches the cutoff, which the statistics turn into a least similarity: no pair below it leaves its task."""
    n, mean, std = pair_stats(df, idx, vector).first()
    if std == 0:
        least = None if cutoff <= 0 else float("inf")
    else:
        least = mean + cutoff * std - 1e-9
    pairs = cosine_pairs(df, idx, vector, least, rows)
    z = (F.col("similarity") - mean) / std if std else F.lit(0.0)
    return pairs.withColumn("zscore", z).where(F.col("zscore") >= cutoff)


def nearest(queries: DataFrame, candidates: DataFrame, k: int | None = 10, idx: str = "idx", vector: str = "vector") -> DataFrame:
    """(query, idx, similarity, rank): the candidates most similar to each query, ties by idx; all of them where k is None.

    Queries are the stated, small side; they are broadcast in blocks of a checked size, and each
    batch of candidates keeps its k best for a query before anything is shuffled.
    """
    spark = queries.sparkSession
    blocks, held, size = [[]], 0, 0
    for q, v in _vectors(queries, idx, vector).toLocalIterator():
        size = 8 * len(v or ()) + 64
        if held + size > QUERY_BYTES:
            blocks.append([])
            held = 0
        held += size
        blocks[-1].append((q, list(v or ())))
    out = None
    schema = "query long, idx long, similarity double"
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                dims = pdf.v.map(lambda x: len(x) if x is not None else 0).to_numpy()
                ids = pdf.idx.to_numpy()
                by_dim = {int(d): (np.flatnonzero(dims == d), unit_rows(pdf.v[dims == d].tolist())) for d in np.unique(dims) if d}
                parts = []
                for q, v in shared.value:
                    s = np.zeros(len(pdf))
                    if len(v) in by_dim:
                        at, u = by_dim[len(v)]
                        x = unit_rows([v])[0]
                        s[at] = np.where((np.abs(u).sum(1) > 0) & (np.abs(x).sum() > 0), scaled(u @ x), 0.0)
                    best = np.lexsort((ids, -s))[: k if k else len(s)]
                    parts.append(pd.DataFrame({"query": q, "idx": ids[best], "similarity": s[best]}))
                if parts:
                    yield pd.concat(parts)

        found = _vectors(candidates, idx, vector).mapInPandas(score, schema)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "idx")).cast("long"))
    return ranked.where(F.col("rank") <= k) if k else ranked
