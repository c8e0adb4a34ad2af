import math
import random

import numpy as np
from pyspark.sql import functions as F

from echoframe.functions import winnow
from echoframe.functions.normalize import tokens
from echoframe.operators import semantic as S
from echoframe.operators.fingerprints import similar_pairs


def frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "idx long, vector array<float>")


def plain(a, b):
    if len(a or ()) != len(b or ()) or not a:
        return 0.0
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return (a @ b / n + 1) / 2 * 100 if n else 0.0


def test_cosine_facts(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0, 0.0], [1.0, 0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(S.cosine("a", "b")).collect()] == [100, 0, 50, 0, 0, 0]


def test_stats_pairs_and_outliers_match_all_pairs(spark):
    r = random.Random(3)
    base = [r.gauss(0, 1) for _ in range(6)]
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(40)] + [[x + r.gauss(0, 0.01) for x in base] for _ in range(3)] + [[0.0] * 6, [1.0, 2.0], [], None]
    df = frame(spark, vectors)
    sims = {(i, j): plain(vectors[i], vectors[j]) for i in range(len(vectors)) for j in range(i + 1, len(vectors))}
    n, mean, std = S.pair_stats(df).first()
    want = np.array(list(sims.values()))
    assert n == len(sims) and math.isclose(mean, want.mean(), rel_tol=1e-9) and math.isclose(std, want.std(), rel_tol=1e-9)
    got = {(x.idx1, x.idx2): x.similarity for x in S.cosine_pairs(df, rows=7).collect()}
    assert got.keys() == sims.keys() and all(abs(got[k] - sims[k]) < 1e-9 for k in sims)
    z = {k for k, v in sims.items() if (v - want.mean()) / want.std() >= 1.5}
    assert {(x.idx1, x.idx2) for x in S.outliers(df, 1.5, rows=9).collect()} == z and z


def test_equal_similarities_have_no_outliers(spark):
    df = frame(spark, [[1.0, 0.0]] * 4)
    assert S.outliers(df).count() == 0 and S.pair_stats(df).first().stddev == 0
    assert S.pair_stats(frame(spark, [])).first().n_pairs == 0


def test_nearest(spark, monkeypatch):
    r = random.Random(5)
    vectors = [[r.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    df = frame(spark, vectors)
    monkeypatch.setattr(S, "QUERY_BYTES", 100)  # several blocks
    got = {(x.query, x["rank"]): x.idx for x in S.nearest(df.where("idx < 3"), df, 5).collect()}
    for q in range(3):
        order = sorted(range(30), key=lambda i: (-plain(vectors[q], vectors[i]), i))[:5]
        assert [got[q, k] for k in range(1, 6)] == order
    assert S.nearest(df.where("idx < 2"), df, None).count() == 60


def test_fingerprints(spark):
    def plain_prints(h, w):
        return sorted({min(h)} if 0 < len(h) < w else {min(h[i : i + w]) for i in range(len(h) - w + 1)})

    texts = ["", "a b c", "a b c d", "a b c d e f", "int x = y + z ; x = x + 1 ; return x ;" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", "t", tokens(F.col("t")).alias("toks"), F.transform(winnow.kgrams(tokens(F.col("t"))), lambda g: F.xxhash64(g)).alias("h"), winnow.fingerprints(tokens(F.col("t"))).alias("f")).collect():
        assert len(r.h) == max(0, len(r.toks) - 3)
        assert r.f == (plain_prints(r.h, 4) if r.h else [])


def test_fingerprint_similarity(spark):
    df = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3])], "a array<long>, b array<long>")
    assert [round(r[0], 4) for r in df.select(winnow.similarity(F.col("a"), F.col("b"))).collect()] == [100, 0, 33.3333]
    u = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "q r s t u v")], "idx long, body string")
    assert [(r.idx1, r.idx2, r.similarity) for r in similar_pairs(u).collect()] == [(1, 2, 100.0)]
