"""Winnowing as a join: pairs of units that share fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions import winnow
from echoframe.functions.normalize import tokens


def fingerprint_rows(units: DataFrame, k: int = winnow.K, w: int = winnow.W, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(idx, fingerprint), one row for each distinct fingerprint."""
    return units.select("idx", F.explode(winnow.fingerprints(tokens(F.col("body")), k, w, hash_of)).alias("fingerprint"))


def similar_pairs(units: DataFrame, least: float = 0.0, k: int = winnow.K, w: int = winnow.W, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(idx1, idx2, similarity) of the pairs that share a fingerprint; counts of shared fingerprints meet, never the sets."""
    rows = fingerprint_rows(units, k, w, hash_of)
    sizes = rows.groupBy("idx").agg(F.count("*").alias("n"))
    a, b = rows.select(F.col("idx").alias("idx1"), "fingerprint"), rows.select(F.col("idx").alias("idx2"), "fingerprint")
    shared = a.join(b, "fingerprint").where("idx1 < idx2").groupBy("idx1", "idx2").agg(F.count("*").alias("both"))
    out = shared.join(sizes.select(F.col("idx").alias("idx1"), F.col("n").alias("n1")), "idx1").join(sizes.select(F.col("idx").alias("idx2"), F.col("n").alias("n2")), "idx2")
    return out.select("idx1", "idx2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")) * 100).alias("similarity")).where(F.col("similarity") >= least)
