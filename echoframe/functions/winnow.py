"""Winnowing: fingerprints of token k-grams, and their similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K, W = 4, 4


def md5_hash(c: Column) -> Column:
    """60 bits of md5: a hash that other engines compute too."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def kgrams(tokens: Column, k: int = K) -> Column:
    """Concatenations of k neighbouring tokens."""
    none = F.array().cast("array<string>")
    return _bind(tokens, lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), ""))).otherwise(none))


def fingerprints(tokens: Column, k: int = K, w: int = W, hash_of: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Distinct minima of w neighbouring k-gram hashes, sorted; fewer hashes give their least one, fewer tokens none."""
    none = F.array().cast("array<bigint>")

    def minima(h: Column) -> Column:
        slid = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (w - 1), F.lit(1))), lambda i: F.array_min(F.slice(h, i, w)))
        return F.when(F.size(h) == 0, none).otherwise(F.array_sort(F.array_distinct(slid)))

    return _bind(F.transform(kgrams(tokens, k), lambda g: hash_of(g)), minima)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity in percent; two empty sets are equal, one empty set is unlike any other."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 100.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) * 100)
