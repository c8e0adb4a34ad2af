"""Exact duplicates: units with equal normalised bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.normalize import normalize_code

PAIR_COLUMNS = ["idx1", "name1", "file1", "idx2", "name2", "file2", "similarity", "zscore", "kind"]


def distinct_units(f1: Column, n1: Column, f2: Column, n2: Column) -> Column:
    """Not the same name in the same file: overloads are never paired."""
    return ~((f1 == f2) & (n1 == n2))


def exact_groups(units: DataFrame) -> DataFrame:
    """One row for each group of equal normalised bodies: its first unit and its size. Partial counts meet, so a large group is no hot spot."""
    return units.groupBy(normalize_code(F.col("body")).alias("norm")).agg(F.min("idx").alias("first_idx"), F.count("*").alias("n_units")).where("n_units > 1")


def exact_members(units: DataFrame) -> DataFrame:
    """(idx, name, filename, first_idx) of the units in groups: the linear form of all pairs."""
    return units.withColumn("norm", normalize_code(F.col("body"))).join(exact_groups(units).select("norm", "first_idx"), "norm").select("idx", "name", "filename", "first_idx")


def exact_pairs(units: DataFrame) -> DataFrame:
    """All pairs of exact duplicates, but those with the same name in the same file. Bodies stay behind: pairs are joined on the group's number."""
    m = exact_members(units)
    a = m.select(F.col("idx").alias("idx1"), F.col("name").alias("name1"), F.col("filename").alias("file1"), "first_idx")
    b = m.select(F.col("idx").alias("idx2"), F.col("name").alias("name2"), F.col("filename").alias("file2"), F.col("first_idx").alias("g"))
    on = (F.col("first_idx") == F.col("g")) & (F.col("idx1") < F.col("idx2")) & distinct_units(F.col("file1"), F.col("name1"), F.col("file2"), F.col("name2"))
    return a.join(b, on).select("idx1", "name1", "file1", "idx2", "name2", "file2", F.lit(100.0).alias("similarity"), F.lit(0.0).alias("zscore"), F.lit("exact").alias("kind"))


def paired(members: DataFrame) -> DataFrame:
    """(idx) of the rows of exact_members() that an exact pair names: those of groups with two names or files. No pair is made."""
    place = F.struct("filename", "name")
    groups = members.groupBy("first_idx").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi")
    return members.join(groups.select("first_idx"), "first_idx", "left_semi").select("idx")


def exact_counts(members: DataFrame) -> DataFrame:
    """(filename, n): numbers of exact pairs within each file, from the sizes of the groups of exact_members()."""
    sizes = members.groupBy("first_idx", "filename", "name").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("first_idx", "filename").agg(F.expr("(sum(n) * sum(n) - sum(n * n)) DIV 2").alias("n"))
    return groups.groupBy("filename").agg(F.sum("n").alias("n"))


def unmatched(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """The units that no pair names: only these go on to the near pass."""
    members = pairs.select(F.col("idx1").alias("idx")).unionByName(pairs.select(F.col("idx2").alias("idx"))).distinct()
    return units.join(members, "idx", "left_anti")
