"""Units from any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_table(df: DataFrame, idx: str | Column, name: str | Column, body: str | Column, filename: str | Column) -> DataFrame:
    """units(idx, name, body, filename); null names, bodies and filenames become empty."""
    text = lambda c: F.coalesce(_column(c).cast("string"), F.lit(""))
    return df.select(_column(idx).cast("long").alias("idx"), text(name).alias("name"), text(body).alias("body"), text(filename).alias("filename"))
