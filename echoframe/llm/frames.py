"""Small helpers over DataFrames: schemas without a session, and tables between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from echoframe.plans.storage import discard, shared_dir, written

__all__ = ["discard", "fresh", "schema_of", "shared_dir", "written"]

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def schema_of(text: str) -> T.StructType:
    """'name kind, name kind': kinds long, int, string, boolean, double, binary, and kind[] for arrays."""
    out = []
    for part in text.split(","):
        name, kind = part.split()
        out.append(T.StructField(name, T.ArrayType(_KINDS[kind[:-2]], False) if kind.endswith("[]") else _KINDS[kind]))
    return T.StructType(out)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has as a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
