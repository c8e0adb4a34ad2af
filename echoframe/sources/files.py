"""Source trees as a Python data source.

Spark's own readers drop names that begin with a dot or an underscore, so the tree is
listed on the driver and read in batches of files by the executors; the tree must lie at
the same path on all of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = (".cpp", ".h")
BATCH_BYTES = 32 << 20


def ignored(path: str, ignore: list[str]) -> bool:
    """Whether any ignore text occurs anywhere in the path."""
    return any(x in path for x in ignore)


def scan(root: str, ignore: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> list[str]:
    """Paths of regular files with one of the extensions below root, sorted; folders that can't be read are passed over."""
    if not os.path.isdir(root):
        return []
    found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if os.path.splitext(n)[1] in extensions]
    return sorted(p for p in found if os.path.isfile(p) and not ignored(p, ignore or []))


class Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = scan(options["path"], [x for x in options.get("ignore", "").split("\n") if x], tuple(options.get("extensions", ",".join(EXTENSIONS)).split(",")))
        self.keep_returns = options.get("keepreturns", options.get("keepReturns", "true")).lower() == "true"

    def partitions(self) -> list[Batch]:
        out, held = [Batch([])], 0
        for p in self.paths:
            try:
                size = os.path.getsize(p)
            except OSError:
                continue
            if out[-1].paths and held + size > BATCH_BYTES:
                out.append(Batch([]))
                held = 0
            out[-1].paths.append(p)
            held += size
        return out

    def read(self, partition: Batch) -> Iterator[tuple[str, str]]:
        for p in partition.paths:
            try:
                with open(p, "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            text = raw.decode("utf-8", "replace")
            yield p, text if self.keep_returns else text.replace("\r", "")


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root): (path, content). Options: ignore (texts, one a line), extensions (comma-joined), keepReturns."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, keep_returns: bool = True) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("ignore", "\n".join(ignore or [])).option("keepReturns", str(keep_returns).lower()).load(root)
