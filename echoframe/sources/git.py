"""Files that git tracks."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _git(root: str, *args: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    except OSError:
        return None
    return done.stdout if done.returncode == 0 else None


def is_repo(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or b"").strip() == b"true"


def tracked(root: str) -> list[str]:
    """Tracked paths, relative to root."""
    return [os.fsdecode(x) for x in (_git(root, "ls-files", "-z") or b"").split(b"\0") if x]


def only_tracked(files: DataFrame, root: str) -> DataFrame:
    """The files(path, ...) that git tracks; all of them outside a repository."""
    if not is_repo(root):
        return files
    names = files.sparkSession.createDataFrame([(os.path.join(root, p),) for p in tracked(root)], "tracked string")
    return files.join(names, F.col("path") == F.col("tracked"), "left_semi")
