"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this process has written and not discarded, with their sessions.
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local one, which only a local master can use."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        at = d.get()
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: tables between steps need a folder that driver and executors share")
        at = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written to a table in the shared folder and read from there: they survive lost executors and are computed once.

    The table stays until discard() or clear().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/echoframe-{what}-{uuid.uuid4().hex}"
    _tables[path] = spark
    df.write.parquet(path)
    # shuffle files of the step that has ended go when the driver's JVM finds them unused, which may take long if nobody asks
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_table"] = path
    return out


def _delete(path: str) -> None:
    spark = _tables.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and that nothing reads any more."""
    for t in tables:
        if (path := t.__dict__.get("_table")) in _tables:
            _delete(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this session. For long sessions, once the results that were returned are stored elsewhere."""
    for path in [p for p, s in _tables.items() if s is spark]:
        _delete(path)


def ranked(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """df with its position, from 1, in the given order: sorted by ranges, and counted per range, so no task sees all rows.

    Only one count for each range reaches the driver.
    """
    pid, own = "_range", "_place"
    cut = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(pid, F.spark_partition_id()).withColumn(own, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    before, total = [], 0
    for r in sorted(cut.groupBy(pid).count().collect()):
        before.append((r[pid], total))
        total += r["count"]
    offset = F.create_map(*(F.lit(x) for pair in before for x in pair))[F.col(pid)] if before else F.lit(0)
    return cut.withColumn(rank, (offset + F.col(own) + 1).cast("long")).drop(pid, own)
