"""Tables between the steps of a plan: what several branches read is computed once, and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_CLEANUP, _ARROW = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that a write sends to a Python worker, or one row if that is longer.
ARROW_BYTES = str(4 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine (tests); on a cluster that is an error, since each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="matchloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def option(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session option that holds inside the block, and is what it was after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage. The write's shuffle files go when it ends; the table goes with ``dropped``, or when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/matchloom-{name}-{uuid.uuid4().hex}"
    with option(spark, _CLEANUP, "true"), option(spark, _ARROW, ARROW_BYTES):
        df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def united(*tables: DataFrame) -> DataFrame:
    """The rows of staged tables as one table, which ``dropped`` deletes as a whole."""
    out = reduce(DataFrame.unionByName, tables)
    out._staged = [df._staged for df in tables]
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        for path in [df._staged] if isinstance(df._staged, str) else df._staged:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
