"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where none is set, a local session gets a folder of its own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def finished_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this block, Spark removes the shuffle files of each query as soon as it has ended."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


def stored(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends there, a lost executor costs no more than that, and its shuffle files go."""
    with finished_shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    for path in paths:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
