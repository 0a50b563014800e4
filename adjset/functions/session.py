"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset a temporary folder of this machine, if Spark runs in one
    process on it (tests). On a cluster an unset folder is an error, since each machine would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="adjset-"))
    path = f"{base.rstrip('/')}/adjset-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own[path] = path
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when executors are lost. The table stays
    until the driver ends or :func:`clear` is called."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables made so far: for long sessions, when no result made of them is still to be read."""
    _remove(spark, shared_dir(spark))


def partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with."""
    n = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(n or spark.conf.get("spark.sql.shuffle.partitions"))
