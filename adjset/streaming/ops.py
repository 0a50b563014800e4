"""A stream of operations folded into stored graphs.

Every micro-batch folds its operations onto the edges as they are and writes the partitions that it touches (see
:mod:`adjset.sources.store`); ``seq`` orders operations within and across batches. Mass operations are kept beside the edges:
they meet the edges as they are, and the node states they lead to dominate explicit operations, those of later batches
included. Operations may come again or late: the merge by time and state is safe to repeat, a mass operation counts once by
its seq, and nothing expires, since removed edges are kept. Versions go on from the newest whatever the number of a batch
is, so a stream that starts again with a new checkpoint applies its operations to what is there. An operation that comes after later ones
meets stored edges as they are, with the node states as of its seq. Operations that can't be read go to a dead-letter folder,
from where they can be taken up again a limited number of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lattice as L
from ..model import HIGH, LOW, MEDIUM, OPS
from ..sources.store import GraphStore

#: How often an operation is taken up again before it is left for good, and the share of files per batch of each priority (fixed values).
RETRIES = 100
FILES = {HIGH: 32, MEDIUM: 12, LOW: 2}


def readable(ops: DataFrame):
    """Column condition: an operation that can be applied."""
    return F.col("seq").isNotNull() & F.col("graph_id").isNotNull() & F.col("source_id").isNotNull() & L.op_ordinal("op").isNotNull()


def stream_ops(ops: DataFrame, store: GraphStore, checkpoint: str, dead_letters: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; ``ops`` is a streaming DataFrame of operations (see :data:`adjset.model.OPS`)."""

    ops_columns = [c for c in ops.columns if c != "attempts"]

    def batch(df: DataFrame, number: int) -> None:
        ok = readable(df)
        # named by the version they were met at: batches of another checkpoint have the same numbers
        bad = df.filter(~ok).withColumn("attempts", (F.coalesce(F.col("attempts"), F.lit(0)) if "attempts" in df.columns else F.lit(0)) + 1)
        bad.write.mode("overwrite").json(f"{dead_letters}/batch={store.manifest()['version']}-{number}")
        store.apply(df.filter(ok).select(*ops_columns))

    w = ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_ops(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Operations from JSON files that arrive in a folder."""
    return spark.readStream.schema(OPS + ", attempts int").option("maxFilesPerTrigger", files_per_batch).json(folder)


def enqueue(ops: DataFrame, folder: str) -> None:
    """Operations put into the queue: files in a folder per priority, null being the highest."""
    ops.withColumn("queue", F.coalesce("priority", F.lit(HIGH))).write.mode("append").partitionBy("queue").json(folder)


def drain(spark: SparkSession, folder: str, store: GraphStore, checkpoint: str, dead_letters: str) -> None:
    """Everything in the queue, once: urgent operations first, in batches of as many files as their priority has a share."""
    for priority in (HIGH, MEDIUM, LOW):
        path = f"{folder}/queue={priority}"
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            stream_ops(read_ops(spark, path, FILES[priority]), store, f"{checkpoint}/{priority}", f"{dead_letters}/{priority}").awaitTermination()


def requeue(spark: SparkSession, dead_letters: str, folder: str, limit: int = RETRIES) -> DataFrame:
    """Dead letters put into the queue again, with the number of attempts so far; those that have had ``limit`` of them come
    back as a frame and are left where they are."""
    bad = spark.read.schema(OPS + ", attempts int").option("recursiveFileLookup", "true").json(dead_letters)
    enqueue(bad.filter(F.col("attempts") < limit), folder)
    return bad.filter(F.col("attempts") >= limit)
