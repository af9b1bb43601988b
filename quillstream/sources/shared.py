"""Tables written between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that are broadcast; more are joined by sorting both sides.
BROADCAST_ROWS = 1_000_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, removed when the driver's JVM ends; in local mode without it a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again; it outlives lost executors, and its size is known."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(rows: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast up to BROADCAST_ROWS rows and for a merge join beyond."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """A table as it is read, dealt out evenly where it has fewer partitions than the cluster has cores.

    For steps that cost much for each byte read, over tables of one or a few small files; a large table has partitions
    enough and isn't moved. By a ``key`` of different values rows are dealt one by one; without one Spark first sorts each
    partition, and a task holds it whole.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def tasks(table: DataFrame, rows: int) -> int:
    """Partitions for a shuffle that deals a stored table's rows: as many as the session's, more where one would get over ``rows``.

    Parquet counts its rows without reading them, so a task's memory stays the same however large the table.
    """
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))
