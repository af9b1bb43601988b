"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash. Pass two shuffles each bucket with
Fisher-Yates and writes it. The buckets, one after the other, are a random order of all rows; shard s of n holds the s-th
n-th of that order, so shards differ by one row at most (law ``rows``), and a row's slot is its place in its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.staging import free_name, map_arrow, new_folder, row_ids, stage

SHARDS, SEED = 16, 20240501
#: Bytes of text in a bucket, which is shuffled in a task's memory, and in a partition, which holds whole buckets.
BUCKET_BYTES, PARTITION_BYTES = 16 << 20, 512 << 20


def _places(counts: DataFrame) -> DataFrame:
    """(bucket, first): the place of each bucket's first row. Sums go by groups of 1024 buckets, then over the groups."""
    counts = counts.withColumn("_g", F.floor(F.col("bucket") / 1024))
    groups = counts.groupBy("_g").agg(F.sum("n").alias("n")).selectExpr("_g", "sum(n) over (order by _g) - n as before")
    inner = counts.selectExpr("bucket", "_g", "sum(n) over (partition by _g order by bucket) - n as within")
    return inner.join(groups, "_g").selectExpr("bucket", "before + within as first")


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, str, str]:
    """Write ``docs`` in shards; returns the folder, and the names of the columns of the shard and of the slot.

    The files lie below <shard>=<s> and have the columns of ``docs`` and the slot. The two are called shard and slot, with
    underscores before them where ``docs`` has such columns. ``docs``: text, doc_id, and any other columns. Null texts and
    repeated rows are kept as they are: a row's key is made of its doc_id, and rows that repeat or lack one are numbered
    and written first (``row_ids``), so copies spread too and a task that runs again makes the same keys. An empty table
    gives an empty folder.
    """
    spark = docs.sparkSession
    shard_name, slot_name = free_name(docs.columns, "shard"), free_name(docs.columns, "slot")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total, rows = docs.agg(F.sum(size.cast("long")), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    named, row, _ = row_ids(docs)
    # the row's own columns are in a struct, where they can't clash
    scattered = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.lit(seed), F.col(row)).alias("key"))
    scattered = scattered.withColumn("bucket", F.pmod("key", F.lit(buckets)))

    def one(parts: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        order = np.random.default_rng([seed, bucket]).permutation(len(table))  # Fisher-Yates
        out = table.take(pa.array(order)).append_column("rank", pa.array(np.arange(len(table), dtype=np.int64)))
        yield from out.combine_chunks().to_batches(max_chunksize=2048)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket and, so that the order of arrival doesn't matter, by key; one bucket is held at a time."""
        held, bucket = [], None
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and own[a] != bucket:
                    yield from one(held, bucket)
                    held = []
                bucket = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from one(held, bucket)

    places = stage(_places(scattered.groupBy("bucket").agg(F.count("*").alias("n"))), "bucket-places")
    partitions = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // PARTITION_BYTES))
    dealt = scattered.repartition(partitions, "bucket").join(places.withColumnRenamed("bucket", "at"), F.col("bucket") == F.col("at")).drop("at")
    dealt = dealt.sortWithinPartitions("bucket", "key")
    mixed = map_arrow(dealt, shuffle, T.StructType([*dealt.schema.fields, T.StructField("rank", T.LongType())])).withColumn("place", F.expr("first + rank"))
    # shard s begins at place ceil(s * rows / shards)
    placed = mixed.withColumn("shard", F.expr(f"cast(place * {shards} div {max(rows, 1)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"place - (shard * {rows}L + {shards - 1}) div {shards}"))
    path = new_folder(spark, "shards")
    placed.select("doc.*", F.col("slot").alias(slot_name), F.col("shard").alias(shard_name)).write.partitionBy(shard_name).parquet(path)
    return path, shard_name, slot_name


def sharded(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, read back from the written shards."""
    path, shard, slot = external_shuffle(docs, **settings)
    schema = T.StructType([*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.sparkSession.read.schema(schema).parquet(path).select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
