"""Tables that streams merge into: keyed rows exactly once, and whole partitions replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a keyed table; a batch writes those anew that it touches.
BUCKETS = 64


class KeyedTable:
    """A row for each key, the one with the greatest ``order``, in Parquet files below ``path``.

    Keys are dealt over buckets. Batch n writes the buckets that it touches below data/batch=n, and then, as one small
    table below state/batch=n, which batch has each bucket. The state counts once its job is committed, so readers see all of a
    batch or nothing. A batch that comes again finds its state and does nothing; one that broke off starts again from the state
    before it. So each batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _states(self) -> list[int]:
        """Ids of the batches whose state is committed."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = lambda p: files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root) if s.isDirectory() and done(s.getPath()))

    def _buckets(self, batch: int) -> dict[int, int]:
        """Bucket to the batch that wrote it: ``buckets`` rows at most."""
        return {r.bucket: r.written_by for r in self.spark.read.schema("bucket int, written_by bigint").parquet(f"{self.path}/state/batch={batch}").collect()}

    def _rows(self, places: dict[int, int], schema: str | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={b}/_bucket={k}" for k, b in sorted(places.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        rank: list[Column | str] = [*self.order, F.to_json(F.struct(*rest)).alias("_tie")]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_r"))
        return best.select(*self.keys, "_r.*").select(*rows.columns)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge ``batch`` into the table; of rows that tie in ``order`` the greater as JSON stays, so that their own order doesn't count."""
        done = self._states()
        if batch_id in done:
            return
        before = [b for b in done if b < batch_id]
        places = self._buckets(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self._last(batch)
        touched = {r._bucket for r in new.select(bucket.alias("_bucket")).distinct().collect()}  # ``buckets`` rows at most
        old = self._rows({k: b for k, b in places.items() if k in touched})
        merged = new if old is None else self._last(old.unionByName(new, allowMissingColumns=True))
        if touched:
            merged.withColumn("_bucket", bucket).repartition(F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/batch={batch_id}")
        now = places | dict.fromkeys(touched, batch_id)
        state = self.spark.createDataFrame(sorted(now.items()), "bucket int, written_by bigint").coalesce(1)
        state.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")

    def read(self) -> DataFrame | None:
        """The rows after the last batch that is committed; None before the first row."""
        done = self._states()
        return self._rows(self._buckets(done[-1])) if done else None


def merging(path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is merged into the keyed table below ``path``."""
    return lambda batch, n: KeyedTable(batch.sparkSession, path, keys, order, buckets).apply(batch, n)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` below ``path`` by the columns ``by``; partitions that they have are replaced whole, others stay. The same rows
    once more change nothing. ``rows`` must not read what it replaces."""
    rows.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
