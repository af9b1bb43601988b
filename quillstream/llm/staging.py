"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SENT: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where it is unset, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage, survives lost executors, and gives later joins a known size.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more, so that a job's tables don't add up on disk."""
    for table in tables:
        path = None if table is None else table.__dict__.get("_staged_at")
        if path:
            files, target = _file_system(table.sparkSession, path)
            files.delete(target, True)


#: Ids (8 bytes each) that are broadcast; more are joined by sorting both sides.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A staged table of ids, marked for a broadcast where it has BROADCAST_IDS rows at most, and for a merge join beyond."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_ids(docs: DataFrame) -> tuple[DataFrame, str, DataFrame | None]:
    """``docs`` with a column that tells its rows apart, that column's name, and the rows whose value isn't their doc_id.

    The value is the doc_id where one row has it. Rows with a null doc_id, and all but one of those that repeat one, get
    values greater than all ids, without gaps, so that they fit whatever room the ids leave; where there is no room above
    the greatest id, smaller than all. The third result has (row, doc_id) of these rows and is None where there are none.
    Such rows are written, so that their values hold. Columns of any name come through.
    """
    row, n, again_, first_, part, before = (free_name(docs.columns, c) for c in ("_row", "_n", "_again", "_first", "_p", "_before"))
    plain = docs.withColumn(row, F.col("doc_id").cast("long"))
    known = docs.agg(F.max("doc_id").cast("long").alias("top"), F.min("doc_id").cast("long").alias("bottom"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(again_)), "repeated-ids")
    repeats = not again.isEmpty()
    if not known.nulls and not repeats:
        drop(again)
        return plain, row, None
    odd = docs.where("doc_id is null")
    if repeats:
        odd = odd.unionByName(docs.join(again, F.col("doc_id") == F.col(again_), "left_semi"))
        plain = plain.join(again, F.col("doc_id") == F.col(again_), "left_anti")
    odd = stage(odd.withColumn(n, F.monotonically_increasing_id()), "odd-rows")
    # the number's high bits are the partition's, the low 33 the row's in it
    parts = odd.groupBy(F.shiftright(n, 33).alias(part)).agg(F.count("*").alias("_size"))
    parts = stage(parts.selectExpr(f"`{part}`", f"sum(_size) over (order by `{part}`) - _size as `{before}`"), "odd-parts")
    first = stage(odd.where("doc_id is not null").groupBy("doc_id").agg(F.min(n).alias(first_)).select(first_), "first-rows")
    place = F.col(before) + F.col(n).bitwiseAND((1 << 33) - 1)
    top, bottom = (0, 0) if known.top is None else (known.top, known.bottom)
    fresh = F.lit(top) + 1 + place if top + odd.count() < 2**63 else F.lit(bottom) - 1 - place
    odd = odd.join(F.broadcast(parts), F.shiftright(n, 33) == F.col(part)).join(first, F.col(n) == F.col(first_), "left")
    odd = odd.withColumn(row, F.when(F.col(first_).isNull(), fresh).otherwise(F.col("doc_id").cast("long")))
    names = stage(odd.where(F.col(first_).isNull()).select(F.col(row).alias("row"), "doc_id"), "odd-names")
    return plain.where("doc_id is not null").unionByName(odd.select(*docs.columns, row)), row, names


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package's modules sent to the executors, once per session."""
    context = df.sparkSession.sparkContext
    if _SENT.get("to") != context.applicationId:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="quillstream-")) / "quillstream-modules.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "quillstream").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))
        _SENT["to"] = context.applicationId
    return df.mapInArrow(function, schema)
