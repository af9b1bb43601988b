"""Running sums along ordered rows of a key, whatever share of the rows one key holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.bytehash import U64
from quillstream.llm.staging import map_arrow, stage

Terms = Callable[[pa.RecordBatch], dict[str, np.ndarray]]


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, in signed longs, where a plain sum would raise."""
    low = a.bitwiseAND(0xFFFFFFFF) + b.bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _scan(key: str, terms: Terms) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        held: dict[str, np.uint64] = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                keys = batch.column(key).to_numpy()
                new = np.append(at == 0 or keys[0] != last, keys[1:] != keys[:-1])
                run, starts = np.cumsum(new), np.flatnonzero(new)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                for name, term in terms(batch).items():
                    term = term.astype(U64)
                    total = np.cumsum(term, dtype=U64)
                    before = np.append(U64(0) - held.get(name, U64(0)), (total - term)[starts])
                    total = total - before[run]
                    held[name] = total[-1]
                    columns |= {name: pa.array(total.view(np.int64)), f"{name}_before": pa.array((total - term).view(np.int64))}
                columns |= {"_part": pa.array(np.full(n, part, np.int32)), "_at": pa.array(np.arange(at, at + n))}
                at, last = at + n, keys[-1]
                yield pa.record_batch(list(columns.values()), list(columns))

    return rows


def _carried(key: str, names: list[str]) -> Callable:
    """From the last row of each partition, in order, to what a key has already when a partition begins."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, [0] * len(names)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is not None:
                    out.append((row["_part"], now, *sums))
                own = [row[n] for n in names]
                sums = [(a + b + 2**63) % 2**64 - 2**63 for a, b in zip(sums, own, strict=True)] if row[key] == now else own
                now = row[key]
            if out:
                yield pa.record_batch([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], ["_part", "_key", *[f"_{n}" for n in names]])

    return rows


def running_sums(rows: DataFrame, key: str, order: list[Column], terms: Terms, names: list[str]) -> DataFrame:
    """``rows`` with, for each name, the sum modulo 2**64 of the terms of its key up to the row, and, as ``<name>_before``, up
    to the row before.

    ``key``: a long column without nulls. ``order`` orders the rows of all keys, the key first. ``terms`` gives each name's
    terms of a batch. Rows are dealt out by ranges of the whole order, so that a key of any size spreads over partitions; a
    partition sums by itself, and what a key brings from the partitions before comes from one row per partition, which is
    the bound of what is broadcast. Range bounds hold for the one job that writes the sums.
    """
    added = [T.StructField(n + end, T.LongType()) for n in names for end in ("", "_before")]
    schema = T.StructType([*rows.schema.fields, *added, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    scanned = stage(map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), _scan(key, terms), schema), "scanned")
    last = scanned.groupBy("_part").agg(F.max_by(F.struct(key, *names), "_at").alias("l")).select("_part", "l.*")
    carried = map_arrow(last.coalesce(1).sortWithinPartitions("_part"), _carried(key, names), f"_part int, _key bigint, {', '.join(f'_{n} bigint' for n in names)}")
    carried = stage(carried, "carried").select(F.col("_part").alias("_p"), "_key", *[f"_{n}" for n in names])
    both = scanned.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & (F.col(key) == F.col("_key")), "left")
    sums = {n + end: wrapping_add(F.col(n + end), F.coalesce(F.col(f"_{n}"), F.lit(0))) for n in names for end in ("", "_before")}
    out = both.select(*rows.columns, *[c.alias(n) for n, c in sums.items()])
    out._staged_at = scanned._staged_at  # for drop()
    return out
