"""Streams against their batch queries; sinks that see a batch twice."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream.operators.review import overlay
from quillstream.streaming import runs
from quillstream.streaming.sinks import KeyedTable, merging, replace_partitions

EVENTS = "run_id string, stage string, status string, message string, at timestamp"
START = datetime(2024, 5, 1, 8)


def run_events(seed, n=30):
    """Runs that complete, fail, stop or get events after their end; late ones and repeated ones among them."""
    rnd = random.Random(seed)
    rows = []
    for r in range(n):
        at = START + timedelta(minutes=rnd.randint(0, 40))
        upto = rnd.randint(1, len(runs.STAGES))
        for stage in runs.STAGES[:upto]:
            if rnd.random() < 0.85 or stage == "UPLOADED":
                rows.append((f"r{r}", stage, rnd.choice(["VERIFIED", "NEEDS_REVIEW"]) if stage == "COMPLETED" else None, None, at))
            at += timedelta(seconds=rnd.randint(1, 90))
        if rnd.random() < 0.3:
            rows.append((f"r{r}", "FAILED", None, "broken", at - timedelta(seconds=rnd.choice([0, 100]))))
        if rnd.random() < 0.2:
            rows.append((f"r{r}", rnd.choice(["GROUNDING", "FAILED"]), None, "after", at + timedelta(seconds=500)))
    rows += rnd.sample(rows, 20) + [("r1", "ODD", None, None, START), (None, "UPLOADED", None, None, START), ("r2", "INGESTION", None, None, None)]
    return rows


def by_force(rows, now=None, timeout=runs.TIMEOUT):
    out = {}
    for run in {r[0] for r in rows if r[0] and r[4] and r[1] in (*runs.STAGES, "FAILED")}:
        own = [r for r in rows if r[0] == run and r[4] and r[1] in (*runs.STAGES, "FAILED")]
        ends = sorted((r[4], r[1], r[2] or "", r[3] or "") for r in own if r[1] in ("COMPLETED", "FAILED"))
        first = {}
        for _, stage, _, _, at in sorted(own, key=lambda r: r[4]):
            if stage != "FAILED" and (not ends or at <= ends[0][0]):
                first.setdefault(stage, at)
        last = ends[0][0] if ends else max(r[4] for r in own)
        silent = not ends and now is not None and last + timedelta(seconds=timeout) < now
        stage = max(first, key=runs.RANK.get) if first else None
        status = ("FAILED" if ends[0][1] == "FAILED" else ends[0][2]) if ends else "FAILED" if silent else "QUEUED" if stage == "UPLOADED" else "PROCESSING"
        message = ends[0][3] if ends else f"No event for {timeout} seconds" if silent else ""
        started = min([*first.values(), *([ends[0][0]] if ends else [])])
        out[run] = (stage, status, message, started, last, None if status in ("QUEUED", "PROCESSING") else (last - started).total_seconds(), len(first))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_run_states_by_force(spark, seed):
    rows = run_events(seed)
    now = START + timedelta(minutes=60)
    us = int(spark.createDataFrame([(now,)], "t timestamp").select(F.unix_micros("t")).first()[0])
    for limit, micros in ((None, None), (now, us)):
        got = {r.run_id: tuple(r)[1:] for r in runs.run_states(spark.createDataFrame(rows, EVENTS), micros).collect()}
        assert got == by_force(rows, limit)


def test_stage_machine_as_a_stream(spark, tmp_path):
    """Events in three batches, out of order and repeated, end in the states of the batch query; a silent run fails by its timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in run_events(3, 12) if r[4]]
    random.Random(4).shuffle(rows)
    late = START + timedelta(hours=30)
    parts = [rows[0::2], rows[1::2] + rows[:5], [("late", "UPLOADED", None, None, late)], [("late", "INGESTION", None, None, late + timedelta(seconds=1))]]
    src = str(tmp_path / "in")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{src}/p{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    seen = {}

    def keep(batch, n):
        seen.update({r.run_id: tuple(r)[1:] for r in batch.collect()})

    q = runs.run_stream(stream, late="2 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "chk")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = by_force(rows)
    assert {k: v for k, v in seen.items() if k != "late"} == want
    # with a short watermark the open runs' timers expire once the late run moves it on
    seen.clear()
    q = runs.run_stream(stream, late="3 hours").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "chk2")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(300)
    timed = by_force(rows, late)
    assert {k: v for k, v in seen.items() if k != "late"} == timed and any(v[2].startswith("No event") for v in timed.values())


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_batch_counts_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["doc", "field"], ["at"], buckets=4)
    assert table.read() is None
    first = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (2, "a", "z", 1)], "doc int, field string, value string, at int")
    second = spark.createDataFrame([(1, "a", "old", 1), (2, "a", "w", 5), (3, "b", "v", 1), (3, "b", "u", 1)], first.schema)
    table.apply(first, 0)
    assert rows_of(table.read(), "doc", "value") == [(1, "y"), (2, "z")]
    table.apply(second, 1)
    want = [(1, "y"), (2, "w"), (3, "v")]
    assert rows_of(table.read(), "doc", "value") == want
    table.apply(second, 1)
    table.apply(first, 0)
    assert rows_of(table.read(), "doc", "value") == want
    # a batch that broke off before its state was written is made again from the state before it
    broken = spark.createDataFrame([(1, "a", "half", 9)], first.schema)
    broken.withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / "t/data/batch=2"))
    assert rows_of(table.read(), "doc", "value") == want
    table.apply(spark.createDataFrame([(1, "a", "new", 9)], first.schema), 2)
    assert rows_of(table.read(), "doc", "value") == [(1, "new"), (2, "w"), (3, "v")]
    table.apply(first.where("false"), 3)
    assert table.read().count() == 3


def test_corrections_as_a_stream_overlay_rows(spark, tmp_path):
    edits = spark.createDataFrame([(k % 5, "total", f"v{k}", k) for k in range(40)], "doc int, field string, value string, at int")
    edits.repartition(4).write.parquet(str(tmp_path / "edits"))
    path = str(tmp_path / "corrections")
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edits"))
    stream.writeStream.foreachBatch(merging(path, ["doc", "field"], ["at"], 3)).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start().awaitTermination(300)
    kept = KeyedTable(spark, path, ["doc", "field"], ["at"], 3).read()
    base = spark.createDataFrame([(d, "total", "old", 0.5, "rule") for d in range(7)], "doc int, field string, value string, confidence double, source string")
    want = overlay(base, edits.select("doc", "field", F.col("value"), "at"), ["doc", "field"], "value", "at")
    got = overlay(base, kept, ["doc", "field"], "value", "at")
    assert rows_of(got, "doc", "value", "source") == rows_of(want, "doc", "value", "source")


def test_partitions_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run int, value string")
    replace_partitions(one, path, ["run"])
    new = spark.createDataFrame([(1, "z"), (3, "y")], one.schema)
    for _ in range(2):
        replace_partitions(new, path, ["run"])
        assert rows_of(spark.read.parquet(path), "run", "value") == [(1, "z"), (2, "c"), (3, "y")]
