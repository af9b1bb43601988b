"""Runs as state machines: what stage each run has reached, from events that may come late, repeated or in any order.

The same rules as a batch query (``run_states``) and as a stream with typed state and timers (``run_stream``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Stages of a run in their order; FAILED ends a run at any of them.
STAGES = ("UPLOADED", "INGESTION", "CLASSIFYING", "SCHEMA_DISCOVERY", "EXTRACTING", "GROUNDING", "VALIDATING", "GENERATING_INSIGHTS", "COMPLETED")
RANK = {s: i for i, s in enumerate(STAGES)}
#: Seconds without an event after which an open run counts as failed.
TIMEOUT = 1800
SILENT = "No event for {} seconds"
_OUT = "run_id string, stage string, status string, message string, started_us bigint, last_us bigint, n_stages int"


def _as_times(rows: DataFrame) -> DataFrame:
    seconds = F.when(F.col("status").isin("QUEUED", "PROCESSING"), None).otherwise((F.col("last_us") - F.col("started_us")) / 1_000_000)
    return rows.select("run_id", "stage", "status", "message", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("last_us").alias("last_at"), F.round(seconds, 6).alias("seconds"), "n_stages")


def _known(events: DataFrame) -> DataFrame:
    """Events of known stages with ``us``, their time in microseconds."""
    return events.where(F.col("stage").isin(*STAGES, "FAILED") & F.col("at").isNotNull() & F.col("run_id").isNotNull()).withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))


def run_states(events: DataFrame, now_us: int | None = None, timeout: int = TIMEOUT) -> DataFrame:
    """run_id, stage, status, message, started_at, last_at, seconds, n_stages of each run in ``events`` (run_id, stage, status,
    message, at).

    The first COMPLETED or FAILED event ends a run; what comes after it in time doesn't count. The stage is the farthest
    one reached, FAILED keeps it. A completed run has its event's status, an open one is QUEUED or PROCESSING, or, where
    ``now_us`` is given and its last event is older than ``timeout`` seconds, FAILED. Events without run, time or known
    stage are passed over; repeated ones change nothing.
    """
    e = _known(events)
    ends = e.where("stage in ('COMPLETED', 'FAILED')").groupBy("run_id").agg(F.min(F.struct("us", "stage", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("message", F.lit("")).alias("message"))).alias("end"))
    ranked = e.where("stage <> 'FAILED'").groupBy("run_id", "stage").agg(F.min("us").alias("us"), F.max("us").alias("last"))
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[F.col("stage")]
    reached = ranked.groupBy("run_id").agg(F.collect_list(F.struct(rank.alias("rank"), "us", "last")).alias("r"))  # a row a stage
    both = reached.join(ends, "run_id", "full_outer")
    until = F.coalesce("end.us", F.lit(2**63 - 1))
    some = F.filter(F.coalesce("r", F.array().cast("array<struct<rank:int,us:bigint,last:bigint>>")), lambda x: x["us"] <= until)
    both = both.select("run_id", "end", "r", some.alias("s"))
    top = F.array_max(F.transform("s", lambda x: x["rank"]))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), top)
    last = F.coalesce("end.us", F.array_max(F.transform("r", lambda x: x["last"])))
    silent = (last + timeout * 1_000_000 < now_us) if now_us is not None else F.lit(False)
    status = F.when(F.col("end.stage") == "FAILED", "FAILED").when(F.col("end.stage") == "COMPLETED", F.col("end.status")).when(silent, "FAILED").when(top == 0, "QUEUED").otherwise("PROCESSING")
    message = F.when(F.col("end").isNotNull(), F.col("end.message")).when(silent, SILENT.format(timeout)).otherwise("")
    return _as_times(both.select("run_id", stage.alias("stage"), status.alias("status"), message.alias("message"), F.least(F.array_min(F.transform("s", lambda x: x["us"])), F.col("end.us")).alias("started_us"), last.alias("last_us"), F.size("s").alias("n_stages")))


class _Run(StatefulProcessor):
    """First and last time of each stage, and the event that ended the run; a timer for silence."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getMapState("reached", "stage string", "first bigint, last bigint")
        self.end = handle.getValueState("end", "us bigint, stage string, status string, message string")

    def _row(self, key: tuple, silent: bool = False) -> pd.DataFrame:
        end = self.end.get() if self.end.exists() else None
        all_ = {k[0]: v for k, v in self.reached.iterator()}
        until = end[0] if end else None
        some = {s: v[0] for s, v in all_.items() if until is None or v[0] <= until}
        stage = max(some, key=RANK.get) if some else None
        last = end[0] if end else max(v[1] for v in all_.values())
        if end:
            status, message = ("FAILED" if end[1] == "FAILED" else end[2]), end[3]
        elif silent:
            status, message = "FAILED", SILENT.format(self.timeout)
        else:
            status, message = ("QUEUED" if stage == STAGES[0] else "PROCESSING"), ""
        started = min([*some.values(), *([end[0]] if end else [])])
        return pd.DataFrame({"run_id": [key[0]], "stage": [stage], "status": [status], "message": [message], "started_us": [started], "last_us": [last], "n_stages": [len(some)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for stage, status, message, us in zip(frame["stage"], frame["status"], frame["message"], frame["us"], strict=True):
                us = int(us)
                if stage in ("COMPLETED", "FAILED"):
                    new = (us, stage, status or "", message or "")
                    if not self.end.exists() or new < tuple(self.end.get()):
                        self.end.update(new)
                if stage != "FAILED":
                    old = self.reached.getValue((stage,)) if self.reached.containsKey((stage,)) else (us, us)
                    self.reached.updateValue((stage,), (min(us, old[0]), max(us, old[1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not self.end.exists():
            last = max(v[1] for _, v in self.reached.iterator())
            self.handle.registerTimer(last // 1000 + self.timeout * 1000)
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.end.exists():
            yield self._row(key, silent=True)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, late: str = "10 minutes", timeout: int = TIMEOUT) -> DataFrame:
    """The rows of ``run_states`` as a stream in update mode: a run's last row is its state. Events later than ``late`` behind the
    newest are dropped; an open run whose last event lies ``timeout`` seconds behind the watermark fails.

    The session must use the RocksDB state store, which keeps state of any size out of the heap.
    """
    e = _known(events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)).select("run_id", "stage", "status", "message", "us", "at")
    out = e.groupBy("run_id").transformWithStateInPandas(statefulProcessor=_Run(timeout), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
    return _as_times(out)
