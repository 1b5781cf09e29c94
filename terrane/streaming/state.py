"""Leases, heartbeats and streaks of failures as keyed state of a stream (Q-3, Q-9, Q-10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

#: Seconds without a beat after which a worker counts as stopped.
STALE_SECONDS = 100
LEASE_STATE = StructType([StructField("started_ms", LongType()), StructField("ends_ms", LongType())])
LEASE_OUT = StructType([StructField("task_id", StringType()), StructField("status", StringType()), StructField("at", TimestampType())])
#: Changes, and with ``open`` the last beat of each lease that still runs.
TURNS = StructType([*LEASE_OUT.fields, StructField("open", BooleanType())])
STREAK_STATE = StructType([StructField("ok_ms", LongType()), StructField("error_ms", LongType()), StructField("errors", LongType()), StructField("late", StringType())])
STREAK_OUT = StructType([StructField("name", StringType()), StructField("ok_at", TimestampType()), StructField("error_at", TimestampType()), StructField("errors", LongType())])


def _ms(times: pd.Series) -> list[int]:
    return (pd.to_datetime(times, utc=True).astype("datetime64[us, UTC]").astype("int64") // 1000).tolist()


def _frame(rows: list[tuple], shape: StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=shape.names)
    for f in shape.fields:
        if isinstance(f.dataType, TimestampType):
            out[f.name] = pd.to_datetime(out[f.name], unit="ms")
    return out


class Leases(StatefulProcessor):
    """Of each task whether it still runs: a claim or a beat starts its lease anew, a release ends it, and a timer expires it.

    Rows: ``(task_id, event, at)`` with event claim, beat or release. Written: ``RUNNING`` when a lease
    begins, ``RELEASED`` when it ends, ``EXPIRED`` with the time at which it ran out. Events of one batch count in
    the order of their times. A beat of a task without a lease does nothing.
    """

    def __init__(self, seconds: int):
        self.lease_ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", LEASE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (task,) = key
        events = sorted(x for part in rows for x in zip(_ms(part["at"]), part["event"], strict=True))
        held, out = self.lease.get(), []
        started, ends = (held[0], held[1]) if held is not None else (None, None)
        old = ends
        for at, event in events:
            if ends is not None and at >= ends:
                out.append((task, "EXPIRED", ends))
                started = ends = None
            if event == "claim" and ends is None:
                started = at
                out.append((task, "RUNNING", at))
            if event == "release" and ends is not None:
                out.append((task, "RELEASED", at))
                started = ends = None
            elif started is not None:
                ends = max(ends or 0, at + self.lease_ms)
        if old is not None and old != ends:
            self.handle.deleteTimer(old)
        if ends is None:
            self.lease.clear()
        elif old != ends:
            self.lease.update((started, ends))
            self.handle.registerTimer(ends)
        if out:
            yield _frame(out, LEASE_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (task,) = key
        held = self.lease.get()
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.clear()
            yield _frame([(task, "EXPIRED", held[1])], LEASE_OUT)

    def close(self) -> None:
        pass


class Streaks(StatefulProcessor):
    """Failures in a row up to now of each loop: a success sets them to zero.

    Rows: ``(name, at, ok)``. After each batch with rows of a loop its state is written. A row that arrives late counts
    by its time: a failure before the last success is none of the streak, and a success ends the failures up to its time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", STREAK_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (name,) = key
        held = self.streak.get()
        ok_at = held[0] if held is not None else None
        errors = [int(x) for x in held[3].split(",") if x] if held is not None else []
        for part in rows:
            for at, ok in zip(_ms(part["at"]), part["ok"], strict=True):
                if ok:
                    ok_at = at if ok_at is None else max(ok_at, at)
                else:
                    errors.append(at)
        # The times of the running streak, so that a late success can still end a part of it.
        errors = sorted(x for x in errors if ok_at is None or x > ok_at)
        last = errors[-1] if errors else None
        self.streak.update((ok_at, last, len(errors), ",".join(map(str, errors))))
        yield _frame([(name, ok_at, last, len(errors))], STREAK_OUT)

    def close(self) -> None:
        pass


def _stateful(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def lease_changes(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """``(task_id, status, at)`` as leases begin, end and run out; timers follow the watermark on ``at`` (Q-3).

    A lease that ran out is written once the stream has seen a later time than its end.
    """
    _stateful(events.sparkSession)
    return events.withWatermark("at", late).groupBy("task_id").transformWithStateInPandas(Leases(seconds), LEASE_OUT, "Append", "EventTime")


def worker_changes(beats: DataFrame, stale_seconds: int = STALE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """``(task_id, status, at)`` of workers: RUNNING with the first beat, EXPIRED when beats have stopped for so long (Q-9).

    ``beats``: ``(worker, at)``.
    """
    claims = beats.selectExpr("worker AS task_id", "'claim' AS event", "at")
    return lease_changes(claims, stale_seconds, late)


def beat_turns(beats: DataFrame, held: DataFrame, stale_seconds: int) -> DataFrame:
    """Changes by the beats of one batch and the leases that ``held`` left open, and the leases that are open then (``TURNS``).

    A lease is as long as each beat follows the last one in time; it has run out once a later time than its end was seen.
    The last beat seen is always part of an open lease, so ``held`` tells how far the stream was; older beats are late and do not count.
    """
    ms, stale = F.unix_millis("at"), stale_seconds * 1000
    known = held.select("task_id", ms.alias("t"), F.lit(True).alias("known"))
    new = beats.where("at IS NOT NULL").select(F.col("worker").alias("task_id"), ms.alias("t"), F.lit(False).alias("known"))
    until = F.broadcast(held.agg(F.max(ms).alias("until")))
    rows = known.unionByName(new.join(until, F.col("until").isNull() | (F.col("t") >= F.col("until"))).drop("until"))
    seen = F.broadcast(rows.agg(F.max("t").alias("seen")))
    order = Window.partitionBy("task_id").orderBy("t", F.desc("known"))
    near = rows.withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order)}).crossJoin(seen)
    starts = ~F.col("known") & (F.col("before").isNull() | (F.col("t") - F.col("before") >= stale))
    ends = F.coalesce(F.col("after") - F.col("t") >= stale, F.col("t") + stale < F.col("seen"))
    turn = lambda test, status, at, running: F.when(test, F.struct(F.lit(status).alias("status"), F.timestamp_millis(at).alias("at"), F.lit(running).alias("open")))
    turns = F.array(turn(starts, "RUNNING", F.col("t"), False), turn(ends, "EXPIRED", F.col("t") + stale, False), turn(F.col("after").isNull() & ~ends, "RUNNING", F.col("t"), True))
    return near.select("task_id", F.inline(F.array_compact(turns)))


def follow_workers(beats: DataFrame, out: str, marks: str, stale_seconds: int = STALE_SECONDS) -> StreamingQuery:
    """Writes what ``worker_changes`` gives to a folder, batch by batch, for very many workers (Q-9); ``worker_log`` reads it.

    The state are the open leases, a table beside each batch's changes: a batch is one sort by worker, without a call
    to Python or a timer for each of them. A batch that is run again overwrites its own folder.
    """
    beats.sparkSession.createDataFrame([], TURNS).write.mode("ignore").partitionBy("open").parquet(out)

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(TURNS).parquet(f"{out}/batch={n - 1}").where("open") if n else spark.createDataFrame([], TURNS)
        beat_turns(batch, held, stale_seconds).write.mode("overwrite").partitionBy("open").parquet(f"{out}/batch={n}")

    return beats.writeStream.foreachBatch(step).option("checkpointLocation", marks).trigger(availableNow=True).start()


def worker_log(spark: SparkSession, out: str) -> DataFrame:
    """``(task_id, status, at)`` of the batches written so far."""
    return spark.read.schema(TURNS).parquet(out).where("NOT open").select(LEASE_OUT.names)


def streak_changes(log: DataFrame) -> DataFrame:
    """``(name, ok_at, error_at, errors)`` of each loop after each batch that has rows of it (Q-10)."""
    _stateful(log.sparkSession)
    return log.groupBy("name").transformWithStateInPandas(Streaks(), STREAK_OUT, "Update", "None")
