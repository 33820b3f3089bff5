"""Stateful alert handling over streams: cooldown, transitions, throttling, retention and snapshots.

State is kept by key in RocksDB, one value to a key, and a timer on event time drops it when it can
matter no more.  A key's rows of one micro-batch are held in memory while they are put in order, so the
source's limit on a batch is the bound.  Sinks are idempotent by batch number: a batch that runs again
after a failure leaves what it would have left the first time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrel.operators import reports, state


class _Walk(StatefulProcessor):
    """A key's rows of a batch in the order of their times, beside one value of state.

    `step(times, rows, last)` gives (rows to emit, value to keep, when it may go).  The state is a value of
    one long or string; a timer drops it once the watermark has passed that time.
    """

    def __init__(self, schema: str, ts: str, names: list[str], step: Callable[[np.ndarray, pd.DataFrame, object], tuple[object, object, int]]):
        self.schema, self.ts, self.names, self.step = schema, ts, names, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        times = held[self.ts].to_numpy("datetime64[us]").astype(np.int64)
        found, last, until = self.step(times, held, self.last.get()[0] if self.last.exists() else None)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(-(-until // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        if len(found):
            yield found[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _walked(rows: DataFrame, keys: list[str], ts: str, schema: str, step, output: str | None = None) -> DataFrame:
    """Needs a watermark on ts.  Sets the session's state store to RocksDB, which state with timers needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = rows.columns if output is None else [c.split()[0] for c in output.split(", ")]
    walk = _Walk(schema, ts, names, step)
    return rows.groupBy(*keys).transformWithStateInPandas(walk, rows.schema if output is None else output, "Append", "EventTime")


def cooldown(alerts: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 300, dismissed: DataFrame | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Alerts more than `seconds` after the last of their key that fired (R1, Q20); dismissed keys never fire.

    `dismissed` is a static table of keys.  With a constant key this throttles (R6).  A key's state goes
    when the watermark is past its cooldown: from then on whatever comes would fire.
    """
    if dismissed is not None:
        alerts = alerts.join(dismissed.select(keys).distinct(), keys, "left_anti")
    pause = seconds * 1_000_000

    def step(times, rows, last):
        keep, fired = state._fires(times, pause, state._NEVER if last is None else last)
        return rows.iloc[keep], fired, fired + pause

    return _walked(alerts.where(F.col(ts).isNotNull()).withWatermark(ts, lateness), keys, ts, "fired long", step)


def transitions(samples: DataFrame, keys: list[str], value: str, ts: str = "ts", lateness: str = "10 minutes", remember: int = 7 * 86400) -> DataFrame:
    """Samples whose value differs from the one before it of the same key; the first one counts (R2).

    Samples without a value or a time are left aside.  A key that is silent for `remember` seconds is
    forgotten: its next sample counts as a first one.
    """

    def step(times, rows, last):
        values = rows[value].astype(str).tolist()
        keep = [n for n, (x, before) in enumerate(zip(values, [last, *values], strict=False)) if x != before]
        return rows.iloc[keep], values[-1], int(times[-1]) + remember * 1_000_000

    known = samples.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    return _walked(known.withWatermark(ts, lateness), keys, ts, "last string", step)


def coalesced_runs(requests: DataFrame, keys: list[str], seconds: int, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """(keys, run): when runs of a fixed length start (R5).  A request while none is on starts one; requests while one is on make one more at its end.

    A run's rerun is known when the first request that it serves is read, so its start may lie ahead of that.
    """
    length = seconds * 1_000_000
    kinds = dict(requests.dtypes)

    def step(times, rows, last):
        starts, last = state.run_starts(times, length, last)
        found = pd.DataFrame({k: [rows[k].iloc[0]] * len(starts) for k in keys} | {"run": pd.to_datetime(np.array(starts, "int64").astype("datetime64[us]"))})
        return found, last, last + length

    known = requests.where(F.col(ts).isNotNull()).withWatermark(ts, lateness)
    return _walked(known, keys, ts, "run long", step, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"run {kinds[ts]}"]))


def startup_grace(events: DataFrame, started: dt.datetime, seconds: int = 15, ts: str = "ts") -> DataFrame:
    """Events from `seconds` after the start."""
    return events.where(F.col(ts) >= F.lit(started + dt.timedelta(seconds=seconds)))


def retained(rows: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last days, by real timestamps (R7, X20, Q21); those without a time go."""
    return rows.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def coalesced(starts: list[tuple[float, float]]) -> list[float]:
    """When runs start for (request time, run length) pairs in order (R5): requests during a run make one rerun at its end."""
    out: list[float] = []
    busy_until, pending = float("-inf"), None
    for at, length in starts:
        if pending is not None and at >= busy_until:
            out.append(busy_until)
            busy_until, pending = busy_until + pending, None
        if at >= busy_until:
            out.append(at)
            busy_until = at + length
        else:
            pending = length
    return [*out, busy_until] if pending is not None else out


def _snapshots_before(spark: SparkSession, path: str, number: int) -> list[str]:
    """Folders of the snapshots before a batch, in order; a batch that failed for good has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(f.getPath().getName() for f in found)
    return [n for n in names if n.startswith("batch=") and int(n.removeprefix("batch=")) < number]


def _drop(spark: SparkSession, path: str, names: list[str]) -> None:
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def diff_sink(path: str, keys: list[str], emit: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink (R3): each batch is a snapshot; `emit` gets its up and down events against the last one.

    Snapshots are written under their batch number in a folder that all machines share, so that a batch
    that runs again after a failure meets the same predecessor.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(keys).distinct().write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        new = spark.read.parquet(f"{path}/batch={number:012d}")
        last = _snapshots_before(spark, path, number)
        old = spark.read.parquet(f"{path}/{last[-1]}") if last else new.limit(0)
        emit(reports.up_down(old, new, keys))
        _drop(spark, path, last[:-1])  # a batch that runs again needs its predecessor only

    return sink


def once_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that leaves each row once: a batch's rows are the folder of its number, which a batch that runs again replaces.

    `spark.read.parquet(path)` reads all batches; batch is a column of theirs.  A batch that broke off has
    no `_SUCCESS` mark and is replaced when the query starts again, before any later one is written.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return sink


def upsert_sink(path: str, keys: list[str], day: str, newest: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink (R10): each day's rows of a batch replace those of the same keys, other days are not touched.

    `newest` orders the rows of one key in a batch, the one to stay first; without it a key must not repeat in a batch.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = state.one_of(batch, keys, newest)
        days = [r[0] for r in batch.select(day).distinct().collect()]  # days in one micro-batch: a handful
        try:
            base = spark.read.schema(batch.schema).parquet(path).where(F.col(day).isin(days))
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            base = batch.limit(0)
        kept = base.join(batch.select(keys), keys, "left_anti").unionByName(batch)
        staged = f"{path}__stage/{number % 2}"
        kept.write.mode("overwrite").parquet(staged)
        reports.replace_partitions(spark.read.schema(batch.schema).parquet(staged), path, [day])

    return sink
