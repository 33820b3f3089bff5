"""State history: transitions, retention, upserts, diffs, cooldowns and debouncing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kestrel.operators import shared


def transitions(samples: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Samples whose state differs from the one before it in the same entity; the first one counts.

    Null is a state of its own: a change to or from it counts, nulls in a row are one state.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = samples.withColumns({"previous": F.lag(state).over(w), "_nth": F.row_number().over(w)})
    return numbered.where((F.col("_nth") == 1) | ~F.col("previous").eqNullSafe(F.col(state))).drop("_nth")


def latest_n(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def one_of(changes: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """One row of each key: the first by `order`; without one the keys must not repeat."""
    if not order:
        return changes
    return latest_n(changes.withColumn("_key", F.struct(*keys)), "_key", order, 1).drop("_key")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], newest: list[Column] | None = None) -> DataFrame:
    """Rows of changes replace those of the same keys, others are added (K1).

    `newest` orders the changes of one key, the one to stay first; without it a key must not repeat in them.
    """
    changes = one_of(changes, keys, newest)
    return base.join(changes.select(keys), keys, "left_anti").unionByName(changes.select(base.columns))


def upsert_partial(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], newest: list[Column] | None = None) -> DataFrame:
    """Only these columns are replaced; rows that base lacks are added (K2).  `newest` is as in upsert."""
    changes = one_of(changes, keys, newest)
    new = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(new, keys, "full_outer").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns if c not in keys))


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str], first: list[Column] | None = None) -> DataFrame:
    """Rows whose keys base lacks are added (K3); of those of one key the first by `first`, without which a key must not repeat in them."""
    rows = one_of(rows, keys, first)
    return base.unionByName(rows.join(base.select(keys), keys, "left_anti").select(base.columns))


def merge_open(findings: DataFrame, scan: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Open findings with first_seen and resolved_at after a scan: known ones keep first_seen, missing ones are resolved (K6, Q22)."""
    seen = scan.select(*keys, F.lit(True).alias("_seen")).distinct()
    return findings.join(seen, keys, "full_outer").select(*keys, F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("_seen").isNull(), now).alias("resolved_at"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed keys between two snapshots."""
    both = old.select(key, F.col(value).alias("old"), F.lit(1).alias("_o")).join(new.select(key, F.col(value).alias("new"), F.lit(1).alias("_n")), key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "change", "old", "new")


def debounce(events: DataFrame, key: str, ts: str, quiet: str) -> DataFrame:
    """Bursts with less than `quiet` between neighbours, a row each."""
    return events.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


#: Entry of a chunk's function for a key without an alert that fired yet.
_NEVER = np.iinfo(np.int64).min


def _micros(pdf: pd.DataFrame, ts: str) -> np.ndarray:
    return pdf[ts].to_numpy("datetime64[us]").astype(np.int64)


def _fires(times: np.ndarray, pause: int, last: int) -> tuple[list[int], int]:
    """(alerts that fire, last time fired) of sorted times after one that fired at `last`: leaps from one to the first that is late enough."""
    out, i = [], 0 if last == _NEVER else int(times.searchsorted(last + pause, "right"))
    while i < len(times):
        last = int(times[i])
        out.append(i)
        i += max(1, int(times[i:].searchsorted(last + pause, "right")))
    return out, last


def run_starts(times: np.ndarray, length: int, last: int | None) -> tuple[list[int], int | None]:
    """(starts, last start) of runs that sorted requests make after one that started at `last`: at once if none is on, else once at its end.

    Requests at a run's start are its own; those after it and before its end make the next one.
    """
    out, i = [], 0
    while i < len(times):
        if last is not None and times[i] <= last:  # an earlier one has made this run, or it has not begun
            i += max(1, int(times[i:].searchsorted(last, "right")))
            continue
        last = int(times[i]) if last is None else max(int(times[i]), last + length)
        out.append(last)
        i += 1
    return out, last


def coalesced_runs(requests: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """(keys, run): starts of runs of a fixed length, one rerun at the end of each that requests came during (R5).  Requests without a time make none.

    Where no request came for the length of a run nothing is on, whatever came before; keys are walked in
    order of time, one value at a time.
    """
    kinds, length = dict(requests.dtypes), seconds * 1_000_000

    def walk(batches):
        held, last = None, None
        for pdf in batches:
            out = []
            for own, rows in pdf.groupby(keys, sort=False, dropna=False):
                if own != held and str(own) != str(held):
                    held, last = own, None
                starts, last = run_starts(_micros(rows, ts), length, last)
                out.append(pd.DataFrame({k: [rows[k].iloc[0]] * len(starts) for k in keys} | {"run": pd.to_datetime(np.array(starts, "int64").astype("datetime64[us]"))}))
            if out:
                yield pd.concat(out)

    ordered = requests.where(F.col(ts).isNotNull()).select(*keys, ts).repartition(*keys).sortWithinPartitions(*keys, ts)
    return ordered.mapInPandas(walk, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"run {kinds[ts]}"]))


def _passage(times: np.ndarray, pause: int) -> tuple[list[int], list[int]]:
    """What sorted times make of the last time fired before them: (bounds, results).  With n bounds up to last + pause it becomes results[n]; _NEVER leaves it as it is.

    Only alerts up to one pause after the first can be the first to fire.  Where a chain from each ends
    is found by jumping along the next ones, doubled each time; neighbours with one end are one piece.
    """
    n = len(times)
    jump = times.searchsorted(times + pause, "right")
    jump = np.where(jump < n, jump, np.arange(n))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    most = int(times.searchsorted(times[0] + pause, "right"))
    ends = np.append(times[jump[: min(most + 1, n)]], [_NEVER] * (most == n))
    new = np.flatnonzero(np.diff(ends)) + 1
    return times[new - 1].tolist(), [int(ends[0]), *ends[new].tolist()]


def cooldown(alerts: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Alerts that fire: more than `seconds` after the last one of the key that fired.

    Alerts without a time never fire.  Alerts are dealt in ranges of key and time, so the alerts of one
    key may lie in many ranges.  A key that begins in a range is walked there.  For one that goes on from
    the range before, the range gives a function of the last time fired; these are composed in order, a
    row to a range, and then every range is walked from its own entry.  So one key with all rows is
    the work of all tasks.
    """
    spark, names, pause = alerts.sparkSession, alerts.columns, seconds * 1_000_000
    folder, n = shared.folder(spark, "cooldown"), shared.partitions(spark)
    at = [names.index(k) for k in key]
    nullable = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema)
    made = f"{nullable}, _part int, _kind int, _bounds array<long>, _results array<long>"
    ranged = alerts.where(F.col(ts).isNotNull()).repartitionByRange(n, *key, ts).sortWithinPartitions(*key, ts)

    def walk(batches):
        """Kinds of rows: 0 fires, 1 hangs on the range before, 2 what the range's first key makes of the last time fired, 3 what its last key, which began in it, hands on."""
        from pyspark import TaskContext

        part, held, first, fired, waiting, sample = TaskContext.get().partitionId(), None, True, _NEVER, [], None

        def marked(rows, kind, bounds=None, results=None):
            empty = lambda x: pd.Series([x] * len(rows), index=rows.index, dtype=object)
            return rows.assign(_part=part, _kind=kind, _bounds=empty(bounds), _results=empty(results))

        for pdf in batches:
            if not len(pdf):
                continue
            keys, times, kinds = pdf.iloc[:, at], _micros(pdf, ts), np.full(len(pdf), -1)
            after, before = keys.iloc[1:].reset_index(drop=True), keys.iloc[:-1].reset_index(drop=True)
            differ = ((after != before) & ~(after.isna() & before.isna())).any(axis=1).to_numpy()
            starts = [0, *(differ.nonzero()[0] + 1).tolist(), len(pdf)]
            own = tuple(None if pd.isna(x) else x for x in keys.iloc[0])
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if i or sample is None or own != held:
                    if sample is not None and first:
                        yield marked(sample, 2, *_passage(np.concatenate(waiting), pause))
                        first, waiting = False, []
                    fired, sample = _NEVER, pdf.iloc[i : i + 1]
                if first:
                    waiting.append(times[i:j])
                    kinds[i:j] = 1
                else:
                    keep, fired = _fires(times[i:j], pause, fired)
                    kinds[[i + k for k in keep]] = 0
            held = tuple(None if pd.isna(x) else x for x in keys.iloc[-1])
            yield marked(pdf[kinds >= 0], kinds[kinds >= 0])
        if sample is not None:
            yield marked(sample, 2, *_passage(np.concatenate(waiting), pause)) if first else marked(sample, 3, [], [fired])

    out = shared.stash(ranged.mapInPandas(walk, made), f"{folder}/walked")

    def compose(batches):
        """The last time fired before each range whose first key goes on from the one before."""
        held, fired = None, _NEVER
        for pdf in batches:
            parts, entries = [], []
            for row in pdf.itertuples(index=False):
                own = tuple(None if pd.isna(row[i]) else row[i] for i in at)
                if held is None or own != held:
                    held, fired = own, _NEVER
                if row[-3] == 2:
                    parts.append(row[-4])
                    entries.append(fired)
                bounds, results = np.asarray(row[-2], np.int64), row[-1]
                after = int(results[0 if fired == _NEVER else int(bounds.searchsorted(fired + pause, "right"))])
                fired = fired if after == _NEVER else after
            yield pd.DataFrame({"_part": parts, "_entry": entries})

    borders = out.where("_kind >= 2").repartition(n, *key).sortWithinPartitions(*key, "_part")
    entries = borders.mapInPandas(compose, "_part int, _entry long")  # a row to a range
    waiting = out.where("_kind = 1").select(*names, "_part").join(F.broadcast(entries), "_part")

    def finish(batches):
        held, fired = None, _NEVER
        for pdf in batches:
            if not len(pdf):
                continue
            own = pdf["_part"].to_numpy()
            starts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(pdf)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                rows = pdf.iloc[i:j]
                if own[i] != held:
                    held, fired = own[i], int(rows["_entry"].iloc[0])
                keep, fired = _fires(_micros(rows, ts), pause, fired)
                yield rows.iloc[keep][names]

    rest = waiting.repartitionById(n, "_part").sortWithinPartitions("_part", ts).mapInPandas(finish, nullable)
    return out.where("_kind = 0").select(names).unionByName(rest)


def severity(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


#: Points that an open finding takes off the security score; unknown severities count as 1.
WEIGHTS = {"critical": 20, "high": 10, "medium": 3, "low": 1}


def security_score(findings: DataFrame, by: str) -> DataFrame:
    """100 less the weights of the findings, not under 0."""
    weight = F.coalesce(*(F.when(F.col("severity") == k, w) for k, w in WEIGHTS.items()), F.lit(1))
    return findings.groupBy(by).agg(F.greatest(F.lit(0), 100 - F.sum(weight)).cast("long").alias("score"))


def quiet_hours(ts: Column, start: int, end: int) -> Column:
    """Whether a time lies in the quiet hours (minutes of the day), which may wrap around midnight."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute >= start) | (minute < end) if start > end else (minute >= start) & (minute < end)
