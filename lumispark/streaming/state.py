"""Streams with typed state by key and event-time timers: current pointers from an initial state, alerts that hold and clear;
and series that come and go, by window alone.

They need the RocksDB state store; ``stateful_session`` gives a session that has it. Windows are summed by Spark before any
key's state is met, so a hot series costs a row a window there, and samples that come out of order are in their window if
they come before the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one is left as it is."""
    session = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(k, spark.conf.get(k))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return session


class _Pointer(StatefulProcessor):
    """The greatest revision of an object and its run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "light_curve_revision long, run_id string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        top = initialState.loc[initialState["light_curve_revision"].idxmax()]
        self.best.update((int(top["light_curve_revision"]), top["run_id"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = best = self.best.get()[0] if self.best.exists() else 0
        for b in rows:
            top = b.loc[b["light_curve_revision"].idxmax()]
            if top["light_curve_revision"] > best:
                best, run = int(top["light_curve_revision"]), top["run_id"]
        if best > was:
            self.best.update((best, run))
            yield pd.DataFrame({"object_id": [key[0]], "run_id": [run], "light_curve_revision": [best]})

    def close(self) -> None:
        pass


def current_from(runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Moves of the current pointers of a stream of PRODUCTION runs (object_id, run_id, light_curve_revision), which are
    ``pointers`` (the same columns, not a stream) when it begins. Started again from its checkpoint it goes on from the
    state that it had, and pointers are not read. Only strictly greater revisions move a pointer, so a replay moves none."""
    first = pointers.select("object_id", "run_id", "light_curve_revision").groupBy("object_id")
    return runs.groupBy("object_id").transformWithStateInPandas(_Pointer(), "object_id string, run_id string, light_curve_revision long", "append", "None", first)


class _Windows(StatefulProcessor):
    """Windows of a series in order, whatever batches they come in, with a timer that ends what no window follows."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_s long, run int, alerting boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.last.get() if self.last.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("at_s").itertuples(index=False):
            now, found = self.step_to(None if now is None else tuple(now), row)
            out += [(*key, *x) for x in found]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(now)
        # the window after the last one would have come when the watermark is at its end
        self.handle.registerTimer((now[0] + 2 * self.step) * 1000)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            found = self.ended(tuple(self.last.get()))
            self.last.clear()
            if found:
                yield pd.DataFrame([(*key, *x) for x in found])

    def step_to(self, last: tuple | None, row) -> tuple[tuple, list[tuple]]:
        """(state, what to give out) when the window of row comes after that of last."""
        raise NotImplementedError

    def ended(self, last: tuple) -> list[tuple]:
        """What to give out when no window follows."""
        return []

    def close(self) -> None:
        pass


class _Held(_Windows):
    def __init__(self, step: int, hold: int):
        super().__init__(step)
        self.hold = hold

    def step_to(self, last, row):
        out = []
        if last is not None and last[0] + self.step < row.at_s:  # a missing window ends the run
            out, last = self.ended(last), None
        run, alerting = (last[1], last[2]) if last else (0, False)
        run = run + 1 if row.firing else 0
        if alerting != (run >= self.hold):
            alerting = not alerting
            out.append((int(row.at_s), "raised" if alerting else "cleared"))
        return (int(row.at_s), run, alerting), out

    def ended(self, last):
        return [(last[0] + self.step, "cleared")] if last[2] else []


def _windows(samples: DataFrame, by: list[str], minutes: int, late: str, **sums: Column) -> DataFrame:
    """Sums of a stream of samples (ts, by, ...) by window: by, at_s (the window's start), the sums, and the time of its end."""
    windows = samples.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), *by).agg(*(c.alias(n) for n, c in sums.items()))
    return windows.select(*by, F.unix_timestamp(F.col("window.start")).alias("at_s"), *sums, F.window_time("window").alias("ends"))


def _by(samples: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in by)


def held_alerts(windows: DataFrame, by: list[str], firing: Column, minutes: int, hold: int = 2) -> DataFrame:
    """(by, at_s, change): ``raised`` at the window with which a series has been firing for ``hold`` windows on end, and
    ``cleared`` at the one after its last: which does not fire, or never comes. windows: as of ``error_windows``."""
    rows = windows.withColumn("firing", F.coalesce(firing, F.lit(False))).select(*by, "at_s", "firing", "ends")
    return rows.groupBy(*by).transformWithStateInPandas(_Held(60 * minutes, hold), f"{_by(windows, by)}, at_s long, change string", "append", "EventTime")


def error_alerts(requests: DataFrame, by: list[str], late: str, minutes: int = 5, share: float = 0.05, least: float = 0.1, hold: int = 2) -> DataFrame:
    """Changes of the error-ratio alert over a stream of requests (ts, by, status_class, increase): 5xx over ``share`` of the
    traffic, and traffic over ``least`` a second; see ``operations.error_ratio`` for the batch."""
    seconds = 60.0 * minutes
    errors = F.sum(F.when(F.col("status_class") == "5xx", F.col("increase")).otherwise(0.0)) / seconds
    windows = _windows(requests, by, minutes, late, rate=F.sum("increase") / seconds, errors=errors)
    firing = (F.col("errors") / F.greatest("rate", F.lit(0.001)) > share) & (F.col("rate") > least)
    return held_alerts(windows, by, firing, minutes, hold)


def retry_alerts(gauges: DataFrame, late: str, minutes: int = 5, seconds: float = 60.0, hold: int = 2) -> DataFrame:
    """Changes of the stuck-retry alert over a stream of gauges (ts, pod, name, value): in a window a pod's greatest command
    age is over ``seconds`` and something of it is retrying."""
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    windows = _windows(gauges, ["pod"], minutes, late, age=of("command_age_seconds"), retrying=of("commands_retrying"))
    return held_alerts(windows, ["pod"], (F.col("age") > seconds) & (F.col("retrying") > 0), minutes, hold)


def new_series(samples: DataFrame, by: list[str], late: str, minutes: int = 5) -> DataFrame:
    """(by, at_s, increase, is_new) of the windows in which a series of a stream (ts, by, increase) counts an event: it
    increased, or it was not there a window ago. A series that is not seen for a window is forgotten, so state is held for
    the live ones alone, and one that comes back is new again.

    There can be as many series as samples, so no Python meets them one by one: a sample is in two frames of two windows
    each, counted in the one that ends with its own window, and in the next only telling that the series was there. One
    that is too late for its own window still tells so while the next is open."""
    frames = samples.withWatermark("ts", late).select(*by, "ts", "increase", F.window("ts", f"{2 * minutes} minutes", f"{minutes} minutes").alias("frame"))
    begins = F.col("frame.start") + F.expr(f"interval {minutes} minutes")
    frames = frames.withColumn("own", F.col("ts") >= begins)
    sums = frames.groupBy("frame", *by).agg(F.sum(F.when(F.col("own"), F.col("increase"))).alias("increase"), F.bool_or("own").alias("here"), F.bool_and("own").alias("is_new"))
    return sums.where("here and (is_new or increase > 0)").select(*by, F.unix_timestamp(begins).alias("at_s"), F.col("increase").cast("double").alias("increase"), "is_new")
