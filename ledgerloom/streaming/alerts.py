"""Ingest alerts with state and event-time timers (M5).

* ``stalled``: the rate over RANGE seconds has been zero for HOLD seconds, that is, no record for
  RANGE + HOLD seconds after some record.
* ``error_rate``: at a full minute, the errors of the last five minutes exceeded ``limit`` per second,
  and did so at the two full minutes before as well (a hold of two minutes).

Records are first reduced to one row per (stream, minute) and Arrow batch, so that a stream that
has all records reaches its state as a few rows per minute.  The state of a stream holds the
minutes whose outcome is still open: those after the watermark, and the seven minutes before it
that its error windows and stall check look back on.  A timer wakes the stream at its next open
check, also when it has gone silent and only others move the watermark on.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import STALL_HOLD, STALL_RANGE

MINUTE = 60
# Alert rule of the error rate (windows and hold in minutes, errors per second).
ERROR_WINDOW, ERROR_HOLD, ERROR_LIMIT = 5, 2, 0.1
MINUTES = "stream_type string, minute timestamp, first_ts long, last_ts long, errors long"
ALERTS = "stream_type string, alert string, at long, last_record long"


def per_minute(records: DataFrame) -> DataFrame:
    """records(stream_type, ts long, is_error) -> first and last second and errors per minute, once per
    Arrow batch (the state adds them up)."""
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = pdf.groupby(["stream_type", pdf["ts"] // MINUTE * MINUTE])
            out = g.agg(first_ts=("ts", "min"), last_ts=("ts", "max"), errors=("is_error", "sum"))
            out.index.names = ["stream_type", "minute"]
            out = out.reset_index()
            out["minute"] = pd.to_datetime(out["minute"], unit="s", utc=True)
            yield out
    rows = records.where("ts is not null").select(
        F.coalesce("stream_type", F.lit("")).alias("stream_type"), "ts", F.col("is_error").cast("long").alias("is_error"))
    return rows.mapInPandas(combine, MINUTES)


class OpenMinutes:
    """The minutes of one stream: {minute: [first second, last second, errors]}."""

    def __init__(self, text: str | None, limit: float):
        loaded = json.loads(text) if text else {"minutes": {}, "done": None}
        self.minutes = {int(k): v for k, v in loaded["minutes"].items()}
        self.done: int | None = loaded["done"]      # checks up to this second have been made
        self.most = limit * ERROR_WINDOW * MINUTE   # errors of a window that are still no alert

    def dump(self) -> str:
        return json.dumps({"minutes": {str(k): v for k, v in sorted(self.minutes.items())}, "done": self.done})

    def add(self, minute: int, first: int, last: int, errors: int) -> None:
        a, b, n = self.minutes.get(minute, (first, last, 0))
        self.minutes[minute] = [min(a, first), max(b, last), n + errors]

    def checks(self) -> list[tuple[int, str, int]]:
        """(second, alert, minute) of all checks that the known minutes ask for."""
        out = []
        for m, (_, last, errors) in self.minutes.items():
            out.append((last + STALL_RANGE + STALL_HOLD, "stalled", m))
            if errors:
                out += [(m + MINUTE * k, "error_rate", m) for k in range(1, ERROR_WINDOW + 1)]
        return sorted(set(c for c in out if self.done is None or c[0] > self.done))

    def over(self, at: int) -> bool:
        """Too many errors in the window that ends at the full minute ``at``."""
        return sum(self.minutes.get(at - MINUTE * k, (0, 0, 0))[2] for k in range(1, ERROR_WINDOW + 1)) > self.most

    def alerts(self, upto: int) -> list[tuple[str, int, int | None]]:
        """(alert, second, last record) of the checks up to ``upto``; drops minutes no longer needed."""
        out, order, said = [], sorted(self.minutes), set()
        follower = dict(zip(order, order[1:]))
        for at, alert, m in self.checks():
            if at > upto:
                break
            if alert == "stalled":
                last = self.minutes[m][1]
                after = follower.get(m)
                if after is None or self.minutes[after][0] > at:
                    out.append((alert, at, last))
            elif at not in said and all(self.over(at - MINUTE * k) for k in range(ERROR_HOLD + 1)):
                said.add(at)
                out.append((alert, at, None))
        self.done = max(upto, self.done if self.done is not None else upto)
        keep = self.done - MINUTE * (ERROR_WINDOW + ERROR_HOLD + 1)
        open_minutes = {m for at, _, m in self.checks()}
        self.minutes = {m: v for m, v in self.minutes.items() if m >= keep or m in open_minutes}
        return out


class IngestAlerts(StatefulProcessor):
    def __init__(self, limit: float = ERROR_LIMIT):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "minutes string")

    def _step(self, key, watermark_ms: int, state: OpenMinutes) -> Iterator[pd.DataFrame]:
        rows = state.alerts(watermark_ms // 1000) if watermark_ms > 0 else []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        coming = state.checks()
        if coming:
            self.handle.registerTimer(coming[0][0] * 1000)
        self.open.update((state.dump(),))
        if rows:
            yield pd.DataFrame({"stream_type": [key[0]] * len(rows), "alert": [r[0] for r in rows],
                                "at": [r[1] for r in rows], "last_record": pd.array([r[2] for r in rows], "Int64")})

    def _state(self) -> OpenMinutes:
        return OpenMinutes(self.open.get()[0] if self.open.exists() else None, self.limit)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        for pdf in rows:
            for r in pdf.itertuples():
                state.add(int(r.first_ts) // MINUTE * MINUTE, int(r.first_ts), int(r.last_ts), int(r.errors))
        yield from self._step(key, timerValues.getCurrentWatermarkInMs(), state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, timerValues.getCurrentWatermarkInMs(), self._state())

    def close(self) -> None:
        pass


def alert_stream(records: DataFrame, delay: str = "1 minute", limit: float = ERROR_LIMIT) -> DataFrame:
    """(stream_type, alert, at, last_record) of a stream of records(stream_type, ts, is_error).

    The watermark is the largest minute seen less ``delay``; minutes up to it are closed, so a delay
    of less than a minute would lose records of a minute that two batches share.  Needs the RocksDB
    state store (:class:`rocksdb_state`)."""
    minutes = per_minute(records).withWatermark("minute", delay)
    return minutes.groupBy("stream_type").transformWithStateInPandas(
        IngestAlerts(limit), ALERTS, "append", "EventTime")


class rocksdb_state:
    """Context manager: start stateful queries on the RocksDB state store (timers need it)."""

    KEY = "spark.sql.streaming.stateStore.providerClass"
    VALUE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, self.VALUE)
        return self

    def __exit__(self, *exc):
        self.spark.conf.set(self.KEY, self.old) if self.old else self.spark.conf.unset(self.KEY)
        return False
