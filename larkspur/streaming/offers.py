"""Offer states over streams: change events by offer with state, and windowed figures with late data."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.history import EPSILON

EVENTS = "offer_id string, ts timestamp, unit double, event string, since timestamp"
STATE = "unit double, since timestamp, in_stock boolean, ts timestamp"
#: Days of event time after which the state of an offer that isn't seen again goes.
RETENTION_DAYS = 180


def _change(held: tuple | None, ts: Any, unit: float, stock: bool | None) -> tuple[str, Any]:
    """The event of a row after the held one (unit, since, in_stock, ts), and since when its price holds."""
    if held is None:
        event, since = "new offer", ts
    elif abs(unit - held[0]) < EPSILON:
        event, since = "unchanged", held[1]
    else:
        event, since = ("price drop" if unit < held[0] else "price increase"), ts
    if held is not None and held[2] is False and stock is not False:
        event += "; back in stock"
    return event, since


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    rows = []
    for pdf in frames:
        for ts, unit, stock in pdf.sort_values(["ts", "unit"])[["ts", "unit", "in_stock"]].itertuples(index=False):
            stock = None if pd.isna(stock) else bool(stock)
            if held is not None and ts <= held[3]:
                continue  # a replay
            event, since = _change(held, ts, unit, stock)
            held = (unit, since, stock, ts)
            rows.append((key[0], ts, unit, event, since))
    if held is not None:
        state.update(held)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(held[3]).timestamp() * 1000) + RETENTION_DAYS * 86_400_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["offer_id", "ts", "unit", "event", "since"])


def offer_events(observations: DataFrame, late: str = "2 days") -> DataFrame:
    """Change events of a stream of observations (offer_id, ts, unit, in_stock); times up to an offer's last are replays and ignored, as are rows later than `late`.

    Null units are dropped. An offer's state goes RETENTION_DAYS of event time after it was last seen.
    """
    seen = observations.where("unit is not null and ts is not null").select("offer_id", "ts", "unit", "in_stock").withWatermark("ts", late)
    return seen.groupBy("offer_id").applyInPandasWithState(_fold, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: The state store that typed state and timers need.
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGES = "offer_id string, ts long, unit double, event string, since long"


class OfferChanges(StatefulProcessor):
    """Folds an offer's rows in the order of their times: a row waits in the state until the watermark has passed it, so rows that arrive in another order, within the bound on lateness, change nothing.

    Times are microseconds. An offer has one timer, for its earliest waiting row or
    else for the end of its retention, so each batch reads a key's rows once.
    """

    def __init__(self, retention_days: int) -> None:
        self.retention = retention_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "unit double, since long, in_stock boolean, ts long")
        self.waiting = handle.getMapState("waiting", "ts long", "unit double, in_stock boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        if (old := self.timer.get()) is not None:
            if old[0] == at:
                return
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for unit, since, stock, ts in initialState.sort_values("ts")[["unit", "since", "in_stock", "ts"]].itertuples(index=False):
            self.last.update((float(unit), int(since), None if pd.isna(stock) else bool(stock), int(ts)))
            self._wake(self._end(self.last.get()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, first, old = self.last.get(), None, self.timer.get()
        for pdf in rows:
            pdf = pdf if last is None else pdf[pdf["us"] > last[3]]
            for ts, unit, stock in pdf.sort_values(["us", "unit"]).drop_duplicates("us")[["us", "unit", "in_stock"]].itertuples(index=False):
                row = (float(unit), None if pd.isna(stock) else bool(stock))
                known = self.waiting.getValue((int(ts),))
                if known is None or row[0] < known[0]:
                    self.waiting.updateValue((int(ts),), row)
                first = int(ts) if first is None else min(first, int(ts))
        if first is not None and (old is None or self.passed(first) < old[0]):
            self._wake(self.passed(first))
        yield from ()

    @staticmethod
    def passed(ts: int) -> int:
        """The first millisecond at which the watermark has passed a time."""
        return -(-ts // 1000)

    def _end(self, last: tuple) -> int:
        return self.passed(last[3]) + self.retention

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark, last, rows = timerValues.getCurrentWatermarkInMs(), self.last.get(), []
        self.timer.clear()
        waiting = sorted((k[0], *v) for k, v in self.waiting.iterator())
        due = [w for w in waiting if self.passed(w[0]) <= mark]
        forgotten = lambda: (key[0], last[3], last[0], "forgotten", last[1])
        for ts, unit, stock in due:
            if last is not None and ts >= last[3] + self.retention * 1000:
                rows.append(forgotten())
                last = None
            event, since = _change(last, ts, unit, stock)
            last = (unit, since, stock, ts)
            rows.append((key[0], ts, unit, event, since))
            self.waiting.removeKey((ts,))
        if last is not None and self._end(last) <= mark:
            rows.append(forgotten())
            last = None
        if last is None:
            self.last.clear()
        elif due:
            self.last.update(last)
        if wakes := [self.passed(w[0]) for w in waiting[len(due) : len(due) + 1]] + ([self._end(last)] if last is not None else []):
            self._wake(min(wakes))
        if rows:
            yield pd.DataFrame(rows, columns=["offer_id", "ts", "unit", "event", "since"])

    def close(self) -> None:
        pass


def offer_changes(observations: DataFrame, late: str = "2 days", retention_days: int = RETENTION_DAYS, known: DataFrame | None = None) -> DataFrame:
    """offer_events by typed state and timers, in the order of times: each row is answered when the watermark, `late` behind the newest row, has passed it.

    Of rows of one offer and time the lowest unit counts; times up to an offer's last
    answered one are replays and ignored, as are rows later than `late`; rows with a
    null offer, time or unit go. An offer that isn't seen for retention_days of event
    time gives a last row, "forgotten", with its last time and price, and is new when
    it comes again. known (offer_id, ts, unit, since, in_stock) are states to begin
    with. Needs the RocksDB state store.
    """
    spark = observations.sparkSession
    if spark.conf.get(STORE) != PROVIDER:
        raise ValueError(f"offer_changes needs {STORE} = {PROVIDER}")
    seen = observations.where("offer_id is not null and unit is not null and ts is not null").select("offer_id", "ts", F.unix_micros("ts").alias("us"), "unit", "in_stock").withWatermark("ts", late)
    begin = None
    if known is not None:
        begin = known.select("offer_id", "unit", F.unix_micros("since").alias("since"), "in_stock", F.unix_micros("ts").alias("ts")).groupBy("offer_id")
    out = seen.groupBy("offer_id").transformWithStateInPandas(OfferChanges(retention_days), _CHANGES, "append", "EventTime", begin)
    return out.select("offer_id", F.timestamp_micros("ts").alias("ts"), "unit", "event", F.timestamp_micros("since").alias("since"))


def price_windows(observations: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, end, wid, n, lowest, highest) by tumbling windows; rows later than `late` are dropped."""
    w = observations.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "wid")
    return w.agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("lowest"), F.max("unit").alias("highest")).select("w.start", "w.end", "wid", "n", "lowest", "highest")
