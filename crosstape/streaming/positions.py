"""Paper positions over a stream of orders and bars: pending, open, closed, one event per change."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import costs

INPUT = "bucket string, symbol string, day date, kind string, qty long, open double, high double, low double, close double"
EVENTS = "bucket string, symbol string, status string, at date, queued_on date, entry_day date, entry_px double, qty long, stop double, target double, exit_px double, exit_reason string"
STATE = "status string, queued_on date, qty long, entry_day date, entry_px double, held int, seen date"
_READ = ("day", "kind", "qty", "open", "high", "low", "close")
_DAY_KIND = itemgetter(0, 1)
_Row = namedtuple("_Row", _READ)
_WRITTEN = [c.split()[0] for c in EVENTS.split(", ")]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PositionMachine(StatefulProcessor):
    """One live position per (bucket, symbol).

    An order fills at the open of the first later bar; levels hang off that fill.
    From the bar after the fill: stop, else target, else time. An order for a
    live name is skipped; after an exit the name may be queued again. A row older
    than a bar already applied gives a ``late`` event with its kind as the reason.
    State is one row per bucket and name ever seen. It has no lifetime: that needs processing time, under which a
    query that takes what is there never ends.
    """

    def __init__(self, stop_pct: float = costs.STOP_PCT, target_pct: float = costs.TARGET_PCT, hold: int = costs.HOLD_DAYS):
        self.stop_pct, self.target_pct, self.hold = stop_pct, target_pct, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket, symbol = key
        # One bar and at most a few orders per session: bounded by the calendar.
        # A day's bar comes before the orders queued after its close. Plain lists: frames cost more than the few rows of a name.
        todo = sorted((r for part in rows for r in zip(*[part[c].tolist() for c in _READ], strict=True)), key=_DAY_KIND)
        status, queued, qty, entry_day, entry_px, held, seen = self.position.get() or (None,) * 7
        out = []

        def emit(state, day, px=None, why=None):
            filled = entry_px is not None
            out.append((
                bucket, symbol, state, day, queued, entry_day, entry_px, qty, entry_px * (1 - self.stop_pct / 100) if filled else None,
                entry_px * (1 + self.target_pct / 100) if filled else None, px, why,
            ))

        for r in map(_Row._make, todo):
            if seen is not None and r.day < seen:
                # Later bars were applied before this row came: it leaves a record, and a bar is not applied.
                emit("late", r.day, why=r.kind)
            if r.kind == "order":
                if status is None:
                    status, queued, qty, entry_day, entry_px, held = "pending", r.day, int(r.qty), None, None, 0
                    emit("pending", r.day)
                continue
            if seen is not None and r.day <= seen:
                continue  # a bar already applied
            seen = r.day
            if status == "pending" and r.day > queued and r.open > 0:
                status, entry_day, entry_px, held = "open", r.day, float(r.open), 0
                emit("open", r.day)
            elif status == "open" and r.day > entry_day:
                held += 1
                stop, target = entry_px * (1 - self.stop_pct / 100), entry_px * (1 + self.target_pct / 100)
                if r.low <= stop:
                    px, why = min(stop, r.open), "stop"
                elif r.high >= target:
                    px, why = max(target, r.open), "target"
                elif held >= self.hold:
                    px, why = r.close, "time"
                else:
                    continue
                emit("closed", r.day, float(px), why)
                status = queued = qty = entry_day = entry_px = held = None
        self.position.update((status, queued, qty, entry_day, entry_px, held, seen))
        if out:
            yield pd.DataFrame(out, columns=_WRITTEN)

    def close(self) -> None:
        pass


def position_events(feed: DataFrame, **rules) -> DataFrame:
    """Status events from a streaming feed of orders and bars (columns of INPUT)."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return feed.groupBy("bucket", "symbol").transformWithStateInPandas(PositionMachine(**rules), EVENTS, "append", "none")


def run_available(events: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> None:
    """Process what is there, append the events, stop. Restarts continue from the checkpoint.

    ``partitions`` is for state of few keys, and for more of them than the session's partitions hold: every state partition
    starts a worker and commits its store in every micro-batch, also without a key. A query copies the session's settings
    when it starts.
    """
    conf = events.sparkSession.conf
    usual = conf.get("spark.sql.shuffle.partitions")
    if partitions is not None:
        conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        q = events.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)
    try:
        q.awaitTermination()
    finally:
        q.stop()
