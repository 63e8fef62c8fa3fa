"""Queue orders over a stream: each bucket's free places go to the best candidates that it does not hold."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .positions import STATE_STORE

#: kind: candidate (with its place in the day's ranked list), live (an order was queued that day), ended (it was closed
#: or withdrawn that day). A row of another kind only moves the clock.
INPUT = "bucket string, day date, kind string, symbol string, place int"
QUEUED = "bucket string, day date, symbol string, queue_no int"
DAY_MS = 86_400_000
_COLUMNS = [c.split()[0] for c in QUEUED.split(", ")]


class QueueMachine(StatefulProcessor):
    """State of a bucket: how many live orders each name has, and the rows of days that are not complete.

    A day is worked off when the watermark has passed it, so it does not matter how its rows are dealt over
    micro-batches: first its ended orders leave, then its candidates are queued in the order of their
    places until the room is taken, skipping held names (a skipped name takes no room), then its new
    orders count as live. What is live comes from the order book's own events: queued rows come back as such.
    State is bounded by the names live at once and by the rows of the days within the watermark's delay.
    """

    def __init__(self, room: int = 5):
        self.room = room

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "symbol string", "n int")
        self.waiting = handle.getListState("waiting", "day date, kind string, symbol string, place int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows))
        kept = todo[todo["kind"].isin(["candidate", "live", "ended"])]
        place = [None if pd.isna(p) else int(p) for p in kept["place"]]
        self.waiting.appendList(list(zip(kept["day"], kept["kind"], kept["symbol"], place, strict=True))) if len(kept) else None
        if len(kept):
            # One timer for each batch: earlier days are complete before the last one is.
            self.handle.registerTimer((max(kept["day"]) - date(1970, 1, 1)).days * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = date(1970, 1, 1) + timedelta(days=timerValues.getCurrentWatermarkInMs() // DAY_MS)
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        days: dict[date, list[tuple]] = {}
        for r in rows:
            days.setdefault(r[0], []).append(r)
        due = sorted(d for d in days if d <= upto)
        if not due:
            return
        rest = [r for r in rows if r[0] > upto]
        self.waiting.put(rest) if rest else self.waiting.clear()
        held = {k[0]: v[0] for k, v in self.live.iterator()}
        before, out = dict(held), []
        for day in due:
            for _, _, symbol, _ in (r for r in days[day] if r[1] == "ended"):
                held[symbol] = held.get(symbol, 0) - 1
            n = 0
            for _, _, symbol, _ in sorted((r for r in days[day] if r[1] == "candidate"), key=lambda r: r[3]):
                if n == self.room:
                    break
                if held.get(symbol, 0) <= 0:
                    n += 1
                    out.append((key[0], day, symbol, n))
            for _, _, symbol, _ in (r for r in days[day] if r[1] == "live"):
                held[symbol] = held.get(symbol, 0) + 1
        for symbol, n in held.items():
            if n > 0 and n != before.get(symbol):
                self.live.updateValue((symbol,), (n,))
            elif n <= 0 and symbol in before:
                self.live.removeKey((symbol,))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def queued_orders(feed: DataFrame, room: int = 5, delay: str = "1 day") -> DataFrame:
    """bucket, day, symbol, queue_no from a streaming feed (columns of INPUT). Rows that come later than ``delay``
    after their day are dropped by the watermark."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = feed.withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("bucket").transformWithStateInPandas(QueueMachine(room), QUEUED, "append", "eventTime")
