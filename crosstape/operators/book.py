"""The paper order book as an append-only event table, and the reports read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs

LIVE = ("pending", "open")
# What a reader compares when two books hold the same trade.
SAME_TRADE = ("symbol", "entry_day", "queued_on", "entry_px", "qty", "stop", "target", "exit_day", "exit_px")


def current_state(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """Latest row per position id by sequence number; events after ``upto`` are not known yet."""
    if upto is not None:
        events = events.filter(F.col("at") <= upto)
    rest = [c for c in events.columns if c != "id"]
    return events.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_r")).select("id", "_r.*")


def view(state: DataFrame, status: str) -> DataFrame:
    """pending, open or closed orders; a void row is in none of them."""
    return state.filter(F.col("status") == status)


def replay_difference(live: DataFrame, events: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in one of the live table and the replayed log but not in the other; empty when equal."""
    back = current_state(events).select(*cols)
    here = live.select(*cols)
    return here.exceptAll(back).withColumn("only_in", F.lit("live")).unionByName(back.exceptAll(here).withColumn("only_in", F.lit("log")))


def live_spans(events: DataFrame) -> DataFrame:
    """One row per position: bucket, symbol, queued_on and ``until``, the day it was closed or withdrawn (NULL: never)."""
    ended = F.when(~F.col("status").isin(*LIVE), F.col("at"))
    return events.groupBy("id", "bucket", "symbol").agg(F.min("queued_on").alias("since"), F.min(ended).alias("until")).drop("id")


def queue(ranked: DataFrame, spans: DataFrame, room: int, order: list[Column], keys: tuple[str, ...] = ("day", "bucket")) -> DataFrame:
    """Names to queue: skip those that an earlier order holds live in the same bucket on that day, then
    take ``room`` of what is left. What happens to a position later is not known yet."""
    s = spans.select(F.col("bucket").alias("_b"), F.col("symbol").alias("_s"), "since", "until")
    held = (F.col("bucket") == F.col("_b")) & (F.col("symbol") == F.col("_s")) & (F.col("since") < F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    free = ranked.join(s, held, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    return free.withColumn("queue_no", F.row_number().over(w)).filter(F.col("queue_no") <= room)


def double_live(state: DataFrame) -> DataFrame:
    """Names live more than once in one bucket: must be empty."""
    return state.filter(F.col("status").isin(*LIVE)).groupBy("bucket", "symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def summary(state: DataFrame, by: tuple[str, ...] = ("bucket",), capital: float = costs.CAPITAL) -> DataFrame:
    """Counts per status, realised result and equity."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    net = F.sum(F.when(F.col("status") == "closed", F.coalesce("net", F.lit(0.0))).otherwise(0.0))
    return state.groupBy(*by).agg(n("pending"), n("open"), n("closed"), net.alias("realised"), (capital + net).alias("equity"))


def latest_close(bars: DataFrame, upto: Column) -> DataFrame:
    return bars.filter(F.col("day") <= upto).groupBy("symbol").agg(F.max_by("close", "day").alias("px"))


def wallet(state: DataFrame, prices: DataFrame, capital: float = costs.CAPITAL) -> DataFrame:
    """Cash, invested value at the last price and unrealised result per bucket.

    Cash left at the fill price, not at today's. Pending orders without a fill
    are reserved at the last price.
    """
    rows = state.join(prices, "symbol", "left").withColumn("px", F.coalesce("px", "entry_px", F.lit(0.0)))
    live, open_ = F.col("status").isin(*LIVE), (F.col("status") == "open") & F.col("entry_px").isNotNull()
    qty = F.coalesce("qty", F.lit(0))
    spent = F.sum(F.when(live, qty * F.coalesce("entry_px", "px")).otherwise(0.0))
    realised = F.sum(F.when(F.col("status") == "closed", F.coalesce("net", F.lit(0.0))).otherwise(0.0))
    return rows.groupBy("bucket").agg(
        (capital + realised - spent).alias("cash"), F.sum(F.when(live, qty * F.col("px")).otherwise(0.0)).alias("invested"),
        F.sum(F.when(open_, qty * (F.col("px") - F.col("entry_px"))).otherwise(0.0)).alias("unrealised"), realised.alias("realised"),
    )


def merged(state: DataFrame) -> DataFrame:
    """Positions identical in every number as one line with the list of buckets."""
    return state.groupBy(*SAME_TRADE).agg(F.array_join(F.array_sort(F.collect_set("bucket")), ",").alias("buckets"), F.count(F.lit(1)).alias("copies"))


def listed_twice(lines: DataFrame) -> DataFrame:
    """Symbols still on several lines after merging."""
    return lines.groupBy("symbol").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > 1)


def away_pct(px: Column, level: Column) -> Column:
    """Percent the price must move to reach a level; negative means it must fall."""
    return F.when((px != 0) & level.isNotNull(), (level / F.nullif(px, F.lit(0.0)) - 1) * 100).otherwise(F.lit(0.0))


def closed_summary(state: DataFrame, main: str = "main") -> DataFrame:
    """Per band and overall: trades, wins, hit rate and net of the main bucket's closed positions."""
    done = state.filter((F.col("status") == "closed") & (F.col("bucket") == main))
    return done.groupingSets([[], [F.col("band")]], F.col("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("net") > 0, 1).otherwise(0)).alias("won"),
        (F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)) * 100).alias("hit_rate"), F.sum("net").alias("net"),
    )


def gates(facts: DataFrame) -> DataFrame:
    """Gate name and verdict from sessions, gaps, closed, net; PENDING is not a soft PASS."""
    data = F.when((F.col("sessions") > 1000) & (F.col("gaps") == 0), "PASS").otherwise("GAPS")
    enough = F.when(F.col("closed") >= F.col("needed"), "PASS").otherwise("PENDING")
    paper = F.when(F.col("closed") == 0, "PENDING").otherwise("MEASURING")
    way = F.when(F.col("closed") < 30, "TOO EARLY TO SAY").when(F.col("net") > 0, "YES").otherwise("NO")
    cells = [("point-in-time data", data), ("enough trades to judge", enough), ("forward paper evidence", paper), ("direction", way)]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), v.alias("verdict")) for n, v in cells])).alias("_g")).select("_g.*")


def shortfall(cands: DataFrame, take: dict[str, int]) -> DataFrame:
    """Bands with fewer candidates than seats, per day that has any candidate."""
    n = lambda b: F.sum(F.when(F.col("band") == b, 1).otherwise(0))
    per = cands.groupBy("day").agg(*[n(b).alias(b) for b in take])
    cells = [F.struct(F.lit(b).alias("band"), F.col(b).alias("have"), F.lit(k).alias("need")) for b, k in take.items()]
    return per.select("day", F.explode(F.array(*cells)).alias("_c")).select("day", "_c.*").filter(F.col("have") < F.col("need"))


def assertions(counts: list[DataFrame]) -> DataFrame:
    """(rule, ok, violations) from frames of one row whose columns are named like rules and count their violations:
    rules over the same rows share one frame, and so one scan."""
    out = None
    for frame in counts:
        pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias("violations")) for c in frame.columns])
        rows = frame.select(F.inline(pairs)).select("rule", (F.col("violations") == 0).alias("ok"), "violations")
        out = rows if out is None else out.unionByName(rows)
    return out
