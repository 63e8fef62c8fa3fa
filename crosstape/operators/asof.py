"""What was known on a day: visibility of late news, as-of lookups, bitemporal features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE_MINUTES = 15 * 60 + 30
# Two centuries.
MOST_DAYS = 73_000


def session_calendar(sessions: DataFrame) -> DataFrame:
    """Per calendar date: is it a session, and the first session on or after / strictly after it.

    One row per date of the span, so its size follows the calendar, not the data.
    """
    s = sessions.select(F.col("day").alias("session"))
    span = s.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    # One wrong date would make millions of rows, and the calendar is broadcast: refuse such a span.
    days = F.expr(f"if(datediff(hi, lo) <= {MOST_DAYS}, sequence(lo, hi, interval 1 day), cast(raise_error('sessions span over {MOST_DAYS} days') as array<date>))")
    cal = span.select(F.explode(days).alias("date"))
    cal = cal.join(s, F.col("date") == F.col("session"), "left")
    ahead = Window.partitionBy(F.lit(0)).orderBy("date")
    return cal.select(
        "date",
        F.col("session").isNotNull().alias("is_session"),
        F.min("session").over(ahead.rowsBetween(0, Window.unboundedFollowing)).alias("on_or_after"),
        F.min("session").over(ahead.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )


def with_visibility(rows: DataFrame, sessions: DataFrame, ts: str = "an_dt", keep_unknown: bool = False) -> DataFrame:
    """First session a timestamp could inform: the same one before 15:30, else the next.

    Rows after the last known session are dropped, or with ``keep_unknown`` kept without one. The late rule is an equality
    join on the date, so nothing is compared pairwise.
    """
    cal = session_calendar(sessions)
    lo = sessions.agg(F.min("day"))
    # A stream cannot hold a subquery; its calendar start is one value read up front.
    first = F.lit(lo.first()[0]) if rows.isStreaming else lo.scalar()
    minute = F.hour(ts) * 60 + F.minute(ts)
    d = rows.withColumn("_d", F.to_date(ts)).withColumn("_early", minute < CLOSE_MINUTES)
    # One calendar row per date: some thousands, whatever the feed; a busy date is not shuffled.
    out = d.join(F.broadcast(cal), F.col("_d") == F.col("date"), "left").withColumn("_first", first)
    vis = F.when(F.col("_d") < F.col("_first"), F.col("_first")).when(
        F.col("is_session") & F.col("_early"), F.col("_d")
    ).otherwise(F.col("after"))
    return (
        out.withColumn("visible_from", vis).filter(F.lit(keep_unknown) | F.col("visible_from").isNotNull())
        .drop("_d", "_early", "_first", "date", "is_session", "on_or_after", "after")
    )


def as_of(points: DataFrame, facts: DataFrame, by: list[str], at: str, known: str, tie: list[str], cols: list[str]) -> DataFrame:
    """Attach to each point the latest fact with known <= at, as columns ``cols``.

    Union and one ordered window per key: no pair of rows is ever formed. Both
    sides hold at most one row per key and date, so a key's partition is bounded
    by the calendar.
    """
    fact = facts.select(*by, F.col(known).alias("_at"), F.lit(0).alias("_side"), F.struct(*dict.fromkeys([*tie, known, *cols])).alias("_fact"))
    pt_cols = [c for c in points.columns if c not in by]
    pt = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*pt_cols).alias("_pt"))
    both = fact.unionByName(pt, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_side"), *[F.col(f"_fact.{t}") for t in tie]]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    return out.select(*by, "_pt.*", *[F.col(f"_last.{c}").alias(c) for c in cols])


def dedup_filings(rows: DataFrame) -> DataFrame:
    """One filing per quarter: consolidated first, then the earliest broadcast."""
    w = Window.partitionBy("symbol", "quarter_end").orderBy(F.col("consolidated").desc(), "visible_from")
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def filing_versions(filings: DataFrame) -> DataFrame:
    """Number filings by visibility and attach what the comparisons need, once per filing."""
    w = Window.partitionBy("symbol").orderBy("visible_from", "quarter_end")
    back = lambda c, k: F.lag(c, k).over(w)
    growth = F.when(back("revenue", 4) > 0, F.col("revenue") / F.nullif(back("revenue", 4), F.lit(0.0)) - 1.0)
    rows = filings.withColumn("fv", F.row_number().over(w)).withColumn("growth_yoy", growth)
    rows = rows.withColumn("growth_accel", F.col("growth_yoy") - F.lag("growth_yoy", 1).over(w))
    rel = lambda c: F.when(
        F.col("fv") >= 5, F.try_divide(F.col(c) - back(c, 4), F.abs(back(c, 4))) * 100
    )
    margin = F.try_divide(F.col("net_profit"), F.col("revenue")) * 100
    rows = rows.withColumn("_m", margin)
    rows = (
        rows.withColumn("rev_growth", rel("revenue")).withColumn("profit_growth", rel("net_profit"))
        .withColumn("margin", F.when(F.col("fv") >= 5, F.col("_m")))
        .withColumn("margin_change", F.when(F.col("fv") >= 5, F.col("_m") - F.lag("_m", 4).over(w)))
        .withColumn("revenue_1back", back("revenue", 1)).drop("_m")
    )
    # Upper median of this company's own publication lags so far; a few dozen quarters at most.
    lag = F.datediff("visible_from", "quarter_end")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lags = F.sort_array(F.collect_list(lag).over(run))
    mid = F.element_at(lags, F.floor(F.size(lags) / 2).cast("int") + 1)
    return rows.withColumn("next_expected", F.when(F.col("fv") >= 2, F.date_add("quarter_end", F.lit(91) + mid)))


def announcement_days(rows: DataFrame, tone: dict[str, int], flags: tuple[str, ...]) -> DataFrame:
    """Collapse announcements to one row per (symbol, visible day) with map-side combine.

    A symbol may hold any share of the feed; after this it holds one row per day.
    """
    cat = F.col("category")
    tone_of = None
    for k, v in tone.items():
        tone_of = F.when(cat == k, float(v)) if tone_of is None else tone_of.when(cat == k, float(v))
    rows = rows.withColumn("_tone", tone_of)
    first = F.min_by(F.col("_tone"), F.when(F.col("_tone").isNotNull(), F.struct("an_dt", "event_id")))
    return rows.groupBy("symbol", "visible_from").agg(
        F.count(F.lit(1)).alias("n"), F.max(cat.isin(*flags)).alias("flagged"), first.alias("tone")
    )


def announcement_features(points: DataFrame, days: DataFrame, window: int = 30, baseline: int = 365) -> DataFrame:
    """burst, tone and flag visible at each (symbol, day); NULL without any announcement in the year."""
    num = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    facts = days.select("symbol", num("visible_from").alias("_d"), "n", "flagged", "tone")
    pts = points.withColumn("_d", num("day")).withColumn("_q", F.lit(True))
    both = pts.unionByName(facts, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("_d")
    near, year = w.rangeBetween(-window, 0), w.rangeBetween(-baseline, 0)
    base = F.coalesce(F.sum("n").over(year), F.lit(0))
    recent = F.coalesce(F.sum("n").over(near), F.lit(0))
    rows = (
        both.withColumn("_base", base).withColumn("_recent", recent)
        .withColumn("_t", F.last("tone", ignorenulls=True).over(near)).withColumn("_f", F.max("flagged").over(near))
        .filter(F.col("_q"))
    )
    rate = F.col("_base") / baseline * window
    seen = F.col("_base") > 0
    return (
        rows.withColumn("ann_burst", F.when(seen, (F.col("_recent") - rate) / (rate + 1.0)))
        .withColumn("ann_tone", F.when(seen, F.coalesce("_t", F.lit(0.0))))
        .withColumn("ann_flag", F.when(seen, F.when(F.col("_f"), 1.0).otherwise(0.0)))
        .withColumnRenamed("_recent", "recent_n").withColumnRenamed("_base", "base_n")
        .drop("_d", "_q", "n", "flagged", "tone", "_t", "_f")
    )


def reconciled(fills: DataFrame, official: DataFrame, stop_pct: float = 10.0, target_pct: float = 20.0) -> DataFrame:
    """Provisional fills against the official open: corrected beyond half a cent, else confirmed.

    Levels are recomputed from the corrected price; fills without an official bar stay as they are.
    """
    o = official.select("symbol", F.col("day").alias("entry_day"), F.col("open").alias("official"))
    j = fills.join(o, ["symbol", "entry_day"], "left")
    off: Column = F.coalesce(F.abs(F.col("official") - F.col("entry_px")) > 0.005, F.lit(False)) & (F.col("official") != 0)
    px = F.when(off, F.col("official")).otherwise(F.col("entry_px"))
    return (
        j.withColumn("fill_source", F.when(F.col("official").isNull(), F.col("fill_source")).when(off, "reconciled").otherwise("confirmed"))
        .withColumn("stop", F.when(off, px * (1 - stop_pct / 100)).otherwise(F.col("stop")))
        .withColumn("target", F.when(off, px * (1 + target_pct / 100)).otherwise(F.col("target")))
        .withColumn("was", F.col("entry_px")).withColumn("entry_px", px)
    )
