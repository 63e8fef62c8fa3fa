"""Visibility of announcements, as-of filings and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof
from ..sources import derived
from . import oracle as o
from .common import bars, sessions
from .selection_plans import ANN_FEATURES_CTE, announcement_points
from .spec import query


def visible_announcements(spark, sf):
    cal = sessions(spark, sf).filter(F.weekday("day") < 5)
    return asof.with_visibility(derived.announcements_raw(spark, sf), cal)


@query("visible_sessions", "H1 L4 A12", "event_id:i symbol:s an_dt:t category:s visible_from:d", o.sql("annv", "select * from annv where visible_from is not null"))
def visible_sessions(spark, sf):
    return visible_announcements(spark, sf)


@query(
    "announcement_months", "A13", "visible_month:s symbol:s n:i first_dt:t last_dt:t",
    o.sql("annv", "select strftime(visible_from, '%Y-%m') as visible_month, symbol, count(*) as n, min(an_dt) as first_dt, max(an_dt) as last_dt from annv where visible_from is not null group by 1, 2"),
)
def announcement_months(spark, sf):
    return by_month(visible_announcements(spark, sf))


def by_month(rows):
    rows = rows.withColumn("visible_month", F.date_format("visible_from", "yyyy-MM"))
    return rows.groupBy("visible_month", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("an_dt").alias("first_dt"), F.max("an_dt").alias("last_dt"))


@query(
    "latest_filing", "H2", "symbol:s day:d quarter_end:d visible_from:d revenue:f net_profit:f",
    o.sql("bars fil", "select b.symbol, b.day, f.quarter_end, f.visible_from, f.revenue, f.net_profit from bars b asof left join (select * from fil) f on b.symbol = f.symbol and b.day >= f.visible_from"),
)
def latest_filing(spark, sf):
    points = bars(spark, sf).select("symbol", "day")
    facts = derived.filings(spark, sf)
    return asof.as_of(points, facts, ["symbol"], "day", "visible_from", ["quarter_end"], ["quarter_end", "visible_from", "revenue", "net_profit"])


VERSIONS = """vr as materialized (select *, row_number() over w as fv, lag(revenue) over w as revenue_1back, lag(revenue, 4) over w as r4, lag(net_profit, 4) over w as p4,
  case when lag(revenue, 4) over w > 0 then revenue / lag(revenue, 4) over w - 1e0 end as growth_yoy, date_diff('day', quarter_end, visible_from) as lagd,
  list(date_diff('day', quarter_end, visible_from)) over (partition by symbol order by visible_from, quarter_end rows between unbounded preceding and current row) as lags
  from fil window w as (partition by symbol order by visible_from, quarter_end)),
vs as materialized (select *, growth_yoy - lag(growth_yoy) over (partition by symbol order by visible_from, quarter_end) as growth_accel,
  case when fv >= 5 then (revenue - r4) / nullif(abs(r4), 0) * 100 end as rev_growth, case when fv >= 5 then (net_profit - p4) / nullif(abs(p4), 0) * 100 end as profit_growth,
  case when fv >= 5 then net_profit / nullif(revenue, 0) * 100 end as margin,
  case when fv >= 5 then net_profit / nullif(revenue, 0) * 100 - p4 / nullif(r4, 0) * 100 end as margin_change,
  case when fv >= 2 then quarter_end + cast(91 + list_sort(lags)[len(lags) // 2 + 1] as int) end as next_expected from vr)"""


@query(
    "filing_versions", "H3 H4 H5 H6", "symbol:s quarter_end:d fv:i revenue_1back:f growth_yoy:f growth_accel:f rev_growth:f profit_growth:f margin:f margin_change:f next_expected:d",
    o.sql("fil", "select * from vs", VERSIONS),
)
def filing_versions(spark, sf):
    return asof.filing_versions(derived.filings(spark, sf))


FEATURES = ["revenue_1back", "growth_yoy", "growth_accel", "rev_growth", "profit_growth", "margin", "margin_change", "next_expected"]


@query(
    "filing_features", "H3 H4 H5 H6", "symbol:s day:d revenue_1back:f growth_yoy:f growth_accel:f rev_growth:f profit_growth:f margin:f margin_change:f next_expected:d",
    o.sql("bars fil", f"select b.symbol, b.day, {', '.join('f.' + c for c in FEATURES)} from bars b asof left join (select * from vs) f on b.symbol = f.symbol and b.day >= f.visible_from", VERSIONS),
)
def filing_features(spark, sf):
    facts = asof.filing_versions(derived.filings(spark, sf))
    return asof.as_of(bars(spark, sf).select("symbol", "day"), facts, ["symbol"], "day", "visible_from", ["quarter_end"], FEATURES)


@query(
    "filing_dedup", "A14", "symbol:s quarter_end:d visible_from:d consolidated:b revenue:f",
    o.sql(
        "fil",
        "select * from (select *, row_number() over (partition by symbol, quarter_end order by consolidated desc, visible_from) as k from both_) where k = 1",
        """both_ as materialized (select symbol, quarter_end, visible_from, revenue, false as consolidated from fil
           union all select symbol, quarter_end, visible_from + 3, revenue * 1.1e0, true from fil where month(quarter_end) in (3, 9)
           union all select symbol, quarter_end, visible_from + 9, revenue * 1.2e0, true from fil where month(quarter_end) = 3)""",
    ),
)
def filing_dedup(spark, sf):
    f = derived.filings(spark, sf).select("symbol", "quarter_end", "visible_from", "revenue")
    late = f.filter(F.month("quarter_end").isin(3, 9)).select("symbol", "quarter_end", F.date_add("visible_from", 3).alias("visible_from"), (F.col("revenue") * 1.1).alias("revenue"))
    again = f.filter(F.month("quarter_end") == 3).select("symbol", "quarter_end", F.date_add("visible_from", 9).alias("visible_from"), (F.col("revenue") * 1.2).alias("revenue"))
    rows = f.withColumn("consolidated", F.lit(False)).unionByName(late.withColumn("consolidated", F.lit(True))).unionByName(again.withColumn("consolidated", F.lit(True)))
    return asof.dedup_filings(rows)


@query(
    "announcement_features", "H7", "symbol:s day:d recent_n:i base_n:i ann_burst:f ann_tone:f ann_flag:f",
    o.sql("bars annv", "select * from annx", ANN_FEATURES_CTE),
)
def announcement_features(spark, sf):
    return announcement_points(spark, sf, bars(spark, sf).select("symbol", "day"))


@query(
    "sliding_announcement_counts", "L6", "window_start:d symbol:s n:i",
    o.sql(
        "annv",
        """select cast(d as date) as window_start, symbol, count(*) as n from (
             select symbol, unnest(generate_series(visible_from::timestamp - interval 29 day, visible_from::timestamp, interval 1 day)) as d from annv where visible_from is not null) group by 1, 2""",
    ),
)
def sliding_announcement_counts(spark, sf):
    rows = visible_announcements(spark, sf).withColumn("ts", F.col("visible_from").cast("timestamp"))
    # A day's announcements collapse to one row before the 30-fold window expansion.
    daily = rows.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("k"))
    win = daily.groupBy(F.window("ts", "30 days", "1 day"), "symbol").agg(F.sum("k").alias("n"))
    return win.select(F.col("window.start").cast("date").alias("window_start"), "symbol", "n")
