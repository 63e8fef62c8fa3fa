"""Per-symbol indicators and entry triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.frames import trailing
from ..functions.triggers import TRIGGERS
from ..operators import ranking
from . import oracle as o
from .common import bars, fresh_features
from .spec import query

S = o.S


@query("sma20", "C1", "symbol:s day:d sma20:f", o.sql("bars", f"select symbol, day, {o.full(f'avg(close) over {o.win(-19)}', 20)} as sma20 from bars"))
def sma20(spark, sf):
    return bars(spark, sf).withColumn("sma20", ind.sma("close", 20))


@query("ema20", "C2", "symbol:s day:d ema20:f", o.sql("ema20", "select b.symbol, b.day, e.y as ema20 from bars b left join ema20 e using (symbol, ix)"))
def ema20(spark, sf):
    return ind.with_ema(bars(spark, sf), "close", 20, "ema20")


@query("true_range", "C3", "symbol:s day:d tr:f", o.sql("bars", f"select symbol, day, {o.TR} as tr from bars"))
def true_range(spark, sf):
    return bars(spark, sf).withColumn("tr", ind.true_range())


@query("atr14", "C4 C15", "symbol:s day:d atr14:f", o.sql("atr14", "select b.symbol, b.day, e.y as atr14 from bars b left join atr14 e using (symbol, ix)"))
def atr14(spark, sf):
    return ind.with_atr(bars(spark, sf), 14, "atr14")


@query(
    "rolling_extremes", "C5", "symbol:s day:d top20:f low20:f",
    o.sql("bars", f"select symbol, day, {o.full(f'max(high) over {o.win(-19)}', 20)} as top20, {o.full(f'min(low) over {o.win(-19)}', 20)} as low20 from bars"),
)
def rolling_extremes(spark, sf):
    return bars(spark, sf).withColumn("top20", ind.rolling_max("high", 20)).withColumn("low20", ind.rolling_min("low", 20))


@query(
    "zscore20", "C6", "symbol:s day:d z:f",
    o.sql(
        "bars",
        f"select symbol, day, {o.full(f'case when min(close) over {o.win(-19)} <> max(close) over {o.win(-19)} then (close - avg(close) over {o.win(-19)}) / stddev_pop(close) over {o.win(-19)} end', 20)} as z from bars",
    ),
)
def zscore20(spark, sf):
    return bars(spark, sf).withColumn("z", ind.zscore("close", 20))


@query("rsi14", "C7", "symbol:s day:d rsi14:f", o.sql("bars rsi14", "select b.symbol, b.day, e.y as rsi14 from bars b left join rsi14 e using (symbol, ix)"))
def rsi14(spark, sf):
    return ind.with_rsi(bars(spark, sf), 14, "rsi14")


@query("slope_up10", "C8", "symbol:s day:d up:b", o.sql("bars", f"select symbol, day, close > lag(close, 10) over ({S}) as up from bars"))
def slope_up10(spark, sf):
    return bars(spark, sf).withColumn("up", ind.slope_up("close", 10))


@query(
    "bar_returns", "C9", "symbol:s day:d r20:f r60:f r125:f r250:f",
    o.sql("bars", "select symbol, day, " + ", ".join(f"close / lag(close, {k}) over ({S}) - 1e0 as r{k}" for k in (20, 60, 125, 250)) + " from bars"),
)
def bar_returns(spark, sf):
    return bars(spark, sf).select("symbol", "day", *[ind.bar_return(k).alias(f"r{k}") for k in (20, 60, 125, 250)])


@query(
    "momentum_skip_month", "C10", "symbol:s day:d mom:f",
    o.sql("bars", f"select symbol, day, lag(close, 21) over ({S}) / lag(close, 146) over ({S}) - 1e0 as mom from bars"),
)
def momentum_skip_month(spark, sf):
    return bars(spark, sf).select("symbol", "day", ind.bar_return(125, 21).alias("mom"))


@query("delivery_mean", "C11", "symbol:s day:d deliv:f", o.sql("feat", "select symbol, day, coalesce(deliv_mean, 0e0) as deliv from feat"))
def delivery_mean(spark, sf):
    return fresh_features(spark, sf).select("symbol", "day", F.coalesce("deliv_mean", F.lit(0.0)).alias("deliv"))


@query("median_turnover", "C12", "symbol:s day:d liq:f", o.sql("feat", "select symbol, day, coalesce(liq, 0e0) as liq from feat"))
def median_turnover(spark, sf):
    return fresh_features(spark, sf).select("symbol", "day", F.coalesce("liq", F.lit(0.0)).alias("liq"))


@query("high_distance", "C13", "symbol:s day:d near_high:f off_high:f", o.sql("feat", "select symbol, day, near_high, off_high from feat"))
def high_distance(spark, sf):
    return fresh_features(spark, sf)


@query("daily_volatility", "C14", "symbol:s day:d vol_pct:f", o.sql("feat", "select symbol, day, vol_pct from feat"))
def daily_volatility(spark, sf):
    return fresh_features(spark, sf)


@query(
    "entry_snapshot", "C16", "symbol:s day:d rs:f deliv:f liq:f off_high:f near_high:f rsi:f",
    o.sql(
        "feat",
        "select symbol, day, "
        + ", ".join(f"case when ix >= 200 then {e} end as {n}" for n, e in [("rs", "ret63"), ("deliv", "deliv_mean"), ("liq", "liq"), ("off_high", "off_high"), ("near_high", "near_high")])
        + ", cast(null as double) as rsi from feat",
    ),
)
def entry_snapshot(spark, sf):
    return ind.with_entry_snapshot(fresh_features(spark, sf))


@query(
    "relative_strength", "D1", "symbol:s day:d rs_20:f rs_60:f rs_125:f rs_250:f",
    o.sql(
        "bars",
        "select symbol, day, "
        + ", ".join(
            f"case when r{k} is not null then row_number() over (partition by day, r{k} is not null order by r{k}, symbol) "
            f"/ count(*) over (partition by day, r{k} is not null) * 100e0 end as rs_{k}" for k in (20, 60, 125, 250)
        )
        + " from r",
        "r as materialized (select symbol, day, " + ", ".join(f"close / lag(close, {k}) over ({S}) - 1e0 as r{k}" for k in (20, 60, 125, 250)) + " from bars)",
    ),
)
def relative_strength(spark, sf):
    return ranking.relative_strength(bars(spark, sf), ind.RS_LOOKBACKS)


@query(
    "breadth50", "D2", "day:d breadth:f n:i",
    o.sql("ema50", "select b.day, avg(case when b.close > e.y then 1e0 else 0e0 end) as breadth, count(*) as n from bars b join ema50 e using (symbol, ix) group by b.day"),
)
def breadth50(spark, sf):
    return ranking.breadth(ind.with_ema(bars(spark, sf), "close", 50, "ema50"))


@query(
    "triggers_plain", "E1 E2 E3 E7 B1", "symbol:s day:d none:b volume_up:b breakout:b vol_breakout:b locked:b",
    o.sql(
        "bars",
        f"select symbol, day, true as none, {o.VOLUME} as volume_up, {o.BREAKOUT} as breakout, {o.VOLUME} and {o.BREAKOUT} as vol_breakout, high = low as locked from bars",
    ),
)
def triggers_plain(spark, sf):
    return bars(spark, sf).select(
        "symbol", "day", TRIGGERS["none"]().alias("none"), TRIGGERS["volume"]().alias("volume_up"),
        TRIGGERS["breakout"]().alias("breakout"), TRIGGERS["vol+breakout"]().alias("vol_breakout"), (F.col("high") == F.col("low")).alias("locked"),
    )


@query(
    "triggers_smoothed", "E4 E5 E6", "symbol:s day:d not_overbought:b rsi_band:b pullback:b",
    o.sql(
        "ema20 rsi14",
        """select b.symbol, b.day, coalesce(r.y < 75, false) as not_overbought, coalesce(r.y between 50 and 70, false) as rsi_band,
           coalesce((b.close - e.y) / e.y between 0 and 0.04e0, false) as pullback
           from bars b left join rsi14 r using (symbol, ix) left join ema20 e using (symbol, ix)""",
    ),
)
def triggers_smoothed(spark, sf):
    rows = ind.with_means(bars(spark, sf), ema={"ema20": ("close", 20)}, rsi={"rsi14": 14})
    return rows.select("symbol", "day", *[TRIGGERS[t]().alias(t) for t in ("not_overbought", "rsi_band", "pullback")])


@query(
    "chart_patterns", "E8 E9 E10 E11", "symbol:s day:d flag:b asc_triangle:b cup_handle:b pattern:b",
    o.sql(
        "bars",
        "select *, flag or asc_triangle or cup_handle as pattern from x",
        f"x as (select symbol, day, {o.FLAG} as flag, {o.TRIANGLE} as asc_triangle, {o.CUP} as cup_handle from bars)",
    ),
)
def chart_patterns(spark, sf):
    return bars(spark, sf).select("symbol", "day", *[TRIGGERS[t]().alias(t) for t in ("flag", "asc_triangle", "cup_handle", "pattern")])


@query(
    "trigger_firing_rate", "E12", "trig:s n:i fired:i rate:f",
    o.sql(
        "bars",
        " union all ".join(
            f"select '{n}' as trig, count(*) as n, sum(cast({n.replace('+', '_')} as int)) as fired, avg(cast({n.replace('+', '_')} as int)) as rate from y"
            for n in ("volume", "breakout", "vol+breakout", "flag", "asc_triangle", "cup_handle")
        ),
        f"""y as materialized (select {o.VOLUME} as volume, {o.BREAKOUT} as breakout, {o.VOLUME} and {o.BREAKOUT} as vol_breakout,
            {o.FLAG} as flag, {o.TRIANGLE} as asc_triangle, {o.CUP} as cup_handle from bars)""",
    ),
)
def trigger_firing_rate(spark, sf):
    names = ("volume", "breakout", "vol+breakout", "flag", "asc_triangle", "cup_handle")
    fired = bars(spark, sf).select(*[TRIGGERS[n]().cast("int").alias(n) for n in names])
    # One partial aggregate over all triggers at once; only its single row is unpivoted.
    one = fired.agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in names], F.count(F.lit(1)).alias("n"))
    return one.unpivot(["n"], [F.col(f"`{n}`") for n in names], "trig", "fired").withColumn("rate", F.col("fired") / F.col("n"))


@query(
    "max_one_day_gain", "B4", "symbol:s day:d max_ret21:f",
    o.sql("feat", "select symbol, day, max_ret21 from feat"),
)
def max_one_day_gain(spark, sf):
    return bars(spark, sf).withColumn("ret1", ind.bar_return(1)).withColumn("max_ret21", F.max("ret1").over(trailing(-20)))
