"""Per-symbol indicators. Inputs are bars with ``symbol, day, ix`` and OHLCV columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fixed_frames, walks
from .frames import full, lag, let, series, trailing

RS_LOOKBACKS = (20, 60, 125, 250)


def sma(name: str, n: int) -> Column:
    return full(F.avg(name).over(trailing(-(n - 1))), n)


def rolling_max(name: str, n: int) -> Column:
    return full(F.max(name).over(trailing(-(n - 1))), n)


def rolling_min(name: str, n: int) -> Column:
    return full(F.min(name).over(trailing(-(n - 1))), n)


def true_range() -> Column:
    # greatest() skips NULL, which leaves the plain range on the first bar.
    bar = {"h": F.col("high"), "lo": F.col("low"), "prev": lag("close", 1)}
    return let(bar, lambda h, lo, prev: F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev)))


def zscore(name: str, n: int) -> Column:
    """Distance from the trailing mean in population deviations; a flat window is NULL.

    Flatness is read from min = max: a computed deviation of equal values may
    come out as a tiny non-zero number.
    """
    w = trailing(-(n - 1))
    flat = F.min(name).over(w) == F.max(name).over(w)
    z = (F.col(name) - F.avg(name).over(w)) / F.stddev_pop(name).over(w)
    return full(F.when(~flat, z), n)


def slope_up(name: str, k: int) -> Column:
    return F.col(name) > lag(name, k)


def bar_return(k: int, skip: int = 0) -> Column:
    """k-bar return ending ``skip`` bars back; NULL when the history is short."""
    end = lag("close", skip) if skip else F.col("close")
    return F.try_divide(end, lag("close", k + skip)) - 1.0


def positive_mean(name: str, n: int) -> Column:
    """Mean of the positive values among the last n bars, NULL when there is none.

    Rounded at 9 digits so that sums taken in another order rank equally.
    """
    return F.round(F.avg(F.when(F.col(name) > 0, F.col(name))).over(trailing(-(n - 1))), 9)


def median_of(v: str) -> Column:
    """Median of a sorted array column (bounded window contents), NULL when empty."""
    k = F.size(v)
    half = F.floor(k / 2).cast("int")
    upper = F.get(v, half)
    return F.when(k > 0, F.when(k % 2 == 1, upper).otherwise((F.get(v, half - 1) + upper) / 2))


def with_positive_median(df: DataFrame, name: str, n: int, out: str, count: str | None = None) -> DataFrame:
    """Median (and count) of the positive values among the last n bars.

    The window contents are sorted in one projection and read in the next: an
    expensive value used several times is not inlined.
    """
    df = df.withColumn("_v", F.sort_array(positive_list(name, n)))
    if count:
        df = df.withColumn(count, F.size("_v"))
    return df.withColumn(out, median_of("_v")).drop("_v")


def positive_list(name: str, n: int) -> Column:
    """The positive values of the last n bars as an array (never more than n)."""
    return F.collect_list(F.when(F.col(name) > 0, F.col(name))).over(trailing(-(n - 1)))


def high_gap_pct(n: int = 126) -> Column:
    """Percent below the highest high of the last n bars (0 = at the high)."""
    frame = {"top": F.max("high").over(trailing(-(n - 1))), "c": F.col("close")}
    return let(frame, lambda top, c: (top - c) / top * 100)


def daily_vol_pct(ret: str = "ret1") -> Column:
    """Population deviation of the last 21 one-bar returns, percent; NULL under 5 returns."""
    w = trailing(-20)
    return F.when(F.count(ret).over(w) >= 5, F.stddev_pop(ret).over(w) * 100)


def with_means(
    df: DataFrame, ema: dict[str, tuple[str, int]] | None = None, atr: dict[str, int] | None = None, rsi: dict[str, int] | None = None
) -> DataFrame:
    """Smoothed columns by name, all in one pass: exponential means of (column, bars), Wilder means of the range, RSI.

    y[i] = (1-alpha) y[i-1] + alpha value[i] from the seed on, NULL before. An exponential mean is seeded with the plain
    mean of the first n bars, a Wilder mean at bar n from the n values after bar 0. A symbol's bars are walked in their order.
    """
    ema, atr, rsi = ema or {}, atr or {}, rsi or {}
    step = F.col("close") - lag("close", 1)
    means = [(F.col(name), n, n - 1, 2.0 / (n + 1), out) for out, (name, n) in ema.items()]
    means += [(true_range(), n, n, 1.0 / n, out) for out, n in atr.items()]
    for out, n in rsi.items():
        means += [(F.greatest(step, F.lit(0.0)), n, n, 1.0 / n, f"_up_{out}"), (F.greatest(-step, F.lit(0.0)), n, n, 1.0 / n, f"_dn_{out}")]
    rows = df.withColumns({f"_x{k}": value.cast("double") for k, (value, *_) in enumerate(means)})
    seed = lambda k, n, at: F.when(F.col("ix") == at, F.avg(f"_x{k}").over(trailing(-(n - 1))))
    rows = rows.withColumns({f"_s{k}": seed(k, n, at) for k, (_, n, at, *_) in enumerate(means)})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{out}` double" for *_, out in means])
    walk = walks.walker([(f"_x{k}", f"_s{k}", at, alpha, out) for k, (_, _, at, alpha, out) in enumerate(means)])
    # The windows of the seeds leave a symbol's bars in one partition, side by side and in the order of their days.
    rows = rows.sortWithinPartitions("symbol", "day").mapInArrow(walk, schema).drop(*[f"_{c}{k}" for k in range(len(means)) for c in "xs"])
    for out in rsi:
        up, dn = F.col(f"_up_{out}"), F.col(f"_dn_{out}")
        # With no loss since the start the ratio is undefined and the index is 100.
        index = F.when(dn == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, dn)))
        rows = rows.withColumn(out, F.when(up.isNotNull(), index)).drop(f"_up_{out}", f"_dn_{out}")
    return rows


def with_ema(df: DataFrame, name: str, n: int, out: str) -> DataFrame:
    """Exponential mean seeded with the plain mean of the first n bars."""
    return with_means(df, ema={out: (name, n)})


def with_atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return with_means(df, atr={out: n})


def with_rsi(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    return with_means(df, rsi={out: n})


def with_features(bars: DataFrame) -> DataFrame:
    """All fixed-frame columns used by ranking, sizing, costs and ledgers.

    Lags and leads are windows; the frames of 21 to 251 bars are taken in arrays of whole symbols, with the values
    that ``with_positive_median``, ``positive_mean``, ``sma`` and ``daily_vol_pct`` give bar by bar.
    """
    rows = (
        bars.withColumn("ret1", bar_return(1))
        .withColumn("rs_raw", bar_return(125))
        .withColumn("ret63", bar_return(63))
        .withColumn("next_open", F.lead("open", 1).over(series()))
        .withColumn("next_day", F.lead("day", 1).over(series()))
    )
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [fixed_frames.FRAMES])
    top, c = F.col("top126"), F.col("close")
    # The windows above leave a symbol's bars in one partition, side by side and in the order of their days.
    return (
        rows.sortWithinPartitions("symbol", "day").mapInArrow(fixed_frames.feature_frames, schema)
        .withColumn("deliv_mean", F.round("deliv_avg", 9))
        .withColumn("off_high", (top - c) / top * 100)
        .withColumn("near_high", -F.col("off_high"))
        .withColumn("sma200", full(F.col("avg200"), 200))
        .withColumn("vol_pct", F.when(F.col("liq").isNotNull() & (F.col("vol_n") >= 5), F.col("vol_sd") * 100))
        .drop("deliv_avg", "top126", "avg200", "vol_n", "vol_sd")
    )


def with_entry_snapshot(features: DataFrame) -> DataFrame:
    """What was true at entry: six ledger features from bar 200 on. RSI is always unset."""
    ok = F.col("ix") >= 200
    return features.select(
        "symbol", "day", "ix",
        F.when(ok, F.col("ret63")).alias("rs"),
        F.when(ok, F.col("deliv_mean")).alias("deliv"),
        F.when(ok, F.col("liq")).alias("liq"),
        F.when(ok, F.col("off_high")).alias("off_high"),
        F.when(ok, F.col("near_high")).alias("near_high"),
        F.lit(None).cast("double").alias("rsi"),
    )
