"""Label signals with what happened next: barriers, ladders, moved stops, structural holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.frames import series

# Three clocks: (first bar the barriers are read, bar of the time exit - hold,
# whether a path that ends early still closes at its last bar).
LABEL = dict(first=1, late=0, close_short=True)
BACKTEST = dict(first=1, late=1, close_short=False)
PAPER = dict(first=2, late=1, close_short=False)


def with_path(bars: DataFrame, reach: int, extra: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
    """Attach the next ``reach`` bars as a bounded array; no join is needed to look forward.

    With ``only`` the array is made for those bars alone, the others get NULL.
    """
    bar = F.struct("ix", "day", "open", "high", "low", "close", *extra)
    if only is None:
        return bars.withColumn("path", F.collect_list(bar).over(series().rowsBetween(1, reach)))
    names = [f"_next{k}" for k in range(1, reach + 1)]
    ahead = bars.withColumn("_bar", bar).withColumns({n: F.lead("_bar", k).over(series()) for k, n in enumerate(names, 1)})
    return ahead.withColumn("path", F.when(only, F.array_compact(F.array(*names)))).drop("_bar", *names)


def barrier(
    signals: DataFrame,
    stop: Column | float = costs.STOP_PCT,
    target: Column | float = costs.TARGET_PCT,
    hold: Column | int = costs.HOLD_DAYS,
    clock: dict = LABEL,
    stop_px: Column | None = None,
) -> DataFrame:
    """First touch of stop, else target, else the close at the time exit.

    Entry is the next bar's open. On a bar that touches both, the stop is read
    first. Adds entry_day, entry_px, exit_ix, exit_day, exit_px, why, ret.
    ``stop_px`` replaces the percentage stop by a price level.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    hold = hold if isinstance(hold, Column) else F.lit(int(hold))
    first, late = clock["first"], clock["late"]
    rows = (
        signals.filter((F.size("path") > 0) & (F.get("path", F.lit(0))["open"] > 0))
        .withColumn("entry_px", F.get("path", F.lit(0))["open"])
        .withColumn("entry_day", F.get("path", F.lit(0))["day"])
        .withColumn("stop_px", stop_px if stop_px is not None else F.col("entry_px") * (1 - as_col(stop) / 100))
        .withColumn("target_px", F.col("entry_px") * (1 + as_col(target) / 100))
        .withColumn("_end", hold + F.lit(late))
    )
    if stop_px is not None:
        rows = rows.filter(F.col("stop_px") > 0)
    scan = F.slice("path", F.lit(first), F.greatest(F.col("_end") - (first - 1), F.lit(0)))
    touch = F.filter(scan, lambda b: (b["low"] <= F.col("stop_px")) | (b["high"] >= F.col("target_px")))
    rows = rows.withColumn("_t", F.get(touch, F.lit(0)))
    last = F.get("path", F.least(F.col("_end"), F.size("path")) - 1)
    if not clock["close_short"]:
        rows = rows.filter(F.col("_t").isNotNull() | (F.size("path") >= F.col("_end")))
    stopped = F.col("_t.low") <= F.col("stop_px")
    rows = (
        rows.withColumn("_x", F.coalesce(F.col("_t"), last))
        .withColumn("why", F.when(F.col("_t").isNull(), "time").when(stopped, "stop").otherwise("target"))
        .withColumn(
            "exit_px",
            F.when(F.col("why") == "stop", F.least("stop_px", F.col("_x.open")))
            .when(F.col("why") == "target", F.greatest("target_px", F.col("_x.open")))
            .otherwise(F.col("_x.close")),
        )
        .withColumn("exit_ix", F.col("_x.ix"))
        .withColumn("exit_day", F.col("_x.day"))
    )
    return rows.withColumn("ret", (F.col("exit_px") / F.col("entry_px") - 1) * 100).drop("_t", "_x", "_end")


def held_volatility(labelled: DataFrame) -> DataFrame:
    """Stop-out flag and the population deviation of the held bars' returns (3 or more)."""
    held = F.filter("path", lambda b: b["ix"] <= F.col("exit_ix"))
    rets = F.when(
        F.size(held) >= 2,
        F.zip_with(
            F.slice(held, F.lit(2), F.size(held) - 1), F.slice(held, F.lit(1), F.size(held) - 1),
            lambda b, a: b["close"] / a["close"] - 1.0,
        ),
    )
    rows = labelled.withColumn("_r", rets)
    n = F.size("_r")
    mean = F.aggregate("_r", F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(F.transform("_r", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n
    return (
        rows.withColumn("stopped", F.col("why") == "stop")
        .withColumn("held_vol", F.when(n >= 3, F.sqrt(var) * 100))
        .drop("_r")
    )


def bars_held(labelled: DataFrame) -> Column:
    """Bars strictly after the entry bar through the exit bar; never negative."""
    return F.greatest(F.col("exit_ix") - (F.col("ix") + 1), F.lit(0))


def moved_stop(signals: DataFrame, after_pct: float, to_pct: float, stop: float = costs.STOP_PCT,
               target: float = costs.TARGET_PCT, hold: int = costs.HOLD_DAYS) -> DataFrame:
    """Once price touches +after_pct the stop sits at +to_pct, live from that same bar.

    On every bar the original stop is read first; the moved stop may fire on the
    bar that moved it. Back-test clock.
    """
    end = hold + 1
    p0 = F.get("path", F.lit(0))
    rows = (
        signals.filter((F.size("path") > 0) & (p0["open"] > 0))
        .withColumn("entry_px", p0["open"]).withColumn("entry_day", p0["day"])
        .withColumn("stop_px", F.col("entry_px") * (1 - stop / 100))
        .withColumn("target_px", F.col("entry_px") * (1 + target / 100))
        .withColumn("move_px", F.col("entry_px") * (1 + after_pct / 100))
        .withColumn("moved_px", F.col("entry_px") * (1 + to_pct / 100))
        .withColumn("_scan", F.slice("path", 1, end))
    )
    # First bar that reaches the move level with the original stop intact.
    touched = F.filter("_scan", lambda b: (b["high"] >= F.col("move_px")) & (b["low"] > F.col("stop_px")))
    rows = rows.withColumn("_m", F.get(touched, F.lit(0))["ix"])
    level = lambda b: F.when(b["ix"] >= F.col("_m"), F.col("moved_px")).otherwise(F.col("stop_px"))
    hit = F.filter("_scan", lambda b: (b["low"] <= level(b)) | (b["high"] >= F.col("target_px")))
    rows = rows.withColumn("_t", F.get(hit, F.lit(0)))
    rows = rows.filter(F.col("_t").isNotNull() | (F.size("path") >= end))
    # On the bar that moves the stop both levels are live and the original is
    # read first; later bars only know the moved one.
    moved_now = F.coalesce(F.col("_t.ix") >= F.col("_m"), F.lit(False))
    orig = (F.col("_t.low") <= F.col("stop_px")) & ~moved_now
    moved = moved_now & (F.col("_t.low") <= F.col("moved_px"))
    rows = rows.withColumn("_x", F.coalesce("_t", F.get("path", F.lit(end - 1)))).withColumn(
        "why", F.when(F.col("_t").isNull(), "time").when(orig, "stop").when(moved, "stop-moved").otherwise("target")
    )
    px = (
        F.when(F.col("why") == "stop", F.least("stop_px", F.col("_x.open")))
        .when(F.col("why") == "stop-moved", F.least("moved_px", F.col("_x.open")))
        .when(F.col("why") == "target", F.greatest("target_px", F.col("_x.open")))
        .otherwise(F.col("_x.close"))
    )
    return (
        rows.withColumn("exit_px", px).withColumn("exit_ix", F.col("_x.ix")).withColumn("exit_day", F.col("_x.day"))
        .withColumn("ret", (F.col("exit_px") / F.col("entry_px") - 1) * 100)
        .drop("_t", "_x", "_m", "_scan")
    )


def ladder_legs(labelled: DataFrame, rungs: list[tuple[float, float]], qty: str = "qty") -> DataFrame:
    """Partial exits: each rung sells int(qty0*fraction) when first touched before the final stop.

    Rungs fire in order on bars whose low holds the stop, up to and including the
    final exit bar unless that bar is a stop; what is left leaves at the final exit.
    One row per leg: leg, leg_qty, leg_px, leg_day, leg_why. The final leg is
    dropped when the rungs sold everything.
    """
    last = F.when(F.col("why") == "stop", F.col("exit_ix") - 1).otherwise(F.col("exit_ix"))
    rows = labelled.withColumn("_last", last)
    legs = []
    for i, (pct, frac) in enumerate(rungs):
        lvl = F.col("entry_px") * (1 + pct / 100)
        hit = F.get(F.filter("path", _reaches(lvl)), F.lit(0))
        legs.append(F.struct(F.lit(i).alias("leg"), lvl.alias("lvl"), F.lit(float(frac)).alias("frac"), hit.alias("hit")))
    rows = rows.withColumn("_rungs", F.filter(F.array(*legs), lambda r: r["hit"].isNotNull()))
    # Cap each rung by what earlier rungs left.
    want = lambda r: F.floor(F.col(qty) * r["frac"])
    sold = F.aggregate(
        "_rungs",
        F.struct(F.col(qty).cast("long").alias("left"), F.array().cast("array<long>").alias("q")),
        lambda acc, r: F.struct(
            (acc["left"] - F.least(want(r), acc["left"])).alias("left"),
            F.concat(acc["q"], F.array(F.least(want(r), acc["left"]))).alias("q"),
        ),
    )
    rows = rows.withColumn("_s", sold)
    partial = F.zip_with(
        "_rungs", "_s.q",
        lambda r, q: F.struct(
            r["leg"].alias("leg"), q.alias("leg_qty"), F.greatest(r["lvl"], r["hit"]["open"]).alias("leg_px"),
            r["hit"]["day"].alias("leg_day"), F.lit("partial").alias("leg_why"),
        ),
    )
    # If rungs sold everything, the position ends at the rung that emptied it.
    final = F.array(F.struct(
        F.lit(len(rungs)).alias("leg"), F.col("_s.left").alias("leg_qty"), F.col("exit_px").alias("leg_px"),
        F.col("exit_day").alias("leg_day"), F.col("why").alias("leg_why"),
    ))
    out = rows.withColumn("_l", F.explode(F.filter(F.concat(partial, final), lambda x: x["leg_qty"] >= 1)))
    return out.select(*labelled.columns, "_l.*")


def _reaches(level: Column):
    """Bars no later than the last tradeable one whose high meets the level."""
    return lambda b: (b["ix"] <= F.col("_last")) & (b["high"] >= level)


def with_structure(bars: DataFrame, ema: str = "ema20", look: int = 5) -> DataFrame:
    """Per bar: above its mean and no lower high over the last ``look`` bars against the ``look`` before."""
    now = F.max("high").over(series().rowsBetween(-(look - 1), 0))
    before = F.max("high").over(series().rowsBetween(-(2 * look - 1), -look))
    ok = (F.col("close") > F.col(ema)) & (F.col("ix") >= 2 * look - 1) & (now >= before)
    return bars.withColumn("shape_ok", F.coalesce(ok, F.lit(False)))


def structural_exit(signals: DataFrame, hold: int = costs.HOLD_DAYS, cap: int = 30, atr_mult: float = 1.5,
                    stop: float = costs.STOP_PCT, target: float = costs.TARGET_PCT) -> DataFrame:
    """Back-test clock, but past ``hold`` a name stays while its structure holds, up to ``cap`` bars.

    The path must carry shape_ok and atr per bar; the entry bar's own ATR is the yardstick.
    """
    p0 = F.get("path", F.lit(0))
    rows = (
        signals.filter((F.size("path") > 0) & (p0["open"] > 0))
        .withColumn("entry_px", p0["open"]).withColumn("entry_day", p0["day"]).withColumn("_a0", p0["atr"])
        .withColumn("stop_px", F.col("entry_px") * (1 - stop / 100))
        .withColumn("target_px", F.col("entry_px") * (1 + target / 100))
    )
    wide = lambda b: F.coalesce((F.col("_a0") > 0) & (b["atr"] > atr_mult * F.col("_a0")), F.lit(False))
    held = lambda b: b["ix"] - F.col("ix") - 1
    leave = lambda b: (held(b) >= cap) | ((held(b) >= hold) & (~b["shape_ok"] | wide(b)))
    hit = F.filter("path", lambda b: (b["low"] <= F.col("stop_px")) | (b["high"] >= F.col("target_px")) | leave(b))
    rows = rows.withColumn("_t", F.get(hit, F.lit(0))).filter(F.col("_t").isNotNull())
    why = (
        F.when(F.col("_t.low") <= F.col("stop_px"), "stop")
        .when(F.col("_t.high") >= F.col("target_px"), "target")
        .when(F.col("_t.ix") - F.col("ix") - 1 >= cap, "time-capped")
        .otherwise("structure")
    )
    rows = rows.withColumn("why", why)
    px = (
        F.when(F.col("why") == "stop", F.least("stop_px", F.col("_t.open")))
        .when(F.col("why") == "target", F.greatest("target_px", F.col("_t.open")))
        .otherwise(F.col("_t.close"))
    )
    return (
        rows.withColumn("exit_px", px).withColumn("exit_ix", F.col("_t.ix")).withColumn("exit_day", F.col("_t.day"))
        .withColumn("ret", (F.col("exit_px") / F.col("entry_px") - 1) * 100).drop("_t", "_a0")
    )


def shadow_stop(labelled: DataFrame, pct: float) -> DataFrame:
    """Would a pct stop have been hit after the entry bar and no later than the exit?"""
    if pct <= 0:
        raise ValueError(f"shadow stop pct must be > 0, got {pct}")
    rows = labelled.withColumn("level", F.col("entry_px") * (1 - pct / 100))
    hit = F.filter(
        "path", lambda b: (b["ix"] > F.col("ix") + 1) & (b["ix"] <= F.col("exit_ix")) & (b["low"] <= F.col("level"))
    )
    return rows.withColumn("shadow_day", F.get(hit, F.lit(0))["day"]).withColumn("shadow_hit", F.col("shadow_day").isNotNull())


def arm_grid(signals: DataFrame, arms: list[dict]) -> DataFrame:
    """One copy of each signal per arm. The grid is a literal array, so nothing is joined."""
    keys = list(arms[0])
    cells = [F.struct(*[F.lit(a[k]).alias(k) for k in keys]) for a in arms]
    return signals.withColumn("_arm", F.explode(F.array(*cells))).select(*signals.columns, "_arm.*")


def fired_bits(triggers: dict[str, Column], barred: Column) -> Column:
    """One number per bar: bit k is set where the k-th trigger fires and the bar is not ``barred``."""
    bits = None
    for k, trigger in enumerate(triggers.values()):
        bit = F.when(trigger, F.lit(1 << k)).otherwise(F.lit(0))
        bits = bit if bits is None else bits + bit
    return F.when(barred, F.lit(0)).otherwise(bits)


def ladder_return(labelled: DataFrame, rungs: list[tuple[float, float]], qty: str = "qty", into: str = "ladder_ret") -> DataFrame:
    """The return of the whole position if it is sold by ``ladder_legs``' rungs, in percent, on the labelled row itself."""
    last = F.when(F.col("why") == "stop", F.col("exit_ix") - 1).otherwise(F.col("exit_ix"))
    rows, left, taken = labelled.withColumn("_last", last), F.col(qty).cast("double"), F.lit(0.0)
    for pct, frac in rungs:
        level = F.col("entry_px") * (1 + pct / 100)
        hit = F.get(F.filter("path", _reaches(level)), F.lit(0))
        sold = F.when(hit.isNotNull(), F.least(F.floor(F.col(qty) * float(frac)).cast("double"), left)).otherwise(F.lit(0.0))
        taken = taken + F.when(sold > 0, sold * F.greatest(level, hit["open"])).otherwise(F.lit(0.0))
        left = left - sold
    whole = (taken + left * F.col("exit_px")) / (F.col(qty) * F.col("entry_px"))
    return rows.withColumn(into, (whole - 1) * 100).drop("_last")


def rule_grid(marked: DataFrame, triggers: list[str], exits: list[dict], rungs: list[tuple[float, float]], cash: float) -> DataFrame:
    """Trades of every cell of trigger x exit x ladder: trigger, a_stop, a_target, a_hold, ladder, ret and the marked row's columns.

    ``marked`` has one row per signal bar with its path and ``fired`` bits. Each signal is labelled once per exit, whatever the
    number of triggers, and both ladder states are read off that label; triggers only deal the result out.
    """
    labelled = arm_grid(marked, exits)
    labelled = barrier(labelled, F.col("a_stop"), F.col("a_target"), F.col("a_hold"))
    labelled = ladder_return(labelled.withColumn("qty", F.floor(F.lit(cash) / F.col("entry_px"))).filter("qty >= 1"), rungs)
    names = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(t).alias("trigger")) for k, t in enumerate(triggers)])
    states = F.array(F.struct(F.lit(False).alias("ladder"), F.col("ret").alias("ret")), F.struct(F.lit(True).alias("ladder"), F.col("ladder_ret").alias("ret")))
    rows = labelled.drop("path").withColumn("_t", F.explode(F.filter(names, lambda t: F.col("fired").bitwiseAND(t["bit"]) != 0))).withColumn("_s", F.explode(states))
    return rows.drop("ret", "ladder_ret").select("*", "_t.trigger", "_s.ladder", "_s.ret").drop("_t", "_s")


def net_trade(trades: DataFrame, qty: Column | None = None, c: Column | float = 1.0,
              adv: str = "liq", vol: str = "vol_pct", exit_adv: str | None = None, exit_vol: str | None = None) -> DataFrame:
    """Impact on both sides and the charge stack on a labelled trade.

    Entry impact is priced off the signal bar; exit impact off ``exit_adv`` /
    ``exit_vol`` when given, else the same bar. Adds qty, buy, net, net_ret, cost_pct, imp.
    """
    qty = qty if qty is not None else costs.position_qty(F.col("entry_px"))
    rows = trades.withColumn("qty", qty).filter(F.col("qty") >= 1)
    rows = rows.withColumn("imp_in", costs.impact_pct(F.col("qty") * F.col("entry_px"), F.col(adv), F.col(vol), c))
    rows = rows.withColumn("imp_out", costs.impact_pct(F.col("qty") * F.col("exit_px"), F.col(exit_adv or adv), F.col(exit_vol or vol), c))
    buy = F.col("qty") * (F.col("entry_px") * (1 + F.col("imp_in") / 100))
    sell = F.col("qty") * (F.col("exit_px") * (1 - F.col("imp_out") / 100))
    rows = rows.withColumn("buy", buy).withColumn("_sell", sell)
    rows = rows.withColumn("cost", costs.charge(F.col("buy"), "BUY") + costs.charge(F.col("_sell"), "SELL"))
    return (
        rows.withColumn("net", F.col("_sell") - F.col("buy") - F.col("cost"))
        .withColumn("net_ret", F.col("net") / F.col("buy") * 100)
        .withColumn("cost_pct", F.col("cost") / F.col("buy") * 100)
        .withColumn("imp", F.col("imp_in") + F.col("imp_out"))
        .drop("_sell")
    )


def yearly_tax(trades: DataFrame, day: str = "exit_day") -> DataFrame:
    """Tax on each financial year's net gain; a losing year pays nothing."""
    fy = costs.financial_year(F.col(day))
    return trades.groupBy(fy.alias("fy")).agg(F.sum("net").alias("net")).withColumn(
        "tax", F.greatest(F.col("net"), F.lit(0.0)) * costs.TAX_RATE
    )
