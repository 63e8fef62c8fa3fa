"""Turn labelled trades into attribution, error bars, spreads and adoption decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .ranking import wide_ranked

LEDGER_FEATURES = ("rs", "deliv", "liq", "off_high", "near_high", "rsi")


def attribution(trades: DataFrame, key: str, ret: str = "ret", order: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, mean and wins of each key's trades.

    With ``order``, which must be total inside a key, the returns are added in it: a sum taken as the rows arrive has
    other last bits with every shuffle, so keys with the same trades would rank by chance.
    """
    x = F.col(ret)
    n, total, avg = F.count(x), F.sum(x), F.avg(x)
    if order:
        w = Window.partitionBy(key).orderBy(*order)
        run = F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
        trades = trades.withColumn("_at", F.row_number().over(w)).withColumn("_run", run)
        total = F.max_by("_run", "_at")
        avg = total / F.nullif(n, F.lit(0))
    return trades.groupBy(key).agg(
        n.alias("n"), total.alias("total"), avg.alias("avg"),
        F.sum(F.when(x > 0, 1).otherwise(0)).alias("wins"),
    )


def concentration(per_symbol: DataFrame) -> DataFrame:
    """Share of all winning totals that the best 1, 3 and tenth of names supply."""
    rows = wide_ranked(per_symbol, [], [F.col("total").desc(), F.col("symbol")], "_k")
    n = per_symbol.agg(F.count(F.lit(1))).scalar()
    won = F.when(F.col("total") > 0, F.col("total")).otherwise(0.0)
    tenth = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    top = lambda k: F.sum(F.when(F.col("_k") <= k, won).otherwise(0.0))
    sums = rows.withColumn("_n", n).agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum(F.when(F.col("total") > 0, 1).otherwise(0)).alias("winners"),
        F.sum(won).alias("_g"), top(1).alias("_1"), top(3).alias("_3"), top(tenth).alias("_10"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("_g")) * 100, F.lit(0.0))
    return sums.select("n_symbols", "winners", share("_1").alias("top1"), share("_3").alias("top3"), share("_10").alias("top10pct"))


def unpivot_features(ledger: DataFrame, features: tuple[str, ...] = LEDGER_FEATURES) -> DataFrame:
    """(feature, x, ret, date key columns) rows with both values known."""
    keep = [c for c in ledger.columns if c not in features]
    return ledger.unpivot(keep, list(features), "feature", "x").filter(F.col("x").isNotNull() & F.col("ret").isNotNull())


def feature_information(long: DataFrame, by: tuple[str, ...] = (), least: int = 30, slabs: int | None = None) -> DataFrame:
    """Mean return of the top third minus the bottom third by each feature.

    Under ``least`` rows a feature is skipped; one without variance reports 0.
    Ties are ordered by (date, symbol), so a result is reproducible.
    """
    keys = [*by, "feature"]
    r = wide_ranked(long, keys, [F.col("x"), F.col("day"), F.col("symbol")], "_k", "_m", slabs)
    r = r.filter(F.col("_m") >= least).withColumn("_t", F.floor(F.col("_m") / 3))
    lo, hi = F.avg(F.when(F.col("_k") <= F.col("_t"), F.col("ret"))), F.avg(F.when(F.col("_k") > F.col("_m") - F.col("_t"), F.col("ret")))
    # Fewer than three distinct values: read off the extremes and the rows between.
    inner = r.groupBy(*keys).agg(
        F.max("_m").alias("n"), lo.alias("lo"), hi.alias("hi"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    # One row per feature (and half): bounded by the feature list, so broadcast.
    flat = r.join(F.broadcast(inner.select(*keys, "x0", "x1")), keys).groupBy(*keys).agg(
        F.coalesce(F.bool_or((F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1"))), F.lit(False)).alias("varied")
    )
    out = inner.drop("x0", "x1").join(flat, keys)
    z = lambda c: F.when(F.col("varied"), F.col(c)).otherwise(F.lit(0.0))
    return out.select(
        *keys, "n", z("lo").alias("bottom_third"), z("hi").alias("top_third"),
        (z("hi") - z("lo")).alias("spread"), (~F.col("varied")).alias("no_variance"),
    )


def split_check(long: DataFrame, least: int = 100, split: float = 0.5, slabs: int | None = None) -> DataFrame:
    """Does a feature's spread keep its sign from the early to the late part of the trades?

    verdict: consistent, flips, none (no information in one half), thin (too few rows).
    """
    r = wide_ranked(long, ["feature"], [F.col("day"), F.col("symbol")], "_o", "_all", slabs)
    halves = r.withColumn("half", F.when(F.col("_o") <= F.floor(F.col("_all") * split), "early").otherwise("late"))
    total = halves.groupBy("feature").agg(F.max("_all").alias("n"))
    info = feature_information(halves.drop("_o", "_all"), ("half",), slabs=slabs)
    wide = info.groupBy("feature").agg(
        F.max(F.when(F.col("half") == "early", F.col("spread"))).alias("early"),
        F.max(F.when(F.col("half") == "late", F.col("spread"))).alias("late"),
    )
    e, l = F.col("early"), F.col("late")
    verdict = (
        F.when((F.col("n") < least) | e.isNull() | l.isNull(), "thin")
        .when((e == 0) | (l == 0), "none").when((e > 0) != (l > 0), "flips").otherwise("consistent")
    )
    return total.join(wide, "feature", "left").withColumn("verdict", verdict)


def weight_proposal(
    info: DataFrame, checks: DataFrame, unconditioned: DataFrame | None, current: dict[str, float], n_trades: Column,
    min_trades: int = 200, step: float = 0.15, invert_at: float = 0.5,
) -> DataFrame:
    """New weight per feature, moved part of the way toward its share of the information.

    A handful of rows: one per weighted feature. Evidence that is thin or flips
    counts as zero; an unconditioned measurement, where given, replaces the
    selected-sample one and alone may invert a feature.
    """
    spark = info.sparkSession
    base = spark.createDataFrame([(f, float(w)) for f, w in current.items()], "feature string, weight double")
    rows = base.join(info.select("feature", "spread"), "feature", "left").join(checks.select("feature", "verdict"), "feature", "left")
    rows = rows.withColumn("n_trades", n_trades).withColumn("_raw", F.when(F.col("verdict") == "consistent", F.col("spread")).otherwise(F.lit(0.0)))
    if unconditioned is not None:
        rows = rows.join(unconditioned.select("feature", F.col("spread").alias("_u")), "feature", "left")
    else:
        rows = rows.withColumn("_u", F.lit(None).cast("double"))
    used = F.col("_u") if unconditioned is not None else F.col("_raw")
    # A feature without a measured spread never enters the total.
    used = F.when(F.col("spread").isNotNull(), F.coalesce(used, F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("used", used).withColumn("inverted", F.coalesce((F.col("_u") < -invert_at) & F.col("spread").isNotNull(), F.lit(False)))
    rows = rows.withColumn("_pos", F.when(F.col("inverted"), -F.col("used")).otherwise(F.greatest("used", F.lit(0.0))))
    everything = Window.partitionBy(F.lit(0))
    measured = F.sum(F.col("spread").isNotNull().cast("int")).over(everything)
    total = F.sum("_pos").over(everything)
    informative = F.max(F.abs(F.coalesce("spread", F.lit(0.0)))).over(everything) >= 1e-9
    goal = measured * F.col("_pos") / F.when(total > 0, total).otherwise(F.lit(1.0))
    moved = F.round(F.col("weight") + (goal - F.col("weight")) * step, 4)
    rows = rows.withColumn("new_weight", F.when((F.col("n_trades") >= min_trades) & informative, moved).otherwise(F.col("weight")))
    ratio = F.try_divide(F.col("new_weight"), F.col("weight"))
    no_op = F.max(ratio).over(everything) - F.min(ratio).over(everything) < 1e-6
    return rows.withColumn("no_op", no_op).drop("_raw", "_u", "_pos")


def random_sample(rows: DataFrame, per_day: int, seed: int = 11) -> DataFrame:
    """Up to ``per_day`` symbols per session in hash order: repeatable and unconditioned."""
    key = F.md5(F.concat_ws("|", F.col("symbol"), F.col("day").cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("day").orderBy("_h", "symbol")
    return rows.withColumn("_h", key).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_day).drop("_h", "_k")


def sample_sessions(sessions: DataFrame, first: int, hold: int, n_dates: int) -> DataFrame:
    """Every step-th session from ``first`` that leaves ``hold`` sessions after it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - 320) / n_dates))
    return (
        sessions.withColumn("_n", n)
        .filter((F.col("session_ix") >= first) & (F.col("session_ix") < F.col("_n") - hold - 1))
        .filter((F.col("session_ix") - first) % step == 0).drop("_n")
    )


def welch_vs_control(per_arm: DataFrame, control: str, arm: str = "arm") -> DataFrame:
    """Each arm's mean against the control's, with Welch error and t. Rows: one per arm."""
    of = lambda c: F.max(F.when(F.col(arm) == control, F.col(c))).over(Window.partitionBy(F.lit(0)))
    rows = per_arm.withColumn("_n", of("n")).withColumn("_m", of("mean")).withColumn("_s", of("sd"))
    ok = (F.col("n") >= 2) & (F.col("_n") >= 2)
    se = F.sqrt(F.col("sd") * F.col("sd") / F.col("n") + F.col("_s") * F.col("_s") / F.col("_n"))
    gap = F.col("mean") - F.col("_m")
    return (
        rows.withColumn("gap", F.when(ok, gap)).withColumn("gap_se", F.when(ok, se))
        .withColumn("gap_t", F.when(ok & (se > 0), F.try_divide(gap, se))).drop("_n", "_m", "_s")
    )


def tercile_spread(rows: DataFrame, key: str, by: tuple[str, ...] = (), least: int = 30) -> DataFrame:
    """Mean return above the upper cut minus below the lower cut, strict cuts by position."""
    keys = list(by) or ["_g"]
    rows = rows.filter(F.col(key).isNotNull())
    if not by:
        rows = rows.withColumn("_g", F.lit(1))
    r = wide_ranked(rows, keys, [F.col(key), F.col("day"), F.col("symbol")], "_k", "_m").withColumn("_k", F.col("_k") - 1)
    cuts = r.groupBy(*keys).agg(
        F.max(F.when(F.col("_k") == F.floor(F.col("_m") / 3), F.col(key))).alias("_lo"),
        F.max(F.when(F.col("_k") == F.floor(2 * F.col("_m") / 3), F.col(key))).alias("_hi"),
        F.max("_m").alias("n"),
    )
    out = r.select(*keys, key, "ret").join(F.broadcast(cuts), keys).groupBy(*keys, "n").agg(
        *stats.spread_columns(F.col("ret"), F.col(key) > F.col("_hi"), F.col(key) < F.col("_lo"))
    )
    gate = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    out = out.select(*keys, "n", F.when(F.col("n") >= least, F.col("n_hi")).otherwise(0).alias("n_hi"),
                     F.when(F.col("n") >= least, F.col("n_lo")).otherwise(0).alias("n_lo"), gate("spread"), gate("se"), gate("t"))
    return out if by else out.drop("_g")


def exact_median(rows: DataFrame, key: str, by: list[str], into: str = "median", slabs: int | None = None) -> DataFrame:
    """Exact median per group from ranked positions; holds at any group size."""
    r = wide_ranked(rows.filter(F.col(key).isNotNull()), by, [F.col(key)], "_k", "_m", slabs)
    mid = (F.col("_k") == F.floor((F.col("_m") + 1) / 2)) | (F.col("_k") == F.floor(F.col("_m") / 2) + 1)
    # Two middle rows (the same one twice when odd) averaged; equal values share any order.
    return r.filter(mid).groupBy(*by).agg(F.avg(key).alias(into), F.max("_m").alias("n"))


def median_spread(long: DataFrame, least: int = 100, side: int = 50) -> DataFrame:
    """Mean return above a feature's median minus at or below it, with size guards."""
    med = exact_median(long, "x", ["feature"], "med")
    hi, lo = F.when(F.col("x") > F.col("med"), F.col("ret")), F.when(F.col("x") <= F.col("med"), F.col("ret"))
    out = long.join(F.broadcast(med), "feature").groupBy("feature", "med", "n").agg(
        F.avg(hi).alias("_h"), F.avg(lo).alias("_l"), F.count(hi).alias("n_hi"), F.count(lo).alias("n_lo")
    )
    ok = (F.col("n") >= least) & (F.col("n_hi") >= side) & (F.col("n_lo") >= side)
    return out.withColumn("spread", F.when(ok, F.col("_h") - F.col("_l"))).drop("_h", "_l")


def _signed(long: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The rows with their feature's median, and what is high and low: sign for tone, set/unset for flag, median otherwise."""
    med = exact_median(long, "x", ["feature"], "med")
    f, x = F.col("feature"), F.col("x")
    hi = F.when(f.isin("ann_tone", "ann_flag"), x > 0).otherwise(x > F.col("med"))
    lo = F.when(f == "ann_tone", x < 0).when(f == "ann_flag", x == 0).otherwise(x <= F.col("med"))
    # One row per feature: bounded by the feature list.
    return long.join(F.broadcast(med), "feature"), hi, lo


def signed_split(long: DataFrame) -> DataFrame:
    """High/low groups per feature where it varies: sign for tone, set/unset for flag, median otherwise."""
    rows, hi, lo = _signed(long)
    return rows.groupBy("feature").agg(*stats.spread_columns(F.col("ret"), hi, lo))


def tone_facts(long: DataFrame, category: str, echo: str, bands: tuple[str, ...] = ("micro", "small")) -> DataFrame:
    """What tone_rule asks of each score: the split's spread and t, the spread of the category alone, the score's
    correlation with the column ``echo``, and the spread within each band."""
    rows, hi, lo = _signed(long)
    within = [stats.spread_columns(F.col("ret"), hi & (F.col("band") == b), lo & (F.col("band") == b))[2].alias(b) for b in bands]
    facts = rows.groupBy("feature").agg(*stats.spread_columns(F.col("ret"), hi, lo), stats.correlation("x", echo).alias("echo"), *within)
    alone = F.max(F.when(F.col("feature") == category, F.col("spread"))).over(Window.partitionBy(F.lit(0)))
    return facts.withColumn("category_spread", alone).filter(F.col("feature") != category)


# --- equity curves and blocks ---------------------------------------------


def _grid(sessions: DataFrame, arms: list[str], arm: str) -> DataFrame:
    """Every session once per named arm, from a literal list."""
    return sessions.select("day", F.explode(F.array(*[F.lit(a) for a in arms])).alias(arm))


def daily_curve(trades: DataFrame, sessions: DataFrame, arms: list[str], capital: float, stake: float, arm: str = "arm") -> DataFrame:
    """Equity per arm and session: capital plus equal-stake results booked on the exit day.

    Sums to one row per (arm, exit day) before any ordering; the running sum then
    sees at most one row per session.
    """
    booked = trades.groupBy(arm, F.col("exit_day").alias("day")).agg(F.sum(F.col("ret") * stake / 100).alias("_p"))
    w = Window.partitionBy(arm).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return _grid(sessions, arms, arm).join(booked, [arm, "day"], "left").withColumn("equity", capital + F.sum(F.coalesce("_p", F.lit(0.0))).over(w)).drop("_p")


def path_summary(curve: DataFrame, capital: float, arm: str = "arm") -> DataFrame:
    """Total %, CAGR (over half a year or more) and worst fall from a running peak."""
    w = Window.partitionBy(arm).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_peak", F.greatest(F.max("equity").over(w), F.lit(float(capital))))
    out = rows.groupBy(arm).agg(
        F.max_by("equity", "day").alias("equity"),
        F.max((F.col("_peak") - F.col("equity")) / F.col("_peak")).alias("_dd"),
        (F.datediff(F.max("day"), F.min("day")) / 365.25).alias("years"),
    )
    growth = F.col("equity") / capital
    return out.select(
        arm, "equity", "years", ((growth - 1) * 100).alias("total_pct"),
        F.when((F.col("years") > 0.5) & (growth > 0), (F.pow(growth, 1 / F.col("years")) - 1) * 100).alias("cagr"),
        (F.col("_dd") * 100).alias("maxdd"),
    )


def block_drawdowns(curve: DataFrame, arm: str = "arm", least: int = 20) -> DataFrame:
    """Drawdown inside each half-year block (the peak resets) and the block's return."""
    rows = curve.withColumn("block", stats.half_year(F.col("day")))
    w = Window.partitionBy(arm, "block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("equity").over(w))
    out = rows.groupBy(arm, "block").agg(
        F.count(F.lit(1)).alias("points"),
        F.max(F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.nullif(F.col("_peak"), F.lit(0.0)))).alias("_d"),
        F.min_by("equity", "day").alias("_f"), F.max_by("equity", "day").alias("_l"),
    )
    return out.filter(F.col("points") >= least).select(
        arm, "block", "points", (F.coalesce("_d", F.lit(0.0)) * 100).alias("dd"),
        F.when(F.col("_f") != 0, (F.try_divide(F.col("_l"), F.col("_f")) - 1) * 100).otherwise(0.0).alias("ret_pct"),
    )


def paired_blocks(blocks: DataFrame, control: str, arm: str = "arm", value: str = "dd") -> DataFrame:
    """Per arm: difference to the control over shared blocks; mean, error, t, median, win %, leave-one-out t."""
    c = blocks.filter(F.col(arm) == control).select("block", F.col(value).alias("_c"))
    # The inner join keeps the blocks both arms have.
    d = blocks.filter(F.col(arm) != control).join(c, "block").withColumn("d", F.col(value) - F.col("_c"))
    worst = F.row_number().over(Window.partitionBy(arm).orderBy(F.abs("d").desc(), F.col("block")))
    d = d.withColumn("_w", worst)
    rest = F.when(F.col("_w") > 1, F.col("d"))
    n, k = F.count("d"), F.count(rest)
    se = F.when(n >= 2, F.stddev_samp("d") / F.sqrt(n)).otherwise(F.lit(0.0))
    lse = F.when(k >= 2, F.stddev_samp(rest) / F.sqrt(F.nullif(k, F.lit(0)))).otherwise(F.lit(0.0))
    mean = F.when(n >= 2, F.avg("d")).otherwise(F.lit(0.0))
    lmean = F.when(k >= 2, F.avg(rest)).otherwise(F.lit(0.0))
    return d.groupBy(arm).agg(
        n.alias("n"), mean.alias("mean_diff"), se.alias("se"),
        F.when(se > 0, F.try_divide(mean, se)).otherwise(0.0).alias("t"),
        F.percentile("d", 0.5).alias("median_diff"),
        (100.0 * F.sum(F.when(F.col("d") < 0, 1).otherwise(0)) / n).alias("win_pct"),
        F.when(lse > 0, F.try_divide(lmean, lse)).otherwise(0.0).alias("loo_t"),
    )


def occupancy(trades: DataFrame, sessions: DataFrame, arms: list[str], arm: str = "arm") -> DataFrame:
    """Open positions per arm and session, by running entries minus exits.

    Entry and exit counts per day are summed first; no trade is spread over the
    days it is held.
    """
    moves = trades.select(arm, F.col("entry_day").alias("day"), F.lit(1).alias("_m")).unionByName(
        trades.select(arm, F.col("exit_day").alias("day"), F.lit(-1).alias("_m"))
    ).groupBy(arm, "day").agg(F.sum("_m").alias("_m"))
    w = Window.partitionBy(arm).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return _grid(sessions, arms, arm).join(moves, [arm, "day"], "left").withColumn("held", F.sum(F.coalesce("_m", F.lit(0))).over(w)).drop("_m")


def occupancy_report(occ: DataFrame, seats: int, arm: str = "arm") -> DataFrame:
    n = F.count(F.lit(1))
    return occ.groupBy(arm).agg(
        F.avg("held").alias("mean_held"),
        (F.sum(F.when(F.col("held") >= seats, 1).otherwise(0)) / n * 100).alias("full_pct"),
        (F.sum(F.when(F.col("held") == 0, 1).otherwise(0)) / n * 100).alias("empty_pct"),
        F.max("held").alias("most"),
    )


def merge_legs(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Legs of one position as one row: net over buy, reasons joined in order, last day."""
    return legs.groupBy(*keys).agg(
        (F.sum("net") / F.sum("buy") * 100).alias("ret"), F.sum("net").alias("net"), F.sum("buy").alias("buy"),
        F.array_join(F.array_sort(F.collect_set("why")), "+").alias("why"), F.max("leg_day").alias("day"),
        F.count(F.lit(1)).alias("legs"),
    )


def adoption(row: DataFrame, conditions: list[tuple[str, Column]]) -> DataFrame:
    """Booleans with names plus the failed names: adopt only when every condition holds.

    An unknown condition is a failed one.
    """
    known = [(n, F.coalesce(c, F.lit(False))) for n, c in conditions]
    out = row.select(*row.columns, *[c.alias(n) for n, c in known])
    failed = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n, _ in known]))
    return out.withColumn("failed", F.array_join(failed, ",")).withColumn("adopt", F.size(failed) == 0)


def arm_facts(trades: DataFrame, control: str, order: list[str]) -> DataFrame:
    """What the adoption rules compare, one row per arm: edge against the control, means per band, worst half-year, share of the
    best name, number of names, each with the control's value beside it (c_...); whether the edges run one way
    over ``order``. Arms are a literal grid, so windows over all of them hold a handful of rows."""
    every = Window.partitionBy(F.lit(0))
    mean_of = lambda b: F.avg(F.when(F.col("band") == b, F.col("ret"))).alias(b)
    base = welch_vs_control(trades.groupBy("arm").agg(*stats.sample_bars(), mean_of("micro"), mean_of("small")), control)
    blocks = trades.groupBy("arm", stats.half_year(F.col("exit_day")).alias("_b")).agg(F.sum("ret").alias("_t")).groupBy("arm").agg(F.min("_t").alias("worst"))
    names = trades.groupBy("arm", "symbol").agg(F.sum("ret").alias("_t"))
    won = F.sum(F.greatest("_t", F.lit(0.0)))
    names = names.groupBy("arm").agg(F.count(F.lit(1)).alias("names"), (F.try_divide(F.greatest(F.max("_t"), F.lit(0.0)), won) * 100).alias("top1"))
    rows = base.join(blocks, "arm").join(names, "arm")
    beside = [F.max(F.when(F.col("arm") == control, F.col(c))).over(every).alias(f"c_{c}") for c in ("micro", "small", "worst", "names", "top1")]
    place = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("arm"))
    before = F.lag("gap").over(every.orderBy("_place"))
    rows = rows.select("*", *beside, place.alias("_place")).withColumn("_up", F.coalesce(F.col("gap") >= before, F.lit(True))).withColumn("_down", F.coalesce(F.col("gap") <= before, F.lit(True)))
    return rows.withColumn("runs_one_way", F.min("_up").over(every) | F.min("_down").over(every)).drop("_place", "_up", "_down")


def seats_rule(worse_by: float = 3.0) -> list[tuple[str, Column]]:
    """Another number of seats: a resolved edge that runs one way over the arms, in both bands, without a deeper fall."""
    return [
        ("resolved", F.abs("gap_t") > 2), ("one_way", F.col("runs_one_way")), ("both_bands", (F.col("micro") > F.col("c_micro")) & (F.col("small") > F.col("c_small"))),
        ("no_deeper_fall", F.col("maxdd") <= F.col("c_maxdd") + worse_by),
    ]


def pooled_rule() -> list[tuple[str, Column]]:
    """One pool instead of bands: better trades, and neither the worst block, the concentration, the breadth nor the block falls worse."""
    return [
        ("better", F.col("gap_t") > 2), ("worst_block", F.col("worst") >= F.col("c_worst")), ("concentration", F.col("top1") <= F.col("c_top1")),
        ("breadth", F.col("names") >= F.col("c_names")), ("block_falls", ~(F.coalesce("t", F.lit(0.0)) > 2)),
    ]


def pattern_rule(loose_edge: Column, bar: float = 2.6) -> list[tuple[str, Column]]:
    """A new trigger: resolved, good in both bands, no worse half-year, and better than merely saying yes more often."""
    return [
        ("resolved", F.abs("gap_t") >= bar), ("both_bands", (F.col("micro") > 0) & (F.col("small") > 0)), ("worst_block", F.col("worst") >= F.col("c_worst")),
        ("not_looser", ~F.coalesce(loose_edge >= F.col("gap"), F.lit(False))),
    ]


def falls_rule(exposure_r: Column, bar: float = 2.81, loo: float = 1.5, most_r: float = 0.7) -> list[tuple[str, Column]]:
    """A trigger for shallower falls: resolved, not one episode, not bought by holding less, without a resolved loss of return."""
    return [
        ("resolved", (F.abs("t") >= bar) & (F.col("mean_diff") < 0)), ("not_one_episode", ((F.col("median_diff") < 0) == (F.col("mean_diff") < 0)) & (F.abs("loo_t") > loo)),
        ("not_exposure", F.abs(exposure_r) < most_r), ("no_return_cost", ~F.coalesce(F.col("gap_t") <= -2, F.lit(False))),
    ]


def exit_rule(longer_edge: Column, bar: float = 2.6) -> list[tuple[str, Column]]:
    """A new exit: resolved, good in both bands, no worse half-year, and not half explained by holding longer."""
    explained = (F.col("gap") > 0) & (longer_edge >= 0.5 * F.col("gap"))
    return [
        ("resolved", F.abs("gap_t") >= bar), ("both_bands", (F.col("micro") > 0) & (F.col("small") > 0)), ("worst_block", F.col("worst") >= F.col("c_worst")),
        ("not_longer", ~F.coalesce(explained, F.lit(False))),
    ]


def tone_rule(bar: float = 2.64, most_echo: float = 0.3) -> list[tuple[str, Column]]:
    """A text score: resolved, beats the category alone, is not momentum restated, has one sign in both bands."""
    return [
        ("resolved", F.abs("t") >= bar), ("beats_category", F.col("spread") > F.col("category_spread")), ("not_momentum", F.abs("echo") < most_echo),
        ("one_sign", (F.col("micro") > 0) == (F.col("small") > 0)),
    ]


def keep_bar(arms: DataFrame, cagr: float = 5.0, dd: float = 55.0, n: int = 150, win: float = 30.0) -> DataFrame:
    return adoption(arms, [
        ("ok_cagr", F.col("cagr") > cagr), ("ok_dd", F.col("maxdd") < dd), ("ok_n", F.col("n") >= n), ("ok_win", F.col("win") >= win),
    ])


def walk_forward(halves: DataFrame, metric: str = "mean") -> DataFrame:
    """Best arm on the early half, its rank on the late half, and what that says.

    Input: one row per (param, arm, half). ok = best again, anti = last, weak between.
    """
    wide = halves.groupBy("param", "arm").agg(
        F.max(F.when(F.col("half") == "early", F.col(metric))).alias("early"),
        F.max(F.when(F.col("half") == "late", F.col(metric))).alias("late"),
    )
    by = Window.partitionBy("param")
    order = by.orderBy(F.col("late").desc_nulls_last(), "arm")
    wide = wide.withColumn("oos_rank", F.row_number().over(order)).withColumn("oos_of", F.count(F.lit(1)).over(by))
    first = F.row_number().over(by.orderBy(F.col("early").desc_nulls_last(), "arm"))
    best = wide.withColumn("oos_best", F.first("arm").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    best = best.withColumn("_f", first).filter(F.col("_f") == 1).drop("_f")
    verdict = (
        F.when((F.col("oos_rank") >= F.col("oos_of")) & (F.col("oos_of") > 1), "anti").when(F.col("oos_rank") > 1, "weak").otherwise("ok")
    )
    return best.withColumnRenamed("arm", "chosen").withColumn("verdict", verdict)


def newest(rows: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Latest row per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(at)).alias("_r")).select(key, "_r.*")


# Expectations frozen before forward results arrived.
EXPECTED = dict(rate_mo=2.86, per_trade=2.15, se=1.08, occ=3.10)


#: Sessions an order may wait for its fill, and the weekend allowed on top, in days.
STALE_SESSIONS, WEEKEND = 3, 2


def stale_pending(state: DataFrame, today: Column, sessions: int = STALE_SESSIONS) -> DataFrame:
    """One row: pending orders and how many of them have waited too long."""
    waits = F.datediff(today, F.col("queued_on")) > sessions + WEEKEND
    pending = F.col("status") == "pending"
    return state.agg(F.sum(F.when(pending, 1).otherwise(0)).alias("pending"), F.sum(F.when(pending & waits, 1).otherwise(0)).alias("stale"))


def forward_checks(row: DataFrame, expected: dict[str, float] = EXPECTED) -> DataFrame:
    """Trading rate, holding time, occupancy and edge against frozen expectations.

    Each check is 'early' until its sample can decide anything. The input row has
    closed, months, mean_hold, occ, mean and se, all measured from trades and sessions; with entered
    (positions entered, the rate's count) and stale (orders pending for too long) it also gives the fills check.
    """
    want = expected["rate_mo"] * F.col("months")
    half = 1.96 * F.sqrt(F.greatest(want, F.lit(1.0)))
    verdict = lambda early, ok: F.when(early, "early").when(ok, "pass").otherwise("fail")
    few = F.col("closed") < 10
    edge = F.abs(F.col("mean") - expected["per_trade"]) <= 1.96 * F.sqrt(F.col("se") * F.col("se") + expected["se"] * expected["se"])
    entered = F.col("entered" if "entered" in row.columns else "closed")
    fills = [("fills", F.col("stale").cast("double"), F.when(F.col("stale") > 0, "fail").otherwise("pass"))] if "stale" in row.columns else []
    checks = [
        *fills,
        ("rate", entered.cast("double"), verdict(F.col("months") < 6, entered.between(want - half, want + half))),
        ("hold", F.col("mean_hold"), verdict(few, F.col("mean_hold").between(4, 10))),
        ("occupancy", F.col("occ"), verdict(few, F.abs(F.col("occ") - expected["occ"]) <= 1)),
        ("edge", F.col("mean"), verdict(F.col("closed") < 195, edge)),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("check_name"), v.alias("value"), s.alias("state")) for n, v, s in checks])
    return row.select(F.explode(cells).alias("_c")).select("_c.*")
