"""Score, pick, size and allocate candidates. Ranks come first, filters after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.frames import let, series
from .ranking import neutral_percentile_rank, percentile_ranks, ranked

SCORED = ("rs", "deliv", "liq", "near_high")
DEFAULT_WEIGHTS = {"rs": 1.0, "deliv": 1.5, "liq": 1.0, "near_high": 1.0}
PER_BAND = 20
TAKE = {"micro": 3, "small": 2}
REFRESH = 5


def tenths(name: str) -> Column:
    """One decimal place by floor, so every engine breaks ties the same way."""
    return F.floor(F.col(name) * 10 + 0.5) / 10


def scoreable(banded: DataFrame, momentum: str = "rs_raw") -> DataFrame:
    """Banded rows that have a momentum value, with the four raw score inputs named."""
    return (
        banded.filter(F.col(momentum).isNotNull())
        .withColumn("x_rs", F.col(momentum))
        .withColumn("x_deliv", F.coalesce(F.col("deliv_mean"), F.lit(0.0)))
        .withColumn("x_liq", F.coalesce(F.col("liq"), F.lit(0.0)))
        .withColumn("x_near_high", F.col("near_high"))
    )


def lottery_screen(rows: DataFrame, by: list[str], share: float | Column) -> DataFrame:
    """Drop the int(n*share) names with the largest one-day gain of the last 21 bars.

    ``share`` may be a column, so that groups can be screened differently (0 keeps all).
    """
    order = [F.coalesce(F.col("max_ret21"), F.lit(0.0)).desc(), F.col("size_rank")]
    out = ranked(rows, by, order, "_k", "_m")
    return out.filter(F.col("_k") > F.floor(F.col("_m") * share)).drop("_k", "_m")


def score(
    rows: DataFrame,
    by: list[str],
    weights: dict[str, float] | None = None,
    inverted: tuple[str, ...] = (),
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Weighted mean of percentile ranks inside each group; the trend gate applies after ranking.

    ``extra`` features (columns of that name, NULL = unknown) rank neutrally.
    """
    weights = weights or DEFAULT_WEIGHTS
    out = percentile_ranks(rows, by, {f"x_{f}": f"r_{f}" for f in SCORED}, ["size_rank"])
    for f in extra:
        out = neutral_percentile_rank(out, by, f, ["size_rank"], f"r_{f}")
    total, wsum = F.lit(0.0), 0.0
    for f in (*SCORED, *extra):
        w = float(weights.get(f, 1.0))
        r = F.lit(100.0) - F.col(f"r_{f}") if f in inverted else F.col(f"r_{f}")
        total = total + r * w
        wsum += w
    return out.withColumn("score", total / (wsum or 1.0)).filter(F.col("close") > F.col("sma200"))


def score_by_weights(rows: DataFrame, by: list[str], arms: dict[str, dict[str, float]]) -> DataFrame:
    """One scored copy per named weight set; the ranks are computed once and reused."""
    base = score(rows, by)
    structs = []
    for name, w in arms.items():
        total, wsum = F.lit(0.0), 0.0
        for f in SCORED:
            total = total + F.col(f"r_{f}") * float(w.get(f, 1.0))
            wsum += float(w.get(f, 1.0))
        structs.append(F.struct(F.lit(name).alias("arm"), (total / (wsum or 1.0)).alias("score")))
    return (
        base.drop("score").withColumn("_a", F.explode(F.array(*structs)))
        .withColumn("arm", F.col("_a.arm")).withColumn("score", F.col("_a.score")).drop("_a")
    )


def pick(scored: DataFrame, by: list[str], n: int, into: str = "rank") -> DataFrame:
    """Best n per group. The rank filter becomes a per-partition group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("size_rank"))
    return scored.withColumn(into, F.row_number().over(w)).filter(F.col(into) <= n)


def candidates(picks: DataFrame, trigger: str = "trig", keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """Tradeable rows with levels, quantity and a lock-masked trigger.

    Known-restricted names leave here, after the pick and before allocation, so
    lower ranks move up. A locked bar is marked untriggered, never removed.
    Groups are picks, hence at most PER_BAND rows per band and day.
    """
    ref = F.col("close")
    restricted = (
        (F.coalesce(F.col("asm"), F.lit("")) != "") | (F.coalesce(F.col("gsm"), F.lit("")) != "") | F.col("fo_ban")
    )
    rows = (
        picks.filter(~(restricted & F.col("surveillance_known")))
        .withColumn("qty", costs.position_qty(ref))
        .filter(F.col("qty") >= 1)
        .withColumn("triggered", F.col(trigger) & (F.col("high") != F.col("low")))
        .withColumn("stop", ref * (1 - costs.STOP_PCT / 100))
        .withColumn("target", ref * (1 + costs.TARGET_PCT / 100))
        .withColumn("risk", F.col("qty") * (ref * costs.STOP_PCT / 100))
    )
    # The list order is the score rounded to one digit, ties in pick order.
    w = Window.partitionBy(*keys, "band").orderBy(tenths("score").desc(), "rank")
    return rows.withColumn("band_rank", F.row_number().over(w))


def allocate(cands: DataFrame, take: dict[str, int] | None = None, offset: int = 0, minimum: int = 0) -> DataFrame:
    """Round-robin over bands by depth, then the trigger, then the optional floor.

    Adds seat (1-based order over the day). Ranks [offset*k, offset*k+k) of each band.
    """
    take = take or TAKE
    rows = _quota(cands, take, offset)
    order = Window.partitionBy("day").orderBy("depth", "take_ix")
    rows = rows.withColumn("slot", F.row_number().over(order))
    if minimum <= 0:
        rows = rows.filter(F.col("triggered"))
        return rows.withColumn("seat", F.row_number().over(Window.partitionBy("day").orderBy("slot")))
    n_trig = F.sum(F.col("triggered").cast("int")).over(Window.partitionBy("day"))
    seat = F.row_number().over(Window.partitionBy("day").orderBy(F.col("triggered").desc(), "slot"))
    return rows.withColumn("_n", n_trig).withColumn("seat", seat).filter(F.col("seat") <= F.greatest("_n", F.lit(minimum))).drop("_n")


def _quota(cands: DataFrame, take: dict[str, int], offset: int) -> DataFrame:
    q = ix = None
    for i, (band, k) in enumerate(take.items()):
        q = F.when(F.col("band") == band, k) if q is None else q.when(F.col("band") == band, k)
        ix = F.when(F.col("band") == band, i) if ix is None else ix.when(F.col("band") == band, i)
    depth = F.col("band_rank") - 1 - offset * F.col("quota")
    return (
        cands.withColumn("quota", q).withColumn("take_ix", ix).withColumn("depth", depth)
        .filter((F.col("depth") >= 0) & (F.col("depth") < F.col("quota")))
    )


def chosen(cands: DataFrame, take: dict[str, int] | None = None) -> DataFrame:
    """The top k of each band whether or not they have triggered."""
    return _quota(cands, take or TAKE, 0)


def allocate_pooled(cands: DataFrame, seats: int = costs.MAX_POSITIONS, minimum: int = 0) -> DataFrame:
    """First ``seats`` rows of the day across bands, triggered only (plus the floor)."""
    order = Window.partitionBy("day").orderBy(tenths("score").desc(), "band_ix", "rank")
    rows = cands.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= seats)
    if minimum <= 0:
        return rows.filter(F.col("triggered"))
    n_trig = F.sum(F.col("triggered").cast("int")).over(Window.partitionBy("day"))
    seat = F.row_number().over(Window.partitionBy("day").orderBy(F.col("triggered").desc(), "slot"))
    return rows.withColumn("_n", n_trig).withColumn("_s", seat).filter(F.col("_s") <= F.greatest("_n", F.lit(minimum))).drop("_n", "_s")


def cohorts(cands: DataFrame, take: dict[str, int] | None = None, n: int = 6) -> DataFrame:
    """Disjoint depth cohorts 0..n-1 of k ranks each."""
    q = None
    for band, k in (take or TAKE).items():
        q = F.when(F.col("band") == band, k) if q is None else q.when(F.col("band") == band, k)
    return cands.withColumn("cohort", F.floor((F.col("band_rank") - 1) / q)).filter(F.col("cohort") < n)


def band_capped(cands: DataFrame, held: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` names per band and day, counting those already held.

    ``held`` has one row per (day, band) with the number of open positions.
    """
    rows = cands.join(held, ["day", "band"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    w = Window.partitionBy("day", "band").orderBy("band_rank")
    return rows.withColumn("take_no", F.row_number().over(w)).filter(F.col("take_no") <= cap - F.col("held"))


def seat_scarcity(cands: DataFrame, take: dict[str, int] | None = None) -> DataFrame:
    """Per session: gated, triggered, chosen, and the ranks of breakouts the quota missed."""
    q = None
    for band, k in (take or TAKE).items():
        q = F.when(F.col("band") == band, k) if q is None else q.when(F.col("band") == band, k)
    missed = F.when(F.col("triggered") & (F.col("band_rank") > F.coalesce(q, F.lit(0))), F.col("band_rank"))
    took = (F.col("triggered") & (F.col("band_rank") <= q)).cast("int")
    return cands.groupBy("day").agg(
        F.count(F.lit(1)).alias("gated"),
        F.sum(F.col("triggered").cast("int")).alias("triggered"),
        F.sum(F.coalesce(took, F.lit(0))).alias("bought"),
        F.count(missed).alias("missed"),
        F.percentile(missed, 0.5).alias("median_missed_rank"),
        F.max(missed).alias("deepest_missed_rank"),
    )


def tail_returns(bars: DataFrame, n: int = 60) -> Column:
    """The last n one-bar returns, oldest first (bounded array)."""
    return F.collect_list("ret1").over(series().rowsBetween(-(n - 1), 0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vector(a: Column) -> Column:
    """The array centred and scaled to length 1; NULL when flat.

    Each step is bound once, so the work is linear in the array.
    """
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    centred = let({"a": a, "m": mean}, lambda v, m: F.transform(v, lambda x: x - m))
    # Variance of a flat tail may come out as rounding dust rather than zero.
    norm = lambda c: F.when(_dot(c, c) > 1e-18, F.sqrt(_dot(c, c)))
    return let({"c": centred}, lambda c: let({"c": c, "n": norm(c)}, lambda v, n: F.when(n.isNotNull(), F.transform(v, lambda x: x / n))))


def tail_corr(a: Column, ua: Column, b: Column, ub: Column, least: int = 20) -> Column:
    """Pearson correlation of two return tails; 0 when short or flat.

    Tails of equal length meet as ready unit vectors; unequal ones are cut to the
    shorter and scaled again.
    """
    n = F.least(F.size(a), F.size(b))
    tail = lambda v: unit_vector(F.slice(v, F.size(v) - n + 1, n))
    same = F.size(a) == F.size(b)
    r = F.when(same, _dot(ua, ub)).otherwise(_dot(tail(a), tail(b)))
    return F.when(n >= least, F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))


def pair_correlations(cands: DataFrame, returns: str = "tail60") -> DataFrame:
    """Correlation of every candidate with the better-ranked ones of its day.

    A day's list is bounded by the pick (PER_BAND names per band), so the pairs
    per day are bounded too, at any universe size.
    """
    rows = cands.withColumn("_u", unit_vector(F.col(returns)))
    side = lambda k: rows.select("day", F.col("slot").alias(f"slot_{k}"), F.col("symbol").alias(f"sym_{k}"), F.col(returns).alias(f"_{k}"), F.col("_u").alias(f"_u{k}"))
    pairs = side("a").join(side("b"), "day").filter(F.col("slot_a") < F.col("slot_b"))
    return pairs.withColumn("corr", tail_corr(F.col("_a"), F.col("_ua"), F.col("_b"), F.col("_ub"))).drop("_a", "_b", "_ua", "_ub")


def decorrelated(cands: DataFrame, max_corr: float, returns: str = "tail60") -> DataFrame:
    """Keep a row unless a kept better-ranked row of its day moves too closely with it.

    The decision is sequential, so each day's bounded list is folded in slot order.
    """
    cell = F.struct(F.col("slot").cast("int").alias("slot"), "symbol", F.col(returns).alias("r"), unit_vector(F.col(returns)).alias("u"))
    rows = cands.groupBy("day").agg(F.sort_array(F.collect_list(cell)).alias("_l"))
    empty = F.slice("_l", 1, 0)
    clash = lambda kept, x: F.exists(kept, lambda k: F.abs(tail_corr(k["r"], k["u"], x["r"], x["u"])) > max_corr)
    fold = F.aggregate("_l", empty, lambda kept, x: F.when(clash(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return rows.select("day", F.explode(fold).alias("_k")).select("day", F.col("_k.slot").alias("slot"), F.col("_k.symbol").alias("symbol"))


def sized(rows: DataFrame, scheme: str, capital: float = costs.CAPITAL) -> DataFrame:
    """Quantity under a sizing scheme; the reference volatility is the day's candidate median."""
    med = F.percentile("vol_pct", 0.5).over(Window.partitionBy("day"))
    rows = rows.withColumn("_med", med)
    mult = costs.size_mult(scheme, F.col("seat") - 1, F.col("vol_pct"), F.col("_med"))
    return rows.withColumn("mult", mult).withColumn("sized_qty", costs.position_qty(F.col("next_open"), capital, F.col("mult"))).drop("_med")
