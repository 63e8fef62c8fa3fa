import pytest
from pyspark.sql import functions as F
from toys import bars, series

from crosstape.functions import indicators as ind
from crosstape.operators import evidence, outcomes, ranking, selection, universe


def corpus_rows(spark, n=30, days=400):
    rows = [series(f"S{j:02d}", [100 + j * k * 0.02 for k in range(days)], turnover=1e6 * (j + 1), deliv=40.0 + j) for j in range(n)]
    return bars(spark, *rows)


@pytest.fixture(scope="module")
def features(spark):
    b = ind.with_features(corpus_rows(spark)).withColumn("locked", F.col("high") == F.col("low")).withColumn("trig", F.lit(True))
    return b.filter("ix in (250, 399)").cache()


def test_slab_rank_equals_window_rank_with_ties_and_a_hot_group(spark):
    # Two thirds of the rows share one group and one value.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(1)).alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") % 50).cast("double")).alias("v"), F.col("id").alias("sym")
    )
    order = [F.col("v"), F.col("sym")]
    a = ranking.ranked(df, ["g"], order, "k", "m")
    b = ranking.wide_ranked(df, ["g"], order, "k", "m", slabs=40)
    cols = ["g", "v", "sym", "k", "m"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.count() == 3000
    g = ranking.wide_ranked(df, [], order, "k", slabs=40)
    assert sorted(r["k"] for r in g.select("k").collect()) == list(range(1, 3001))


def test_equal_values_spread_over_slabs(spark):
    df = spark.range(4000).select(F.lit(1.0).alias("x"), F.col("id").alias("sym"))
    r = ranking.wide_ranked(df, [], [F.col("x")], "k", "m", slabs=8)
    assert sorted(x["k"] for x in r.collect()) == list(range(1, 4001))
    laid = df.repartitionByRange(8, F.col("x"), F.xxhash64("x", "sym")).groupBy(F.spark_partition_id()).count().collect()
    assert len(laid) == 8 and max(x["count"] for x in laid) < 1500


def test_relative_strength_takes_one_exchange_on_the_day(spark, features):
    df = features.select("symbol", "day", "ix", "close")
    out = ranking.relative_strength(df, (20, 60))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(day") == 1
    old = df
    for k in (20, 60):
        old = old.withColumn(f"_r{k}", ind.bar_return(k))
    for k in (20, 60):
        known = ranking.percentile_rank(old.filter(F.col(f"_r{k}").isNotNull()), ["day"], f"_r{k}", ["symbol"], "want").select("symbol", "day", "want")
        assert out.filter(F.col(f"rs_{k}").isNotNull()).join(known, ["symbol", "day"], "full").filter(~F.col(f"rs_{k}").eqNullSafe(F.col("want"))).count() == 0


def test_bands_cut_the_most_liquid_third(features):
    got = {(r["band"], r["symbol"]) for r in ranking.size_bands(features).filter("ix = 399").collect()}
    micro = sorted(s for b, s in got if b == "micro")
    small = sorted(s for b, s in got if b == "small")
    assert micro == [f"S{j:02d}" for j in range(10)] and small == [f"S{j:02d}" for j in range(10, 20)]


def test_rank_ties_follow_turnover_then_symbol(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 2), ("b", 1, 5.0, 1), ("c", 1, 1.0, 0)], "symbol string, day int, v double, size_rank int")
    got = {r["symbol"]: r["p"] for r in ranking.percentile_rank(df, ["day"], "v", ["size_rank"], "p").collect()}
    assert got == pytest.approx({"c": 100 / 3, "b": 200 / 3, "a": 100.0})


def test_neutral_rank(spark):
    df = spark.createDataFrame([("a", 1, None, 0), ("b", 1, 1.0, 1), ("c", 1, 2.0, 2)], "symbol string, day int, v double, size_rank int")
    got = {r["symbol"]: r["p"] for r in ranking.neutral_percentile_rank(df, ["day"], "v", ["size_rank"], "p").collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": 100.0}


def test_filters_stay_above_the_rank_windows(features):
    """Trend and trigger may not thin the cross-section before it is ranked."""
    cand = selection.candidates(selection.pick(selection.score(selection.scoreable(ranking.size_bands(features)), ["day", "band"]), ["day", "band"], 20))
    lines = cand._jdf.queryExecution().optimizedPlan().toString().split("\n")
    gate = next(i for i, ln in enumerate(lines) if "Filter" in ln and "sma200" in ln)
    windows = [i for i, ln in enumerate(lines) if "Window" in ln and "row_number" in ln and "x_near_high" in ln]
    assert windows and gate < min(windows)


def test_locked_bar_is_marked_not_removed(spark, features):
    f = features.filter("ix = 399").withColumn("high", F.when(F.col("symbol") == "S09", F.col("low")).otherwise(F.col("high")))
    rows = selection.candidates(selection.pick(selection.score(selection.scoreable(ranking.size_bands(f)), ["day", "band"]), ["day", "band"], 20))
    got = {r["symbol"]: r["triggered"] for r in rows.collect()}
    assert got["S09"] is False and all(v for k, v in got.items() if k != "S09")


def _cands(spark, rows):
    return spark.createDataFrame(rows, "symbol string, day int, band string, band_ix int, rank int, band_rank int, score double, triggered boolean, vol_pct double, next_open double")


def test_allocation_is_round_robin_and_trigger_comes_last(spark):
    rows = [(f"m{i}", 1, "micro", 0, i, i, 90.0 - i, i != 1, 3.0, 10.0) for i in range(1, 6)] + [(f"s{i}", 1, "small", 1, i, i, 80.0 - i, True, 3.0, 10.0) for i in range(1, 6)]
    c = _cands(spark, rows)
    assert [r["symbol"] for r in selection.allocate(c).orderBy("seat").collect()] == ["s1", "m2", "s2", "m3"]
    assert [r["symbol"] for r in selection.allocate(c, minimum=5).orderBy("seat").collect()] == ["s1", "m2", "s2", "m3", "m1"]
    assert [r["symbol"] for r in selection.allocate(c, offset=1).orderBy("seat").collect()] == ["m4", "s3", "m5", "s4"]
    assert [r["symbol"] for r in selection.allocate_pooled(c).orderBy("slot").collect()] == ["m2", "m3", "m4", "m5"]


def test_decorrelate_keeps_the_better_ranked(spark):
    up = [0.01, -0.01] * 30
    other = [0.01, 0.01, -0.01, -0.01] * 15
    rows = [(1, 1, "a", up), (1, 2, "b", up), (1, 3, "c", other), (1, 4, "d", [0.0] * 60)]
    df = spark.createDataFrame(rows, "day int, slot int, symbol string, tail60 array<double>")
    assert [r["symbol"] for r in selection.decorrelated(df, 0.9).orderBy("slot").collect()] == ["a", "c", "d"]
    pairs = {(r["sym_a"], r["sym_b"]): r["corr"] for r in selection.pair_correlations(df).collect()}
    assert pairs[("a", "b")] == pytest.approx(1.0) and pairs[("a", "d")] == 0.0 and len(pairs) == 6


def test_corpus_refuses_without_master(spark):
    with pytest.raises(ValueError):
        universe.corpus(corpus_rows(spark, 1, 5), None)


# --- outcomes against a plain loop ------------------------------------------------


def walk(b, i, stop, target, hold, first, late, close_short):
    if i + 1 >= len(b):
        return None
    e = b[i + 1]["open"]
    s, t = e * (1 - stop / 100), e * (1 + target / 100)
    end = i + hold + late
    for k in range(i + first, min(end, len(b) - 1) + 1):
        if b[k]["low"] <= s:
            return k, "stop", min(s, b[k]["open"])
        if b[k]["high"] >= t:
            return k, "target", max(t, b[k]["open"])
    if len(b) - 1 < end and not close_short:
        return None
    k = min(end, len(b) - 1)
    return k, "time", b[k]["close"]


@pytest.mark.parametrize("clock", ["LABEL", "BACKTEST", "PAPER"])
def test_three_clocks_match_a_loop(spark, clock):
    px = [100.0]
    for i in range(1, 160):
        px.append(round(px[-1] * (1 + (((i * 7919) % 13) - 6) / 100), 2))
    rows = series("A", px, highs=[p * 1.02 for p in px], lows=[p * 0.97 for p in px], opens=[p * (1 + ((i % 5) - 2) / 200) for i, p in enumerate(px)])
    b = bars(spark, rows)
    c = getattr(outcomes, clock)
    got = {r["ix"]: (r["exit_ix"], r["why"], r["exit_px"]) for r in outcomes.barrier(outcomes.with_path(b, 11), 8.0, 12.0, 10, c).collect()}
    plain = [r.asDict() for r in b.orderBy("ix").collect()]
    want = {i: walk(plain, i, 8.0, 12.0, 10, c["first"], c["late"], c["close_short"]) for i in range(len(plain))}
    want = {i: w for i, w in want.items() if w}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:2] == w[:2] and got[i][2] == pytest.approx(w[2])


def test_moved_stop_fires_on_the_bar_that_moved_it(spark):
    b = bars(spark, series("A", [100] * 14, opens=[100] * 14, highs=[101, 101, 111] + [101] * 11, lows=[99, 99, 99] + [95] * 11))
    r = outcomes.moved_stop(outcomes.with_path(b, 11).filter("ix = 0"), 10.0, 1.0).first()
    assert (r["why"], r["exit_ix"]) == ("stop-moved", 2) and r["exit_px"] == pytest.approx(100)


def test_ladder_sells_in_order_and_keeps_the_rest(spark):
    b = bars(spark, series("A", [100] * 14, opens=[100] * 14, highs=[100, 100, 106, 112] + [100] * 10, lows=[99] * 14))
    t = outcomes.barrier(outcomes.with_path(b, 11).filter("ix = 0"), clock=outcomes.BACKTEST).withColumn("qty", F.lit(10))
    legs = [(r["leg_qty"], r["leg_why"], r["leg_px"]) for r in outcomes.ladder_legs(t, [(5.0, 0.5), (10.0, 0.3)]).orderBy("leg").collect()]
    assert [x[:2] for x in legs] == [(5, "partial"), (3, "partial"), (2, "time")]
    assert [round(x[2], 6) for x in legs] == [105, 110, 100]


def test_shadow_stop_refuses_zero(spark):
    with pytest.raises(ValueError):
        outcomes.shadow_stop(bars(spark, series("A", [1])), 0)


# --- evidence ---------------------------------------------------------------------


def ledger(spark, n=400, flip=False):
    rows = []
    for i in range(n):
        x = (i * 37) % 101
        late = i >= n // 2
        sign = -1 if flip and late else 1
        rows.append((f"s{i:04d}", i, float(x), 7.0, float(sign * (x - 50) / 10)))
    return spark.createDataFrame(rows, "symbol string, day int, rs double, liq double, ret double")


def test_information_ignores_a_constant_feature(spark):
    long = evidence.unpivot_features(ledger(spark), ("rs", "liq"))
    got = {r["feature"]: r for r in evidence.feature_information(long).collect()}
    assert got["rs"]["spread"] > 5 and got["liq"]["spread"] == 0 and got["liq"]["no_variance"]
    slab = {r["feature"]: r["spread"] for r in evidence.feature_information(long, slabs=40).collect()}
    assert slab == pytest.approx({k: v["spread"] for k, v in got.items()})


def test_split_check_sees_a_sign_flip(spark):
    ok = evidence.split_check(evidence.unpivot_features(ledger(spark), ("rs", "liq"))).collect()
    assert {r["feature"]: r["verdict"] for r in ok} == {"rs": "consistent", "liq": "none"}
    bad = evidence.split_check(evidence.unpivot_features(ledger(spark, flip=True), ("rs", "liq"))).collect()
    assert {r["feature"]: r["verdict"] for r in bad}["rs"] == "flips"


def test_exact_median_over_slabs(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [5, 1, 9, 3]] + [("b", float(x)) for x in [2, 2, 8]], "g string, x double")
    for slabs in (1, 5):
        assert {r["g"]: r["median"] for r in evidence.exact_median(df, "x", ["g"], slabs=slabs).collect()} == {"a": 4.0, "b": 2.0}


def test_blocks_reset_the_peak(spark):
    from datetime import date, timedelta

    rows = [("x", date(2020, 1, 1) + timedelta(days=i), e) for i, e in enumerate([100.0] * 10 + [50.0] * 15)]
    rows += [("x", date(2020, 7, 1) + timedelta(days=i), 50.0) for i in range(25)] + [("x", date(2021, 1, 1), 10.0)]
    got = {r["block"]: r["dd"] for r in evidence.block_drawdowns(spark.createDataFrame(rows, "arm string, day date, equity double")).collect()}
    assert got == {"2020H1": 50.0, "2020H2": 0.0}


def test_adoption_needs_every_condition(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, None)], "t double, m double")
    got = evidence.adoption(df, [("resolved", F.col("t") > 2), ("positive", F.col("m") > 0)]).orderBy("t").collect()
    assert (got[1]["adopt"], got[1]["failed"]) == (True, "") and (got[0]["adopt"], got[0]["failed"]) == (False, "resolved,positive")


def test_legs_merge_to_one_position(spark):
    df = spark.createDataFrame([(1, 50.0, 1000.0, "partial", 1), (1, 40.0, 1000.0, "time", 2), (2, -80.0, 1000.0, "stop", 3)], "pid int, net double, buy double, why string, leg_day int")
    got = {r["pid"]: (r["ret"], r["why"]) for r in evidence.merge_legs(df, ["pid"]).collect()}
    assert got == {1: (4.5, "partial+time"), 2: (-8.0, "stop")}
