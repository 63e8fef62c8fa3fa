import pytest
from pyspark.sql import functions as F
from toys import bars, column, series

from crosstape.functions import indicators as ind
from crosstape.functions.triggers import TRIGGERS


def test_plain_frames(spark):
    b = bars(spark, series("A", range(1, 9)))
    b = b.withColumn("sma", ind.sma("close", 3)).withColumn("top", ind.rolling_max("close", 3)).withColumn("z", ind.zscore("close", 3)).withColumn("up", ind.slope_up("close", 2))
    assert column(b, "sma") == [None, None, 2, 3, 4, 5, 6, 7]
    assert column(b, "top")[2:] == [3, 4, 5, 6, 7, 8]
    assert column(b, "z")[2] == pytest.approx(1.224744871)
    assert column(b, "up") == [None, None, True, True, True, True, True, True]


def test_flat_window_has_no_zscore(spark):
    assert column(bars(spark, series("A", [5.1] * 6)).withColumn("z", ind.zscore("close", 3)), "z") == [None] * 6


def test_true_range_first_bar_and_gap(spark):
    b = bars(spark, series("A", [10, 20, 15], highs=[11, 21, 16], lows=[9, 19, 14]))
    assert column(b.withColumn("tr", ind.true_range()), "tr") == [2, 11, 6]


def loop(xs, seed, at, a):
    y, out = None, []
    for i, x in enumerate(xs):
        y = seed if i == at else (None if i < at else y * (1 - a) + x * a)
        out.append(y)
    return out


@pytest.mark.parametrize("n", [2, 14, 50])
def test_ema_matches_a_loop_over_many_blocks(spark, n):
    xs = [100 + ((i * 37) % 23) - 11 + i * 0.1 for i in range(400)]
    got = column(ind.with_ema(bars(spark, series("A", xs), series("B", xs[:1])), "close", n, "e"), "e")
    want = loop(xs, sum(xs[:n]) / n, n - 1, 2 / (n + 1))
    assert all((g is None and w is None) or g == pytest.approx(w, rel=1e-12) for g, w in zip(got, want))


def test_atr_seed_ignores_first_range(spark):
    b = bars(spark, series("A", [10] * 6, highs=[50, 12, 12, 12, 12, 14], lows=[1, 9, 9, 9, 9, 9]))
    got = column(ind.with_atr(b, 3, "atr"), "atr")
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(3) and got[5] == pytest.approx((3 * 2 + 5) / 3)


def test_rsi_edges(spark):
    up = column(ind.with_rsi(bars(spark, series("A", range(1, 30))), 14, "r"), "r")
    assert up[:14] == [None] * 14 and up[14] == 100 and up[-1] == 100
    down = column(ind.with_rsi(bars(spark, series("A", range(60, 30, -1))), 14, "r"), "r")
    assert down[-1] == pytest.approx(0)


def test_skip_month_and_median(spark):
    b = bars(spark, series("A", range(1, 200)))
    m = column(b.withColumn("m", ind.bar_return(125, 21)), "m")
    assert m[145] is None and m[146] == pytest.approx(126 / 1 - 1)
    odd = ind.with_positive_median(b, "close", 3, "md")
    assert column(odd, "md")[:4] == [1, 1.5, 2, 3]


def test_triggers_fire_on_their_shape_only(spark):
    trend = [100 + i * 0.5 for i in range(120)]
    t = bars(spark, series("A", trend)).select("symbol", "ix", *[TRIGGERS[k]().alias(k.replace("+", "_")) for k in ("breakout", "volume", "flag", "asc_triangle", "cup_handle")])
    last = t.filter("ix = 119").first()
    assert not last["breakout"] and not last["volume"] and not last["flag"] and not last["cup_handle"]
    jump = bars(spark, series("A", trend[:-1] + [trend[-1] + 5], volumes=[1000] * 119 + [9000]))
    got = jump.select("ix", TRIGGERS["breakout"]().alias("b"), TRIGGERS["vol+breakout"]().alias("v")).filter("ix = 119").first()
    assert got["b"] and got["v"]


def test_flag_pattern(spark):
    base = [100.0] * 40
    pole = [100 + 2.0 * k for k in range(1, 21)]
    pause = [139, 138.5, 138, 138.5, 139]
    px = base + pole + pause
    b = bars(spark, series("A", px, highs=[p + 0.2 for p in px], lows=[p - 0.2 for p in px]))
    got = b.select("ix", TRIGGERS["flag"]().alias("f"), TRIGGERS["pattern"]().alias("p")).filter(F.col("ix") == len(px) - 1).first()
    assert got["f"] and got["p"]
    deep = px[:-5] + [130, 124, 118, 112, 106]
    d = bars(spark, series("A", deep, highs=[p + 0.2 for p in deep], lows=[p - 0.2 for p in deep]))
    assert not d.select("ix", TRIGGERS["flag"]().alias("f")).filter(F.col("ix") == len(px) - 1).first()["f"]


def test_cup_and_triangle(spark):
    left, bottom, right, handle = [100.0] * 15, [75.0] * 30, [99.0] * 15, [97.0] * 5
    px = [90.0] * 10 + left + bottom + right + handle
    b = bars(spark, series("A", px, highs=px, lows=[p - 0.1 for p in px]))
    assert b.select("ix", TRIGGERS["cup_handle"]().alias("c")).filter(F.col("ix") == len(px) - 1).first()["c"]
    tri = [100.0] * 30
    lows = [90.0] * 20 + [94.0] * 10
    t = bars(spark, series("A", tri, highs=[101.0] * 30, lows=lows))
    assert t.select("ix", TRIGGERS["asc_triangle"]().alias("c")).filter("ix = 29").first()["c"]
    flat = bars(spark, series("A", tri, highs=[101.0] * 30, lows=[90.0] * 30))
    assert not flat.select("ix", TRIGGERS["asc_triangle"]().alias("c")).filter("ix = 29").first()["c"]


def test_an_alias_named_like_an_input_changes_nothing(spark):
    b = bars(spark, series("A", [100 + (i * 7) % 13 for i in range(60)], volumes=[1000 + 3000 * (i % 3) for i in range(60)]))
    alone = [r["x"] for r in b.select("ix", TRIGGERS["volume"]().alias("x")).orderBy("ix").collect()]
    beside = b.select("ix", F.lit(0).alias("volume"), F.lit(0).alias("close"), F.lit(0).alias("high"), TRIGGERS["volume"]().alias("x"), ind.true_range().alias("tr"), ind.high_gap_pct(5).alias("gap"))
    rows = beside.orderBy("ix").collect()
    assert [r["x"] for r in rows] == alone and any(alone)
    assert rows[0]["tr"] == 2 and all(r["tr"] >= 2 for r in rows) and all(r["gap"] >= 0 for r in rows)
