"""Labels of picks move no bars, and sums that an order reads don't follow the shuffle."""

import pytest
import toys
from pyspark.sql import functions as F

from crosstape.functions import indicators as ind
from crosstape.operators import evidence, outcomes
from crosstape.plans import REGISTRY, common, evidence_plans

SF = "/root/testdata/sf0.001"


def joined_types(plan):
    """Types of all columns that reach a join, over the whole plan."""
    types, children = set(), plan.children()
    for i in range(children.size()):
        types |= joined_types(children.apply(i))
        if plan.nodeName() == "Join":
            out = children.apply(i).output()
            types |= {out.apply(k).dataType().simpleString() for k in range(out.size())}
    return types


@pytest.mark.parametrize("name", ["pooled_vs_band", "literature_variants", "weight_variants", "depth_slope", "cohort_report"])
def test_no_path_of_a_pick_reaches_a_join(spark, name):
    types = joined_types(REGISTRY[name].run(spark, SF)._jdf.queryExecution().optimizedPlan())
    assert "string" in types and not any("array<struct" in t for t in types)


def test_picks_are_labelled_as_all_bars(spark):
    """A bar of two arms, of one, and picks without a bar or with none after them."""
    every = common.features(spark, SF).select("symbol", "day", "ix")
    odd = every.filter("ix % 50 = 3").withColumn("arm", F.lit("a"))
    last = every.groupBy("symbol").agg(F.max("day").alias("day"), F.max("ix").alias("ix")).withColumn("arm", F.lit("a"))
    stray = last.withColumn("symbol", F.lit("none"))
    picks = odd.unionByName(every.filter("ix % 100 = 3").withColumn("arm", F.lit("b"))).unionByName(last).unionByName(stray)
    keep = ["symbol", "day", "ix", "arm", "entry_px", "exit_day", "why", "ret"]
    paths = outcomes.with_path(common.features(spark, SF), 10).select("symbol", "day", "path")
    want = outcomes.barrier(picks.join(paths, ["symbol", "day"])).select(keep)
    got = evidence_plans._label_picks(spark, SF, picks).select(keep)
    assert got.count() > 150 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.fixture
def twins(spark, monkeypatch):
    """Forty symbols with the same trades, whose rows arrive in any order."""
    returns = [-10.0, 20.0, 0.1, 3.3, -7.7, 1e-3, 11.1, -0.7, 2.2, 19.9, -9.3, 5.6]
    rows = [(f"S{k:02d}", i, r) for k in range(40) for i, r in enumerate(returns)]
    day = F.expr("date_add(date '2020-01-01', i)")
    dealt = spark.createDataFrame(rows, "symbol string, i int, ret double").withColumn("day", day).repartition(13, F.rand(3)).localCheckpoint()
    monkeypatch.setattr(evidence_plans, "trades", lambda *_: dealt)
    return [f"S{k:02d}" for k in range(40)]


def test_symbols_with_the_same_trades_stand_in_their_own_order(spark, twins):
    got = REGISTRY["per_symbol"].run(spark, SF).orderBy("place").collect()
    assert [r.symbol for r in got] == twins and {(r.n, r.wins) for r in got} == {(12, 8)}
    sides = REGISTRY["top_and_bottom"].run(spark, SF).collect()
    assert [r.symbol for r in sides] == [*twins[:5], *twins[:-6:-1]]


def test_ordered_sums_skip_unknown_returns(spark):
    rows = [("A", 1, 1.5), ("A", 2, None), ("A", 3, -0.5), ("B", 1, None), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, day int, ret double")
    kinds = [evidence.attribution(df, "symbol", order=order).select("symbol", "n", "total", "avg", "wins") for order in ((), ("day",))]
    assert sorted(map(str, kinds[0].collect())) == sorted(map(str, kinds[1].collect()))


def walked(xs, n, at, alpha):
    total, y, out = 0.0, None, []
    for i, x in enumerate(xs):
        if at - n < i <= at:
            total += x
        y = total / n if i == at else None if y is None else y * (1.0 - alpha) + x * alpha
        out.append(y)
    return out


def test_means_are_walked_bar_by_bar(spark):
    """To the last bit, over batches that cut symbols: a close that stays at its mean is decided by it."""
    closes = {s: [100 + ((i * k) % 23) * 0.37 if i < 30 else 103.1 for i in range(n)] for s, k, n in (("A", 37, 200), ("B", 11, 7), ("C", 29, 90))}
    b = toys.bars(spark, *[toys.series(s, xs) for s, xs in closes.items()]).repartition(3, F.rand(5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = ind.with_means(b, ema={"e": ("close", 20)}, rsi={"r": 14}).orderBy("symbol", "ix").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for symbol, xs in closes.items():
        moves = [0.0] + [b - a for a, b in zip(xs, xs[1:])]
        up, dn = (walked([max(s * m, 0.0) for m in moves], 14, 14, 1.0 / 14) for s in (1, -1))
        assert [r.e for r in rows if r.symbol == symbol] == walked(xs, 20, 19, 2.0 / 21)
        assert [r.r for r in rows if r.symbol == symbol] == [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, dn)]


def test_a_mean_stays_unknown_after_an_unknown_close(spark):
    b = toys.bars(spark, toys.series("A", range(1, 10)), toys.series("B", range(1, 10))).withColumn("close", F.when((F.col("symbol") == "B") | (F.col("ix") != 5), F.col("close")))
    rows = ind.with_ema(b, "close", 3, "e").orderBy("symbol", "ix").collect()
    assert [r.e is None for r in rows] == [True] * 2 + [False] * 3 + [True] * 4 + [True] * 2 + [False] * 7
