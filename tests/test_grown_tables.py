"""What holds on larger tables: what joins carry, sums that don't follow the partitions, rankings computed once."""

import pytest
import toys
from pyspark.sql import functions as F

from crosstape.functions import indicators as ind
from crosstape.operators import outcomes
from crosstape.plans import REGISTRY, common
from crosstape.sources import derived
from crosstape.streaming import feeds

SF = "/root/testdata/sf0.001"


def joined_kinds(plan):
    """Type names of all columns that reach a join, over the whole plan."""
    kinds = set()
    children = plan.children()
    for i in range(children.size()):
        child = children.apply(i)
        kinds |= joined_kinds(child)
        if plan.nodeName() == "Join":
            out = child.output()
            kinds |= {out.apply(k).dataType().typeName() for k in range(out.size())}
    return kinds


def test_structural_exits_joins_no_paths(spark):
    plan = REGISTRY["structural_exits"].run(spark, SF)._jdf.queryExecution().optimizedPlan()
    kinds = joined_kinds(plan)
    assert "string" in kinds and "array" not in kinds


def test_filings_do_not_follow_the_partitions(spark, tmp_path):
    """The same orders in another order and another number of files give the same cents."""
    orders = derived.table(spark, "/root/testdata/sf0.01", "orders")
    suppliers = derived.table(spark, SF, "supplier").limit(3)
    for name, rows in (("one", orders.coalesce(1)), ("many", orders.repartition(13, F.rand(7)))):
        rows.write.parquet(str(tmp_path / name / "orders.parquet"))
        suppliers.write.parquet(str(tmp_path / name / "supplier.parquet"))
    one, many = (derived.filings(spark, str(tmp_path / n)) for n in ("one", "many"))
    assert one.count() > 50
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["queue_stream", "late_fills", "burst_stream"])
def test_spans_of_a_feed_are_cut_from_files(spark, monkeypatch, name):
    """Rows are read several times per span, so nothing but files may stand behind them."""

    def look(rows, *_, **__):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(feeds, "write_in_order", look)
    with pytest.raises(Seen) as seen:
        REGISTRY[name].run(spark, SF)
    plan = str(seen.value)
    assert "Relation" in plan and not any(node in plan for node in ("Join", "Window", "Aggregate"))


def test_buckets_follow_the_input(spark, monkeypatch):
    """From 0.1 to 6 GB the per-symbol tables had eight to twelve buckets, so their tasks grew with the input."""
    from crosstape.sources import ledger

    for size in (500 << 20, 3 << 30):
        monkeypatch.setattr(ledger, "_source_bytes", lambda *_, size=size: size)
        assert size / ledger.buckets(spark, SF) <= 16 << 20


def test_ingest_and_features_share_the_exchange_by_symbol(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    laid = plan(derived.bars_query(spark, SF, 3))
    assert laid.count("Exchange hashpartitioning(symbol") == 1 and "Exchange hashpartitioning(symbol" not in plan(common.fresh_features(spark, SF))


def test_feature_frames_are_those_of_spark(spark):
    """Unknown, zero, negative and NaN values, flat and short series, symbols cut by batches: every value to the last bit."""
    odd = [None, 0.0, -3.0, float("nan"), 1e15, 0.1, 0.2, 0.3]
    rows = []
    for symbol, n in (("A", 1), ("B", 300), ("C", 7), ("D", 430), (None, 50)):
        for i, row in enumerate(toys.series(symbol, [100 + ((i * 37) % 23) * 0.1 for i in range(n)])):
            turnover = odd[i % 8] if symbol == "D" and i < 60 else 1e5 + (i * 7919) % 1013 + 0.3
            deliv = None if (symbol, i % 3) == ("B", 0) or symbol == "C" else (odd[i % 8] if symbol == "D" and i > 300 else 20 + (i * 31) % 17 + 0.7)
            rows.append((*row[:7], turnover, deliv, *row[9:]))
    b = spark.createDataFrame(rows, toys.BAR).repartition(3, F.rand(5))
    keep = ["symbol", "day", "size_med", "size_n", "liq", "deliv_mean", "off_high", "sma200", "vol_pct", "max_ret21"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = ind.with_features(b).select(keep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = ind.with_positive_median(ind.with_positive_median(b, "turnover", 251, "size_med", "size_n"), "turnover", 61, "liq").withColumn("ret1", ind.bar_return(1))
    want = want.withColumn("deliv_mean", ind.positive_mean("deliv_pct", 61)).withColumn("off_high", ind.high_gap_pct()).withColumn("sma200", ind.sma("close", 200))
    want = want.withColumn("vol_pct", F.when(F.col("liq").isNotNull(), ind.daily_vol_pct())).withColumn("max_ret21", F.max("ret1").over(ind.trailing(-20)))
    cells = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert len(got) == 788 and cells(got) == cells(want.select(keep).collect())


def test_a_days_rank_carries_no_paths(spark):
    def windows(plan):
        out = [plan] if plan.nodeName() == "Window" else []
        children = plan.children()
        for i in range(children.size()):
            out += windows(children.apply(i))
        return out

    plan = common.signals(spark, SF)._jdf.queryExecution().optimizedPlan()
    by_day = [w for w in windows(plan) if "(day#" in w.partitionSpec().toString()]
    outs = [w.output() for w in by_day]
    assert outs and not any(o.apply(k).dataType().typeName() == "array" for o in outs for k in range(o.size()))


def test_paths_of_some_bars_are_those_of_all(spark):
    b = toys.bars(spark, toys.series("A", range(1, 30)), toys.series("B", range(1, 3)))
    odd = F.col("ix") % 3 == 1
    all_, some = outcomes.with_path(b, 4).filter(odd), outcomes.with_path(b, 4, only=odd)
    rows = lambda df: sorted(str(r) for r in df.select("symbol", "ix", "path").collect())
    assert rows(some.filter(odd)) == rows(all_) and some.filter(~odd & F.col("path").isNotNull()).isEmpty()


def test_scores_count_their_groups_once(spark):
    text = common.scored(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("count(1) windowspecdefinition(day") == 2  # the bands' day and the scores' day and band
