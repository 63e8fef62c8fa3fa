"""What keeps a task's work the same on larger tables: partitions that follow the input, ranks that carry little."""

import pytest
from pyspark.sql import functions as F
from test_grown_tables import SF, Seen, joined_kinds

from crosstape.operators import evidence, ranking
from crosstape.plans import REGISTRY, common, evidence_plans
from crosstape.sources import derived, ledger
from crosstape.streaming import feeds, positions


@pytest.fixture
def grown(spark, monkeypatch):
    """The tables as written for the small input; from then on the input counts as one of 50 buckets."""
    common.trades(spark, SF)
    monkeypatch.setattr(ledger, "buckets", lambda *_: 50)


@pytest.mark.parametrize("name", ["tone_adoption", "signed_split", "random_sample_trades", "unconditioned_information"])
def test_samples_are_drawn_from_sampled_days_without_paths(spark, monkeypatch, name):
    def look(rows, *_, **__):
        raise Seen(rows)

    monkeypatch.setattr(evidence, "random_sample", look)
    with pytest.raises(Seen) as seen:
        REGISTRY[name].run(spark, SF)
    rows = seen.value.args[0]
    assert "path" not in rows.columns and rows.select("day").distinct().count() <= 120
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_a_sample_is_banded_as_the_whole_day(spark):
    keys = ["symbol", "day", "band", "size_rank"]
    drawn = evidence_plans.random_trades(spark, SF).select(*keys)
    assert drawn.count() > 50 and drawn.exceptAll(common.bands(spark, SF).select(*keys)).isEmpty()


def test_day_ranks_follow_the_input(spark, grown):
    assert common.bands(spark, SF).select("symbol", "day", "band").rdd.getNumPartitions() == 100


def test_bars_are_combined_without_a_sort(spark):
    plan = derived.bars_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_the_least_flag_as_a_number(spark):
    flags = [["R"], ["R", "R"], ["A", "R"], ["N"], ["R", "S"], ["S"], [None], [None, "R"], [None, "A", "R"], ["", "R"]]
    rows = spark.createDataFrame([(k, f) for k, fs in enumerate(flags) for f in fs], "k int, l_returnflag string")
    text, number = derived.HASHED_FLAG
    out = rows.groupBy("k").agg(F.expr(f"case when {text} then 1 else 0 end").alias("a"), F.expr(f"case when {number} then 1 else 0 end").alias("b")).collect()
    assert len(out) == len(flags) and all(r.a == r.b for r in out) and {r.a for r in out} == {0, 1}


def test_trades_join_no_paths(spark):
    kinds = joined_kinds(common.build_trades(spark, SF)._jdf.queryExecution().optimizedPlan())
    assert "string" in kinds and "array" not in kinds


def test_tables_are_written_in_partitions_that_follow_the_input(spark, grown):
    shuffle, split = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    before = [spark.conf.get(k) for k in (shuffle, split)]
    with pytest.raises(ValueError), ledger.sized(spark, SF):
        assert spark.conf.get(shuffle) == "100" and int(spark.conf.get(split)) == ledger.SPLIT_BYTES
        raise ValueError
    assert [spark.conf.get(k) for k in (shuffle, split)] == before
    assert [ledger._as_bytes(t) for t in ("134217728b", "16m", "1MB", "2g", "7")] == [1 << 27, 1 << 24, 1 << 20, 1 << 31, 7]


def test_official_bars_come_in_files_that_follow_the_input(spark, grown, monkeypatch):
    def look(*_, files=1, **__):
        raise Seen(files)

    monkeypatch.setattr(feeds, "write_in_order", look)
    with pytest.raises(Seen) as seen:
        REGISTRY["late_fills"].run(spark, SF)
    assert seen.value.args[0] == 50


def test_slabs_stay_apart(spark, grown):
    assert evidence_plans.slabs(spark, SF) == 50
    rows = spark.range(1000).withColumn("x", F.col("id") % 7)
    ranked = ranking.wide_ranked(rows, [], [F.col("x"), F.col("id")], "k", slabs=40)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert ", 40), REPARTITION_BY_NUM" in plan
    assert sorted(r.k for r in ranked.collect()) == list(range(1, 1001))


def test_position_state_follows_the_input(spark, monkeypatch):
    common.trades(spark, SF)
    monkeypatch.setattr(ledger, "buckets", lambda *_: 400)
    seen = {}
    monkeypatch.setattr(feeds, "write_in_order", lambda rows, path, parts, files: seen.update(files=files) or rows.limit(0).write.parquet(path))

    def look(events, path, checkpoint, partitions=None):
        raise Seen(partitions)

    monkeypatch.setattr(positions, "run_available", look)
    with pytest.raises(Seen) as stopped:
        REGISTRY["position_stream"].run(spark, SF)
    assert seen["files"] == stopped.value.args[0] == 100
