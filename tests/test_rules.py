"""The rule grid's parts and the adoption bars."""

import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from crosstape.operators import book, evidence, outcomes
from crosstape.sources import files

from toys import bars, series

DAY = date(2024, 1, 1)


def test_ladder_return_is_that_of_the_merged_legs(spark):
    rows = [series(f"S{k}", [100 + ((i * (7 + k)) % 23) - 4 * k % 9 + i * (k - 2) / 4 for i in range(40)]) for k in range(6)]
    marked = outcomes.with_path(bars(spark, *rows), 20)
    lab = outcomes.barrier(marked, 6.0, 12.0, 15).withColumn("qty", F.lit(7)).filter("ix % 3 = 0")
    rungs = [(2.0, 0.5), (5.0, 0.3), (7.0, 0.9)]
    legs = outcomes.ladder_legs(lab, rungs).groupBy("symbol", "ix").agg(((F.sum(F.col("leg_qty") * F.col("leg_px")) / F.first(F.col("qty") * F.col("entry_px")) - 1) * 100).alias("r"))
    want = {(r.symbol, r.ix): r.r for r in legs.collect()}
    got = {(r.symbol, r.ix): r.ladder_ret for r in outcomes.ladder_return(lab, rungs).collect()}
    assert got.keys() == want.keys() and len(got) > 50 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_grid_deals_each_label_to_the_triggers_that_fired(spark):
    marked = outcomes.with_path(bars(spark, series("A", [100.0 + i % 5 for i in range(30)])), 20)
    triggers = {"odd": F.col("ix") % 2 == 1, "third": F.col("ix") % 3 == 0}
    marked = marked.withColumn("fired", outcomes.fired_bits(triggers, F.col("ix") == 9)).filter("fired > 0")
    exits = [{"a_stop": 5.0, "a_target": 5.0, "a_hold": 5}, {"a_stop": 50.0, "a_target": 50.0, "a_hold": 3}]
    got = outcomes.rule_grid(marked, list(triggers), exits, [(1.0, 0.5)], 1000.0).collect()
    cells = {(r.ix, r.trigger, r.a_hold, r.ladder) for r in got}
    fired = [(i, t) for i in range(29) for t, hit in (("odd", i % 2 == 1), ("third", i % 3 == 0)) if hit and i != 9]
    assert len(got) == len(cells) and cells == {(i, t, h, x) for i, t in fired for h in (5, 3) for x in (False, True)}


def facts(spark, **kw):
    base = dict(arm="x", gap=2.0, gap_t=3.0, micro=1.0, small=1.0, worst=-5.0, names=9, top1=10.0, maxdd=20.0, runs_one_way=True, t=-3.0, mean_diff=-1.0, median_diff=-0.5, loo_t=-2.0, c_micro=0.0, c_small=0.0, c_worst=-6.0, c_names=9, c_top1=10.0, c_maxdd=18.0)
    row = base | kw
    kind = lambda v: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "double"
    values = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in row.values()]
    return spark.createDataFrame([values], ", ".join(f"{k} {kind(base[k])}" for k in row))


def test_each_bar_names_what_failed(spark):
    lit = F.lit
    rules = {
        "seats": evidence.seats_rule(), "pooled": evidence.pooled_rule(), "pattern": evidence.pattern_rule(lit(1.0)),
        "falls": evidence.falls_rule(lit(0.2)), "exit": evidence.exit_rule(lit(0.5)),
    }
    failed = lambda rule, **kw: evidence.adoption(facts(spark, **kw), rules[rule]).first().failed
    assert {r: failed(r) for r in rules} == dict.fromkeys(rules, "")
    assert failed("seats", gap_t=-2.0, runs_one_way=False, small=0.0, maxdd=21.5) == "resolved,one_way,both_bands,no_deeper_fall"
    assert failed("pooled", gap_t=-3.0, worst=-7.0, top1=11.0, names=8, t=2.5) == "better,worst_block,concentration,breadth,block_falls"
    assert failed("pattern", gap=1.0, gap_t=2.5, micro=0.0) == "resolved,both_bands,not_looser"
    assert failed("falls", t=3.0, mean_diff=1.0, gap_t=-2.5) == "resolved,not_one_episode,no_return_cost"
    assert failed("exit", gap=1.0, worst=-6.5) == "worst_block,not_longer"
    # Unknown is failed.
    assert failed("seats", gap_t=None) == "resolved"
    tone = spark.createDataFrame([(2.7, 1.0, 0.5, 0.1, 1.0, 2.0), (2.7, 1.0, 1.0, -0.4, 1.0, -2.0)], "t double, spread double, category_spread double, echo double, micro double, small double")
    assert [r.failed for r in evidence.adoption(tone, evidence.tone_rule()).collect()] == ["", "beats_category,not_momentum,one_sign"]


def test_arm_facts_against_plain_sums(spark):
    rows = [(a, f"S{i % 4}", ("micro", "small")[i % 2], DAY + timedelta(days=40 * i), float((i * 7 + len(a)) % 11 - 4)) for a in ("c", "up", "upup") for i in range(12)]
    got = {r.arm: r for r in evidence.arm_facts(spark.createDataFrame(rows, "arm string, symbol string, band string, exit_day date, ret double"), "c", ["c", "up", "upup"]).collect()}
    mean = lambda a, b=None: (lambda v: sum(v) / len(v))([r[4] for r in rows if r[0] == a and b in (None, r[2])])
    for a, r in got.items():
        blocks, names = {}, {}
        for _, s, _, d, x in (q for q in rows if q[0] == a):
            blocks[d.year, d.month > 6] = blocks.get((d.year, d.month > 6), 0) + x
            names[s] = names.get(s, 0) + x
        assert abs(r.gap - (mean(a) - mean("c"))) < 1e-9 and abs(r.micro - mean(a, "micro")) < 1e-9 and abs(r.c_small - mean("c", "small")) < 1e-9
        assert r.worst == min(blocks.values()) and r.names == 4 and abs(r.top1 - max(max(names.values()), 0) / sum(max(v, 0) for v in names.values()) * 100) < 1e-9
    gaps = [got[a].gap for a in ("c", "up", "upup")]
    assert got["up"].runs_one_way == (gaps == sorted(gaps) or gaps == sorted(gaps, reverse=True))


def test_orders_that_wait_too_long(spark):
    rows = [("pending", 0), ("pending", 5), ("pending", 6), ("open", 0), ("closed", 0)]
    state = spark.createDataFrame([(s, DAY + timedelta(days=10 - n)) for s, n in rows], "status string, queued_on date")
    assert tuple(evidence.stale_pending(state, F.lit(DAY + timedelta(days=10))).first()) == (3, 1)
    assert tuple(evidence.stale_pending(state, F.lit(DAY + timedelta(days=30))).first()) == (3, 3)


def test_filing_contexts_and_odd_values(spark):
    doc = """<?xml version="1.0"?><x:xbrl xmlns:x="urn:x" xmlns:f="urn:f" xmlns:d="urn:d">
    <x:context id="A"><x:period><x:startDate> 2024-01-01 </x:startDate><x:endDate>2024-03-31</x:endDate></x:period></x:context>
    <x:context id="B"><x:scenario><d:explicitMember dimension="q">m</d:explicitMember></x:scenario><x:period><x:startDate>2024-01-01</x:startDate><x:endDate>2024-03-31</x:endDate></x:period></x:context>
    <f:Expenses contextRef="B">1</f:Expenses><f:Expenses contextRef="A">n/a</f:Expenses><f:Expenses contextRef="A"> 2.5 </f:Expenses><f:Expenses contextRef="none">3</f:Expenses><f:Other contextRef="A">9</f:Other></x:xbrl>"""
    df = spark.createDataFrame([("p", bytearray(doc.encode())), ("empty", bytearray(b"")), ("null", None)], "path string, content binary")
    assert [tuple(r) for r in files.xbrl_facts(df).collect()] == [("p", "2024-01-01", "2024-03-31", "expenses", 2, 2.5)]


def test_assertions_count_by_frame(spark):
    rows = spark.createDataFrame([(1, True), (2, None), (3, False)], "n int, flag boolean")
    nothing = rows.filter("n > 5")
    got = book.assertions([
        rows.agg(F.count_if(F.col("n") > 1).alias("n is one"), F.count_if(F.col("flag")).alias("not flagged")),
        nothing.agg(F.sum("n").alias("of no rows")), rows.agg(F.count_if(F.col("n") > 9).alias("n.small")),
    ])
    assert {r.rule: (r.ok, r.violations) for r in got.collect()} == {"n is one": (False, 2), "not flagged": (False, 1), "of no rows": (True, 0), "n.small": (True, 0)}


def test_tone_facts_against_plain_sums(spark):
    rows = [(f, DAY, f"S{i}", ("micro", "small")[i % 2], float((i * 5) % 7 - 2), float((i * 3) % 11), x) for i in range(24) for f, x in (("ann_burst", float((i * 7) % 13)), ("ann_tone", float(i % 3 - 1)), ("ann_flag", float(i % 4 == 0)))]
    long = spark.createDataFrame(rows, "feature string, day date, symbol string, band string, ret double, rs_raw double, x double")
    got = {r.feature: r for r in evidence.tone_facts(long, "ann_flag", "rs_raw").collect()}
    assert set(got) == {"ann_burst", "ann_tone"}
    mean = lambda v: sum(v) / len(v)

    def spread(f, band=None):
        own = [r for r in rows if r[0] == f]
        med = statistics.median(r[6] for r in own)
        hi = {"ann_tone": lambda x: x > 0, "ann_flag": lambda x: x > 0}.get(f, lambda x: x > med)
        lo = {"ann_tone": lambda x: x < 0, "ann_flag": lambda x: x == 0}.get(f, lambda x: x <= med)
        side = lambda ok: mean([r[4] for r in own if ok(r[6]) and band in (None, r[3])])
        return side(hi) - side(lo)

    for f, r in got.items():
        want = [spread(f), spread(f, "micro"), spread(f, "small"), spread("ann_flag"), statistics.correlation(*zip(*[(q[6], q[5]) for q in rows if q[0] == f], strict=True))]
        assert [r.spread, r.micro, r.small, r.category_spread, r.echo] == pytest.approx(want)
