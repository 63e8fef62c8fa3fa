"""Fills, costs, gates and outcome labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs
from ..functions import indicators as ind
from ..functions.frames import series
from ..functions.triggers import TRIGGERS
from ..operators import outcomes, ranking, selection, universe
from . import oracle as o
from .common import bars, candidates, corpus, denylist, features, signals, trades
from .spec import query

LABEL_COLS = "symbol:s day:d band:s entry_day:d entry_px:f exit_day:d exit_px:f why:s ret:f"


@query(
    "impact_and_charges", "F1 F2 F3", "symbol:s day:d impact:f buy_charge:f sell_charge:f slip_bps:f",
    o.sql("feat", f"select symbol, day, {o.impact('(45000e0)')} as impact, {o.charge('turnover', 'BUY')} as buy_charge, {o.charge('turnover', 'SELL')} as sell_charge, "
                  "case when turnover <= 0 then 50e0 else 5e0 + 10e0 * (10000e0 / turnover / 0.01e0) end as slip_bps from feat"),
)
def impact_and_charges(spark, sf):
    v = F.col("turnover")
    return features(spark, sf).select(
        "symbol", "day", costs.impact_pct(F.lit(45000.0), F.col("liq"), F.col("vol_pct")).alias("impact"),
        costs.charge(v, "BUY").alias("buy_charge"), costs.charge(v, "SELL").alias("sell_charge"),
        costs.slippage_bps(F.lit(10000.0), v).alias("slip_bps"),
    )


# Order levels on each bar: entry at the close, stop 6% below, target 19% above.
GATE_CTE = f"""ord as materialized (select *, close as entry, close * 0.94e0 as stp, close * 1.19e0 as tgt, case when ix % 7 = 0 then 0.058e0 else 0e0 end as heat from bars),
sz as materialized (select *, entry - stp as risk, floor(300000e0 * 0.005e0 / (entry - stp)) as rq, floor(0.01e0 * turnover / entry) as lq, least(floor(300000e0 * 0.005e0 / (entry - stp)), floor(0.01e0 * turnover / entry)) as q from ord),
gated as materialized (select symbol, day, rq, lq, (tgt - entry) / risk as rr,
  case when entry <= stp then 'stop_above_entry' when (tgt - entry) / risk < 3e0 - 1e-9 then 'rr_below_3.0' when asm is not null then 'asm:' || asm
    when gsm is not null then 'gsm:' || gsm when fo_ban then 'fo_ban' when high = low then 'circuit_locked' when rq < 1 then 'risk_qty_zero' when lq < 1 then 'illiquid'
    when {o.charge('(q * entry)', 'BUY')} + {o.charge('(q * tgt)', 'SELL')} > 0.1e0 * q * risk then 'costs_exceed_risk'
    when heat + q * risk / 300000e0 > 0.06e0 then 'portfolio_heat' end as reason from sz)"""


def _gated(spark, sf):
    entry, stop, target = F.col("close"), F.col("close") * 0.94, F.col("close") * 1.19
    heat = F.when(F.col("ix") % 7 == 0, 0.058).otherwise(0.0)
    return bars(spark, sf).select(
        "symbol", "day", costs.risk_qty(entry, stop, F.lit(300_000.0)).alias("rq"), costs.liquidity_qty(entry, F.col("turnover")).alias("lq"),
        costs.reward_risk(entry, stop, target).alias("rr"), costs.gate_reason(entry, stop, target, F.lit(300_000.0), heat).alias("reason"),
    )


@query("gate_reasons", "B8 F4 F6", "symbol:s day:d rq:i lq:i rr:f reason:s", o.sql("bars", "select * from gated", GATE_CTE))
def gate_reasons(spark, sf):
    return _gated(spark, sf)


@query("reject_histogram", "F7", "reason:s n:i", o.sql("bars", "select reason, count(*) as n from gated where reason is not null group by reason", GATE_CTE))
def reject_histogram(spark, sf):
    return _gated(spark, sf).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason")


@query(
    "gap_aware_fills", "F5", "symbol:s day:d entry_at:f stop_at:f target_at:f",
    o.sql(
        "bars",
        f"""select symbol, day, case when high <> low and high >= 1.02e0 * pc then greatest(1.02e0 * pc, open) end as entry_at,
           case when high <> low and low <= 0.97e0 * pc then least(0.97e0 * pc, open) end as stop_at,
           case when high <> low and high >= 1.05e0 * pc then greatest(1.05e0 * pc, open) end as target_at
           from (select *, lag(close) over ({o.S}) as pc from bars)""",
    ),
)
def gap_aware_fills(spark, sf):
    rows = bars(spark, sf).withColumn("pc", F.lag("close", 1).over(series()))
    pc = F.col("pc")
    return rows.select(
        "symbol", "day", costs.entry_fill(pc * 1.02).alias("entry_at"), costs.stop_fill(pc * 0.97).alias("stop_at"), costs.target_fill(pc * 1.05).alias("target_at")
    )


@query("barrier_labels", "G1", LABEL_COLS, o.sql("label", "select * from label"))
def barrier_labels(spark, sf):
    return outcomes.barrier(signals(spark, sf))


@query(
    "held_volatility", "G2", "symbol:s day:d stopped:b held_vol:f",
    o.sql(
        "label",
        """select symbol, day, why = 'stop' as stopped, v.held_vol from label l left join (
             select l2.symbol as vs, l2.ix as vi, case when count(*) >= 3 then stddev_pop(b.close / a.close - 1e0) * 100 end as held_vol from label l2
             join bars b on b.symbol = l2.symbol and b.ix between l2.ix + 2 and l2.exit_ix join bars a on a.symbol = b.symbol and a.ix = b.ix - 1 group by 1, 2) v
             on v.vs = l.symbol and v.vi = l.ix""",
    ),
)
def held_volatility(spark, sf):
    return outcomes.held_volatility(outcomes.barrier(signals(spark, sf)))


@query("backtest_labels", "G3 G9", LABEL_COLS + " held:i", o.sql("signals bars", "select *, greatest(exit_ix - (ix + 1), 0) as held from bt", o.label_cte("bt", "signals", late=1, close_short=False)))
def backtest_labels(spark, sf):
    return outcomes.barrier(signals(spark, sf), clock=outcomes.BACKTEST).withColumn("held", outcomes.bars_held(F.col("exit_ix")))


@query("paper_labels", "G4 G9", LABEL_COLS + " held:i", o.sql("signals bars", "select *, greatest(exit_ix - (ix + 1), 0) as held from pl", o.label_cte("pl", "signals", first=2, late=1, close_short=False)))
def paper_labels(spark, sf):
    return outcomes.barrier(signals(spark, sf), clock=outcomes.PAPER).withColumn("held", outcomes.bars_held(F.col("exit_ix")))


@query(
    "atr_stop_labels", "G5", LABEL_COLS,
    o.sql("signals atr14", "select * from al", "asig as materialized (select s.*, a.y as atr from signals s join atr14 a using (symbol, ix))",
          o.label_cte("al", "asig", late=1, close_short=False, stop_px="(e.open - 2e0 * s.atr)").replace("where e.open > 0", "where e.open > 0 and e.open - 2e0 * s.atr > 0", 1)),
)
def atr_stop_labels(spark, sf):
    atr = ind.with_atr(bars(spark, sf), 14, "atr").select("symbol", "day", "atr")
    rows = signals(spark, sf).join(atr, ["symbol", "day"]).filter(F.col("atr").isNotNull())
    return outcomes.barrier(rows, clock=outcomes.BACKTEST, stop_px=F.col("entry_px") - 2.0 * F.col("atr"))


MOVED = """mv0 as materialized (select s.*, e.open as entry_px, e.day as entry_day, e.open * (1 - 10e0 / 100) as sp, e.open * (1 + 20e0 / 100) as tp,
  e.open * (1 + 8e0 / 100) as mp, e.open * (1 + 1e0 / 100) as np from signals s join bars e on e.symbol = s.symbol and e.ix = s.ix + 1),
mv1 as materialized (select m.*, b.ix as bix, b.day as bday, b.open as bo, b.high as bh, b.low as bl, b.close as bc,
  min(case when b.high >= mp and b.low > sp then b.ix end) over (partition by m.symbol, m.ix) as mix,
  max(b.ix) over (partition by m.symbol, m.ix) as last_ix from mv0 m join bars b on b.symbol = m.symbol and b.ix between m.ix + 1 and m.ix + 11),
mv2 as materialized (select *, coalesce(bix >= mix, false) as mvd, min(case when bl <= (case when bix >= mix then np else sp end) or bh >= tp then bix end) over (partition by symbol, ix) as hit from mv1),
mv as materialized (select symbol, day, band, entry_day, entry_px, bday as exit_day,
  case when hit is null then 'time' when not mvd and bl <= sp then 'stop' when mvd and bl <= np then 'stop-moved' else 'target' end as why,
  case when hit is null then bc when not mvd and bl <= sp then least(sp, bo) when mvd and bl <= np then least(np, bo) else greatest(tp, bo) end as exit_px
  from mv2 where bix = coalesce(hit, ix + 11))"""


@query("moved_stop_labels", "G6", LABEL_COLS, o.sql("signals bars", "select *, (exit_px / entry_px - 1) * 100 as ret from mv", MOVED))
def moved_stop_labels(spark, sf):
    return outcomes.moved_stop(signals(spark, sf), 8.0, 1.0)


LADDER = """bq as materialized (select *, floor(225000e0 / 5 / entry_px) as q0, case when why = 'stop' then exit_ix - 1 else exit_ix end as lx from bt),
rg as materialized (select q.symbol, q.ix, r.leg, q.entry_px * (1 + r.pct / 100) as lvl, least(floor(q.q0 * 0.5e0), q.q0) as want, min(b.ix) as hix
  from bq q, (values (0, 6e0), (1, 12e0)) r(leg, pct), bars b where b.symbol = q.symbol and b.ix between q.ix + 1 and q.lx and b.high >= q.entry_px * (1 + r.pct / 100)
  group by 1, 2, 3, 4, 5),
lg as materialized (select q.symbol, q.day, q.ix, g.leg, cast(g.want as bigint) as leg_qty, greatest(g.lvl, b.open) as leg_px, b.day as leg_day, 'partial' as leg_why
  from rg g join bq q using (symbol, ix) join bars b on b.symbol = g.symbol and b.ix = g.hix where g.want >= 1
  union all select symbol, day, ix, 2, cast(q0 - coalesce((select sum(want) from rg g where g.symbol = bq.symbol and g.ix = bq.ix), 0) as bigint), exit_px, exit_day, why from bq
  where q0 - coalesce((select sum(want) from rg g where g.symbol = bq.symbol and g.ix = bq.ix), 0) >= 1)"""


def _ladder(spark, sf):
    rows = outcomes.barrier(signals(spark, sf), clock=outcomes.BACKTEST).withColumn("qty", F.floor(F.lit(225_000.0) / 5 / F.col("entry_px")))
    return outcomes.ladder_legs(rows, [(6.0, 0.5), (12.0, 0.5)])


@query("ladder_legs", "G7", "symbol:s day:d leg:i leg_qty:i leg_px:f leg_day:d leg_why:s",
       o.sql("signals bars", "select * from lg", o.label_cte("bt", "signals", late=1, close_short=False), LADDER))
def ladder_legs(spark, sf):
    return _ladder(spark, sf)


STRUCT = f"""shp as materialized (select b.*, coalesce(b.close > e.y and b.ix >= 9 and max(b.high) over (partition by b.symbol order by b.day rows between 4 preceding and current row)
    >= max(b.high) over (partition by b.symbol order by b.day rows between 9 preceding and 5 preceding), false) as shape_ok, a.y as atr
  from bars b left join ema20 e using (symbol, ix) left join atr14 a using (symbol, ix)),
st0 as materialized (select s.symbol, s.ix, s.day, s.band, e.open as entry_px, e.day as entry_day, e.open * (1 - 10e0 / 100) as sp, e.open * (1 + 20e0 / 100) as tp, e.atr as a0
  from signals s join shp e on e.symbol = s.symbol and e.ix = s.ix + 1),
st1 as materialized (select t.*, b.ix as bix, b.day as exit_day, b.open as bo, b.low as bl, b.high as bh, b.close as bc,
  min(case when b.low <= sp or b.high >= tp or b.ix - t.ix - 1 >= 30 or (b.ix - t.ix - 1 >= 10 and (not b.shape_ok or coalesce(a0 > 0 and b.atr > 1.5e0 * a0, false))) then b.ix end)
    over (partition by t.symbol, t.ix) as hit from st0 t join shp b on b.symbol = t.symbol and b.ix between t.ix + 1 and t.ix + 31),
st as materialized (select *, case when bl <= sp then 'stop' when bh >= tp then 'target' when bix - ix - 1 >= 30 then 'time-capped' else 'structure' end as why,
  case when bl <= sp then least(sp, bo) when bh >= tp then greatest(tp, bo) else bc end as exit_px from st1 where bix = hit)"""


@query("structural_exits", "G8", LABEL_COLS, o.sql("signals ema20 atr14", "select *, (exit_px / entry_px - 1) * 100 as ret from st", STRUCT))
def structural_exits(spark, sf):
    # Paths stay in the symbol's partition: every bar ranks, but only labels of signals and their bands meet in the join.
    hit = F.col("trig") & ~F.col("locked")
    rows = corpus(spark, sf)
    shaped = outcomes.with_structure(ind.with_means(rows, ema={"ema20": ("close", 20)}, atr={"atr": 14}))
    labelled = outcomes.structural_exit(outcomes.with_path(shaped, 31, ("shape_ok", "atr")).filter(hit))
    banded = ranking.size_bands(rows).filter(hit).select("symbol", "day", "band")
    return labelled.select("symbol", "day", "entry_day", "entry_px", "exit_day", "exit_px", "why", "ret").join(banded, ["symbol", "day"])


@query(
    "shadow_stop", "G10", "symbol:s day:d level:f shadow_hit:b shadow_day:d",
    o.sql(
        "signals bars",
        "select symbol, day, entry_px * (1 - 5e0 / 100) as level, shadow_day is not null as shadow_hit, shadow_day from sh",
        o.label_cte("pl", "signals", first=2, late=1, close_short=False),
        """sh as materialized (select p.symbol, p.day, p.ix, p.entry_px, min(b.day) filter (where b.low <= p.entry_px * (1 - 5e0 / 100)) as shadow_day
           from pl p left join bars b on b.symbol = p.symbol and b.ix > p.ix + 1 and b.ix <= p.exit_ix group by all)""",
    ),
)
def shadow_stop(spark, sf):
    return outcomes.shadow_stop(outcomes.barrier(signals(spark, sf), clock=outcomes.PAPER), 5.0)


ARMS = [
    {"arm": "s10_t20_h10", "a_stop": 10.0, "a_target": 20.0, "a_hold": 10}, {"arm": "s5_t20_h10", "a_stop": 5.0, "a_target": 20.0, "a_hold": 10},
    {"arm": "s10_t10_h10", "a_stop": 10.0, "a_target": 10.0, "a_hold": 10}, {"arm": "s10_t20_h20", "a_stop": 10.0, "a_target": 20.0, "a_hold": 20},
]
ARM_NAMES = [a["arm"] for a in ARMS]
ARM_VALUES = ", ".join(f"('{a['arm']}', {a['a_stop']}e0, {a['a_target']}e0, {a['a_hold']})" for a in ARMS)
ARM_CTES = (
    f"arms as materialized (select s.*, a.* from signals s, (values {ARM_VALUES}) a(arm, a_stop, a_target, a_hold))",
    o.label_cte("al", "arms", stop="s.a_stop", target="s.a_target", hold="a_hold", keys="arm").replace("s.ix + a_hold", "s.ix + s.a_hold").replace("t.ix + a_hold", "t.ix + t.a_hold"),
)


def arm_trades(spark, sf):
    """Every signal under every exit rule of the grid."""
    rows = outcomes.arm_grid(signals(spark, sf, 20), ARMS)
    return outcomes.barrier(rows, F.col("a_stop"), F.col("a_target"), F.col("a_hold"))


@query(
    "rule_sweep", "G11", "arm:s why:s n:i mean:f",
    o.sql("signals bars", "select arm, why, count(*) as n, avg(ret) as mean from al group by 1, 2", *ARM_CTES),
)
def rule_sweep(spark, sf):
    return arm_trades(spark, sf).groupBy("arm", "why").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"))


GRID_TRIGGERS = ("none", "volume", "breakout", "vol+breakout")
GRID_EXITS = [{"a_stop": stop, "a_target": target, "a_hold": hold} for stop in (5.0, 10.0) for target in (10.0, 20.0) for hold in (10, 20)]
GRID_VALUES = ", ".join(f"({e['a_stop']}e0, {e['a_target']}e0, {e['a_hold']})" for e in GRID_EXITS)
RUNGS = [(6.0, 0.5), (12.0, 0.5)]
GRID = (
    f"gtr as materialized (select symbol, ix, {o.VOLUME} as volume_up, {o.BREAKOUT} as broke from bars)",
    f"""gsg as materialized (select c.symbol, c.day, c.ix, floor((c.band_rank - 1) / case c.band when 'micro' then 3 else 2 end) as cohort, c.locked, t.volume_up, t.broke, a.*
      from cands c join gtr t using (symbol, ix), (values {GRID_VALUES}) a(a_stop, a_target, a_hold) where floor((c.band_rank - 1) / case c.band when 'micro' then 3 else 2 end) < 6)""",
    o.label_cte("gl", "gsg", stop="s.a_stop", target="s.a_target", hold="a_hold", keys="a_stop, a_target, a_hold").replace("s.ix + a_hold", "s.ix + s.a_hold").replace("t.ix + a_hold", "t.ix + t.a_hold"),
    """gq as materialized (select *, floor(45000e0 / entry_px) as q0, case when why = 'stop' then exit_ix - 1 else exit_ix end as lx from gl where floor(45000e0 / entry_px) >= 1),
    grg as materialized (select q.symbol, q.ix, q.a_stop, q.a_target, q.a_hold, r.leg, q.entry_px * (1 + r.pct / 100) as lvl, floor(q.q0 * 0.5e0) as want, min(b.ix) as hix
      from gq q, (values (0, 6e0), (1, 12e0)) r(leg, pct), bars b where b.symbol = q.symbol and b.ix between q.ix + 1 and q.lx and b.high >= q.entry_px * (1 + r.pct / 100) group by all),
    gsold as materialized (select g.symbol, g.ix, g.a_stop, g.a_target, g.a_hold, sum(want) as sold, sum(want * greatest(lvl, b.open)) as taken from grg g join bars b on b.symbol = g.symbol and b.ix = g.hix group by all),
    gcell as materialized (select q.*, ret as flat_ret, ((coalesce(taken, 0e0) + (q0 - coalesce(sold, 0)) * exit_px) / (q0 * entry_px) - 1) * 100 as ladder_ret
      from gq q left join gsold using (symbol, ix, a_stop, a_target, a_hold)),
    gt as materialized (select *, 'none' as trigger from gcell where not locked union all select *, 'volume' from gcell where not locked and volume_up
      union all select *, 'breakout' from gcell where not locked and broke union all select *, 'vol+breakout' from gcell where not locked and volume_up and broke)""",
)


def grid_trades(spark, sf):
    """Candidates of six rank cohorts under every trigger, exit and ladder state."""
    places = selection.cohorts(candidates(spark, sf)).select("symbol", "day", "cohort")
    rows = corpus(spark, sf).withColumn("fired", outcomes.fired_bits({t: TRIGGERS[t]() for t in GRID_TRIGGERS}, F.col("locked")))
    marked = outcomes.with_path(rows.join(places, ["symbol", "day"], "left"), 20).filter("cohort is not null and fired > 0")
    return outcomes.rule_grid(marked.select("symbol", "day", "ix", "cohort", "fired", "path"), list(GRID_TRIGGERS), GRID_EXITS, RUNGS, 45_000.0)


@query(
    "rule_grid", "G11", "trigger:s a_stop:f a_target:f a_hold:i ladder:b cohort:i n:i mean:f",
    o.sql("cands bars", """select trigger, a_stop, a_target, a_hold, ladder, cohort, count(*) as n, avg(ret) as mean from (
      select *, false as ladder, flat_ret as ret from (select * exclude (ret) from gt) union all by name select *, true as ladder, ladder_ret as ret from (select * exclude (ret) from gt)) group by all""", *GRID),
)
def rule_grid(spark, sf):
    return grid_trades(spark, sf).groupBy("trigger", "a_stop", "a_target", "a_hold", "ladder", "cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"))


@query("net_trades", "F8", "symbol:s day:d qty:i imp:f cost_pct:f net:f net_ret:f", o.sql("trades", "select *, nqty as qty from trades"))
def net_trades(spark, sf):
    return trades(spark, sf)


@query(
    "yearly_tax", "F9", "fy:i net:f tax:f",
    o.sql("trades", """select fy, sum(net) as net, greatest(sum(net), 0e0) * 0.2e0 as tax from (select *, case when month(exit_day) > 3 then year(exit_day) else year(exit_day) - 1 end as fy from trades) group by fy"""),
)
def yearly_tax(spark, sf):
    return outcomes.yearly_tax(trades(spark, sf))


LEG_NET = f"""lgn as materialized (select l.*, b.entry_px * l.leg_qty as buy, l.leg_px * l.leg_qty as sell from lg l join bt b using (symbol, ix)),
lgc as materialized (select *, sell - buy - ({o.charge('buy', 'BUY')} + {o.charge('sell', 'SELL')}) as net from lgn)"""


@query(
    "merged_legs", "I23", "symbol:s ix:i ret:f why:s last_day:d legs:i",
    o.sql(
        "signals bars",
        """select symbol, ix, sum(net) / sum(buy) * 100 as ret, array_to_string(list_sort(list(distinct leg_why)), '+') as why, max(leg_day) as last_day, count(*) as legs from lgc group by 1, 2""",
        o.label_cte("bt", "signals", late=1, close_short=False), LADDER, LEG_NET,
    ),
)
def merged_legs(spark, sf):
    from ..operators import evidence

    buy, sell = F.col("entry_px") * F.col("leg_qty"), F.col("leg_px") * F.col("leg_qty")
    legs = _ladder(spark, sf).withColumn("buy", buy).withColumn("sell", sell)
    legs = legs.withColumn("net", F.col("sell") - F.col("buy") - costs.charge(F.col("buy"), "BUY") - costs.charge(F.col("sell"), "SELL"))
    legs = legs.select("symbol", "ix", "buy", "net", F.col("leg_why").alias("why"), "leg_day")
    return evidence.merge_legs(legs, ["symbol", "ix"]).withColumnRenamed("day", "last_day")
