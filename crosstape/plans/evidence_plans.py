"""Attribution, error bars, spreads, blocks and adoption tables over the trade ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import costs, stats
from ..functions.indicators import bar_return
from ..operators import evidence, outcomes, ranking, selection
from ..session import durable, shared_dir
from ..sources import ledger
from . import oracle as o
from .common import TRADE_COLUMNS, bands, by_day, candidates, corpus, features, pooled_candidates, sessions, signals, trades
from .outcome_plans import ARM_CTES, ARM_NAMES, arm_trades
from .selection_plans import announcement_points
from .spec import query

BARS_SQL = """count(ret) as n, avg(ret) as mean, case when count(ret) >= 2 then stddev_pop(ret) / sqrt(count(ret)) end as se"""


def population_sql(src: str, key: str) -> str:
    return f"""select {key}, n, mean, se, mean - 1.96e0 * se as lo, mean + 1.96e0 * se as hi, case when n >= 2 then case when se > 0 then mean / se else 0e0 end end as t,
      coalesce(abs(case when se > 0 then mean / se else 0e0 end) > 1.96e0 and n >= 2, false) as significant from (select {key}, {BARS_SQL} from {src} group by {key})"""


@query(
    "breakout_edge_by_band", "I2 I4 F8 G1 D3 E3", "band:s n:i mean:f se:f lo:f hi:f t:f significant:b",
    o.sql("trades", population_sql("(select band, net_ret as ret from trades)", "band")),
)
def breakout_edge_by_band(spark, sf):
    """The headline question, computed end to end without the stored ledger."""
    net = signals(spark, sf, label=lambda paths: outcomes.net_trade(outcomes.barrier(paths)))
    return net.groupBy("band").agg(*stats.population_bars("net_ret"))


def by_symbol(spark, sf):
    """Each symbol's trades, a day's at most one, added in the order of their days."""
    return evidence.attribution(trades(spark, sf), "symbol", order=("day",))


@query("per_symbol", "I1 K5", "symbol:s n:i total:f avg:f wins:i place:i",
       o.sql("trades", "select *, row_number() over (order by total desc, symbol) as place from (select symbol, count(ret) as n, sum(ret) as total, avg(ret) as avg, sum(cast(ret > 0 as int)) as wins from trades group by symbol)"))
def per_symbol(spark, sf):
    rows = by_symbol(spark, sf)
    return ranking.wide_ranked(rows, [], [F.col("total").desc(), F.col("symbol")], "place")


@query("top_and_bottom", "K5 K6", "side:s symbol:s total:f",
       o.sql("trades", """select 'top' as side, * from (select * from t order by total desc, symbol limit 5) union all select 'bottom', * from (select * from t order by total, symbol desc limit 5)""",
             "t as (select symbol, sum(ret) as total from trades group by symbol)"))
def top_and_bottom(spark, sf):
    t = by_symbol(spark, sf).select("symbol", "total")
    top = t.orderBy(F.col("total").desc(), "symbol").limit(5).withColumn("side", F.lit("top"))
    return top.unionByName(t.orderBy("total", F.col("symbol").desc()).limit(5).withColumn("side", F.lit("bottom")))


@query("per_band", "I2", "band:s n:i total:f avg:f wins:i",
       o.sql("trades", "select band, count(ret) as n, sum(ret) as total, avg(ret) as avg, sum(cast(ret > 0 as int)) as wins from trades group by band"))
def per_band(spark, sf):
    return evidence.attribution(trades(spark, sf), "band")


@query(
    "gain_concentration", "I3", "n_symbols:i winners:i top1:f top3:f top10pct:f",
    o.sql("trades", """select count(*) as n_symbols, sum(cast(total > 0 as int)) as winners, sum(case when total > 0 and k <= 1 then total else 0e0 end) / sum(greatest(total, 0e0)) * 100 as top1,
      sum(case when total > 0 and k <= 3 then total else 0e0 end) / sum(greatest(total, 0e0)) * 100 as top3,
      sum(case when total > 0 and k <= greatest(1, n // 10) then total else 0e0 end) / sum(greatest(total, 0e0)) * 100 as top10pct
      from (select *, row_number() over (order by total desc, symbol) as k, count(*) over () as n from (select symbol, sum(ret) as total from trades group by symbol))"""),
)
def gain_concentration(spark, sf):
    return evidence.concentration(by_symbol(spark, sf))


@query("overall_error_bars", "I4 I5", "n:i mean:f se:f lo:f hi:f t:f significant:b needed:i",
       o.sql("trades", f"select *, case when mean <> 0 then floor(pow(1.96e0 * 16e0 / abs(mean), 2)) + 1 end as needed from ({population_sql('(select 1 as g, ret from trades)', 'g')})"))
def overall_error_bars(spark, sf):
    return trades(spark, sf).agg(*stats.population_bars()).withColumn("needed", stats.trades_needed(F.col("mean")))


LEDGER_SQL = """lng as materialized (select symbol, day, ret, f as feature, case f when 'rs' then ret63 when 'deliv' then deliv_mean when 'liq' then liq when 'off_high' then off_high else near_high end as x
  from trades, (values ('rs'), ('deliv'), ('liq'), ('off_high'), ('near_high')) v(f) where case f when 'rs' then ret63 when 'deliv' then deliv_mean when 'liq' then liq when 'off_high' then off_high else near_high end is not null)"""


def info_sql(src: str, keys: str) -> str:
    return f"""select {keys}, max(m) as n, case when max(x) > min(x) and bool_or(mid) then avg(ret) filter (where k <= m // 3) else 0e0 end as bottom_third,
      case when max(x) > min(x) and bool_or(mid) then avg(ret) filter (where k > m - m // 3) else 0e0 end as top_third,
      case when max(x) > min(x) and bool_or(mid) then avg(ret) filter (where k > m - m // 3) - avg(ret) filter (where k <= m // 3) else 0e0 end as spread,
      not bool_or(mid) as no_variance from (select *, x > min(x) over (partition by {keys}) and x < max(x) over (partition by {keys}) as mid,
        row_number() over (partition by {keys} order by x, day, symbol) as k, count(*) over (partition by {keys}) as m from {src}) where m >= 30 group by {keys}"""


def slabs(spark, sf) -> int:
    """Slabs of the ledger's ranks: they follow the input where the session's partitions do not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ledger.buckets(spark, sf))


def ledger_long(rows, ret: str = "ret"):
    wide = rows.select(
        "symbol", "day", F.col(ret).alias("ret"), F.col("ret63").alias("rs"), F.col("deliv_mean").alias("deliv"), "liq", "off_high", "near_high",
        F.lit(None).cast("double").alias("rsi"),
    )
    return evidence.unpivot_features(wide)


@query("feature_information", "I6", "feature:s n:i top_third:f bottom_third:f spread:f no_variance:b", o.sql("trades", info_sql("lng", "feature"), LEDGER_SQL))
def feature_information(spark, sf):
    return evidence.feature_information(ledger_long(trades(spark, sf)), slabs=slabs(spark, sf))


SPLIT_SQL = f"""hv as materialized (select *, case when o <= floor(al * 0.5e0) then 'early' else 'late' end as half from (
    select *, row_number() over (partition by feature order by day, symbol) as o, count(*) over (partition by feature) as al from lng)),
hi as materialized ({info_sql('hv', 'half, feature')}),
sc as materialized (select n.feature, n.n, h.early, h.late, case when n.n < 100 or early is null or late is null then 'thin' when early = 0 or late = 0 then 'none'
   when (early > 0) <> (late > 0) then 'flips' else 'consistent' end as verdict
  from (select feature, count(*) as n from lng group by 1) n left join (select feature, max(case when half = 'early' then spread end) as early, max(case when half = 'late' then spread end) as late
    from hi group by 1) h using (feature))"""


@query("split_half_check", "I7", "feature:s n:i early:f late:f verdict:s", o.sql("trades", "select * from sc", LEDGER_SQL, SPLIT_SQL))
def split_half_check(spark, sf):
    return evidence.split_check(ledger_long(trades(spark, sf)), slabs=slabs(spark, sf))


# --- unconditioned sample --------------------------------------------------

SAMPLE_SQL = """ss as materialized (select day from (select *, (select count(*) from sess) as nn from sess) where session_ix >= 300 and session_ix < nn - 11
   and (session_ix - 300) % greatest(1, floor((nn - 320) / 90)) = 0),
smp as materialized (select * exclude (h, k) from (select *, row_number() over (partition by day order by h, symbol) as k from (
   select b.*, md5(concat_ws('|', symbol, cast(day as varchar), '11')) as h from {src} b where day in (select day from ss))) where k <= 45)"""


def random_trades(spark, sf, banded: bool = True):
    """Labelled trades on a hash-ordered draw of symbols per sampled session, whatever their rank."""
    rows = corpus(spark, sf)
    days = evidence.sample_sessions(sessions(spark, sf), 300, 10, 90).select("day")
    # A day's bands read that day alone, so only the sampled days are ranked, with what the rank reads.
    # At most a hundred sampled dates, whatever the data: safe to broadcast.
    names = rows.select("symbol", "day", *(("ix", "size_med", "size_n") if banded else ())).join(F.broadcast(days), "day", "left_semi")
    names = by_day(spark, sf, names)
    if banded:
        names = ranking.size_bands(names).select("symbol", "day", "band_ix", "band", "size_rank")
    # At most 45 rows on each of these dates: read twice, and safe to broadcast too.
    drawn = durable(evidence.random_sample(names, 45))
    paths = outcomes.with_path(rows.join(F.broadcast(drawn.select("symbol").distinct()), "symbol", "left_semi"), 10)
    return outcomes.barrier(paths.join(F.broadcast(drawn), ["symbol", "day"]))


SAMPLED = (SAMPLE_SQL.format(src="bands"), o.label_cte("rt", "smp"))


@query("random_sample_trades", "I8", "symbol:s day:d band:s why:s ret:f", o.sql("bands sess", "select * from rt", *SAMPLED))
def random_sample_trades(spark, sf):
    return random_trades(spark, sf)


UNCOND = (SAMPLE_SQL.format(src="corpus"), o.label_cte("rt", "usmp"), LEDGER_SQL.replace("lng as", "ulng as").replace("from trades,", "from (select * replace (ret - 0.4e0 as ret) from rt),"))
UNCOND = (UNCOND[0] + ", usmp as materialized (select * from smp where ix >= 200)", UNCOND[1], UNCOND[2])


@query("unconditioned_information", "I8 I6", "feature:s n:i top_third:f bottom_third:f spread:f no_variance:b", o.sql("corpus sess", info_sql("ulng", "feature"), *UNCOND))
def unconditioned_information(spark, sf):
    t = random_trades(spark, sf, banded=False).filter(F.col("ix") >= 200).withColumn("ret", F.col("ret") - 0.4)
    return evidence.feature_information(ledger_long(t))


@query(
    "weight_proposal", "I9 B5", "feature:s weight:f spread:f verdict:s used:f inverted:b new_weight:f no_op:b",
    o.sql(
        "trades sess",
        """select feature, weight, spread, verdict, used, inverted, nw as new_weight, max(nw / weight) over () - min(nw / weight) over () < 1e-6 as no_op from (
           select *, case when nt >= 200 and max(abs(coalesce(spread, 0))) over () >= 1e-9 then
              floor((weight + (count(spread) over () * pos / case when sum(pos) over () > 0 then sum(pos) over () else 1e0 end - weight) * 0.15e0) * 10000 + 0.5e0) / 10000 else weight end as nw from (
             select *, case when inverted then -used else greatest(used, 0e0) end as pos from (
               select w.feature, w.weight, i.spread, s.verdict, (select count(*) from trades) as nt, case when i.spread is not null then coalesce(u.spread, 0e0) else 0e0 end as used,
                 coalesce(u.spread < -0.5e0 and i.spread is not null, false) as inverted
               from (values ('rs', 1e0), ('deliv', 1.5e0), ('liq', 1e0), ('near_high', 1e0)) w(feature, weight)
               left join inf i using (feature) left join sc s using (feature) left join ui u using (feature))))""",
        LEDGER_SQL, SPLIT_SQL, f"inf as materialized ({info_sql('lng', 'feature')})",
        UNCOND[0].replace("select b.*", "select b.*"), UNCOND[1], UNCOND[2], f"ui as materialized ({info_sql('ulng', 'feature')})",
    ),
)
def weight_proposal(spark, sf):
    book = ledger.weight_rows(trades(spark, sf).withColumn("portfolio", F.lit("main")))
    long, n = ledger_long(book), trades(spark, sf).agg(F.count(F.lit(1))).scalar()
    return evidence.weight_proposal(
        evidence.feature_information(long, slabs=slabs(spark, sf)), evidence.split_check(long, slabs=slabs(spark, sf)), unconditioned_information(spark, sf), selection.DEFAULT_WEIGHTS, n
    )


# --- arms against a control --------------------------------------------------

EDGE_SQL = "select arm, count(ret) as n, avg(ret) as mean, stddev_samp(ret) as sd, stddev_samp(ret) / sqrt(count(ret)) as se from al group by arm"


@query(
    "arm_edges", "I10 K1", "arm:s n:i mean:f sd:f se:f gap:f gap_se:f gap_t:f",
    o.sql("signals bars", f"""select e.*, e.mean - c.mean as gap, sqrt(e.sd * e.sd / e.n + c.sd * c.sd / c.n) as gap_se, (e.mean - c.mean) / nullif(sqrt(e.sd * e.sd / e.n + c.sd * c.sd / c.n), 0) as gap_t
      from ({EDGE_SQL}) e, ({EDGE_SQL}) c where c.arm = 's10_t20_h10'""", *ARM_CTES),
)
def arm_edges(spark, sf):
    per_arm = arm_trades(spark, sf).groupBy("arm").agg(*stats.sample_bars())
    return evidence.welch_vs_control(per_arm, "s10_t20_h10")


def cohort_trades(spark, sf):
    """Labelled candidates of each depth cohort that had triggered."""
    rows = selection.cohorts(candidates(spark, sf)).filter("triggered")
    return _label_picks(spark, sf, rows.select("symbol", "day", "cohort"), "cohort")


COHORT = (
    """cs as materialized (select * from (select *, floor((band_rank - 1) / case band when 'micro' then 3 else 2 end) as cohort from cands) where cohort < 6 and triggered)""",
    o.label_cte("ct", "cs"),
)
SLOPE_SQL = """select n, b as slope, se, b / nullif(se, 0) as t from (select *, case when b is not null and n > 2 then sqrt(greatest(syy - b * sxy, 0e0) / (n - 2) / sxx) end as se from (
  select regr_count(ret, {x}) as n, case when regr_sxx(ret, {x}) > 0 then regr_slope(ret, {x}) end as b, regr_syy(ret, {x}) as syy, regr_sxy(ret, {x}) as sxy, regr_sxx(ret, {x}) as sxx from {src}))"""


@query("depth_slope", "I11", "n:i slope:f se:f t:f", o.sql("cands bars", SLOPE_SQL.format(x="cohort", src="ct"), *COHORT))
def depth_slope(spark, sf):
    return cohort_trades(spark, sf).agg(*stats.slope_columns("cohort", "ret"))


@query(
    "cohort_report", "I35 D13", "cohort:i n:i mean:f se:f vs_deepest:f vs_deepest_t:f",
    o.sql(
        "cands bars",
        """select c.cohort, c.n, c.mean, c.se, case when c.n >= 2 and d.n >= 2 then c.mean - d.mean end as vs_deepest,
           case when c.n >= 2 and d.n >= 2 then (c.mean - d.mean) / nullif(sqrt(c.sd * c.sd / c.n + d.sd * d.sd / d.n), 0) end as vs_deepest_t
           from ca c, (select * from ca order by cohort desc limit 1) d""",
        *COHORT, "ca as materialized (select cohort, count(ret) as n, avg(ret) as mean, stddev_samp(ret) as sd, stddev_samp(ret) / sqrt(count(ret)) as se from ct group by 1)",
    ),
)
def cohort_report(spark, sf):
    rows = cohort_trades(spark, sf).groupBy("cohort").agg(*stats.sample_bars())
    # Six rows at most: one per cohort.
    last = Window.partitionBy(F.lit(0)).orderBy("cohort").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda c: F.last(c).over(last)
    rows = rows.withColumn("_m", of("mean")).withColumn("_s", of("sd")).withColumn("_n", of("n"))
    ok = (F.col("n") >= 2) & (F.col("_n") >= 2)
    se = F.sqrt(F.col("sd") * F.col("sd") / F.col("n") + F.col("_s") * F.col("_s") / F.col("_n"))
    gap = F.col("mean") - F.col("_m")
    return rows.withColumn("vs_deepest", F.when(ok, gap)).withColumn("vs_deepest_t", F.when(ok & (se > 0), F.try_divide(gap, se)))


TERCILE = lambda src, key, by="": f"""select {by + ', ' if by else ''}max(m) as n, count(ret) filter (where {key} > hi and m >= 30) as n_hi, count(ret) filter (where {key} < lo and m >= 30) as n_lo,
  case when max(m) >= 30 and count(ret) filter (where {key} > hi) >= 2 and count(ret) filter (where {key} < lo) >= 2 then avg(ret) filter (where {key} > hi) - avg(ret) filter (where {key} < lo) end as spread,
  case when max(m) >= 30 and count(ret) filter (where {key} > hi) >= 2 and count(ret) filter (where {key} < lo) >= 2 then
    sqrt(var_samp(ret) filter (where {key} > hi) / count(ret) filter (where {key} > hi) + var_samp(ret) filter (where {key} < lo) / count(ret) filter (where {key} < lo)) end as se
  from (select *, max(case when k - 1 = m // 3 then {key} end) over ({'partition by ' + by if by else ''}) as lo, max(case when k - 1 = (2 * m) // 3 then {key} end) over ({'partition by ' + by if by else ''}) as hi from (
    select *, row_number() over ({'partition by ' + by if by else ''} order by {key}, day, symbol) as k, count(*) over ({'partition by ' + by if by else ''}) as m from {src} where {key} is not null)) {'group by ' + by if by else ''}"""  # noqa: E731


@query("tercile_spread", "I12", "band:s n:i n_hi:i n_lo:i spread:f se:f t:f",
       o.sql("trades", f"select *, spread / nullif(se, 0) as t from ({TERCILE('trades', 'rs_raw', 'band')})"))
def tercile_spread(spark, sf):
    return evidence.tercile_spread(trades(spark, sf), "rs_raw", ("band",))


@query(
    "median_split", "I13", "feature:s n:i med:f n_hi:i n_lo:i spread:f",
    o.sql("trades", """select feature, med, n, n_hi, n_lo, case when n >= 100 and n_hi >= 50 and n_lo >= 50 then h - l end as spread from (
      select feature, med, count(*) as n, count(ret) filter (where x > med) as n_hi, count(ret) filter (where x <= med) as n_lo, avg(ret) filter (where x > med) as h, avg(ret) filter (where x <= med) as l
      from (select *, median(x) over (partition by feature) as med from lng) group by 1, 2)""", LEDGER_SQL),
)
def median_split(spark, sf):
    return evidence.median_spread(ledger_long(trades(spark, sf)))


def announced_trades(spark, sf):
    """Random trades with the announcement features visible on the signal day."""
    # A few thousand rows, kept so that what reads them several times does not draw them again.
    t = durable(random_trades(spark, sf).drop("n"))
    return durable(announcement_points(spark, sf, t, t.select("symbol").distinct()).filter(F.col("ann_burst").isNotNull()))


from .selection_plans import ANN_FEATURES_CTE  # noqa: E402

ANN_TRADES = (*SAMPLED, ANN_FEATURES_CTE, "annt as materialized (select r.*, a.ann_burst, a.ann_tone, a.ann_flag from rt r join annx a using (symbol, day) where a.ann_burst is not null)")


@query(
    "signed_split", "I14", "feature:s n_hi:i n_lo:i spread:f se:f t:f",
    o.sql(
        "bands sess annv",
        """select *, spread / nullif(se, 0) as t from (select feature, count(ret) filter (where hi) as n_hi, count(ret) filter (where lo) as n_lo,
           case when count(ret) filter (where hi) >= 2 and count(ret) filter (where lo) >= 2 then avg(ret) filter (where hi) - avg(ret) filter (where lo) end as spread,
           case when count(ret) filter (where hi) >= 2 and count(ret) filter (where lo) >= 2 then sqrt(var_samp(ret) filter (where hi) / count(ret) filter (where hi)
             + var_samp(ret) filter (where lo) / count(ret) filter (where lo)) end as se from (
             select feature, ret, case when feature in ('ann_tone', 'ann_flag') then x > 0 else x > med end as hi, case feature when 'ann_tone' then x < 0 when 'ann_flag' then x = 0 else x <= med end as lo from (
               select *, median(x) over (partition by feature) as med from (
                 select ret, 'ann_burst' as feature, ann_burst as x from annt union all select ret, 'ann_tone', ann_tone from annt union all select ret, 'ann_flag', ann_flag from annt))) group by feature)""",
        *ANN_TRADES,
    ),
)
def signed_split(spark, sf):
    t = announced_trades(spark, sf).select("symbol", "day", "ret", "ann_burst", "ann_tone", "ann_flag")
    return evidence.signed_split(evidence.unpivot_features(t, ("ann_burst", "ann_tone", "ann_flag")))


@query(
    "risk_by_tone", "I15 G2", "n_hi:i n_lo:i spread:f se:f t:f n_a:i n_b:i diff_pp:f se_pp:f t_stop:f",
    o.sql(
        "bands sess annv",
        """select n_hi, n_lo, n_a, n_b, case when least(n_hi, n_lo) >= 2 then spread end as spread, case when least(n_hi, n_lo) >= 2 then se end as se,
           case when least(n_hi, n_lo) >= 2 then spread / nullif(se, 0) end as t, case when least(n_a, n_b) >= 5 then diff_pp end as diff_pp, case when least(n_a, n_b) >= 5 then se_pp end as se_pp,
           case when least(n_a, n_b) >= 5 then diff_pp / nullif(se_pp, 0) end as t_stop from (select count(v) filter (where g) as n_hi, count(v) filter (where not g) as n_lo,
           avg(v) filter (where g) - avg(v) filter (where not g) as spread, sqrt(var_samp(v) filter (where g) / count(v) filter (where g) + var_samp(v) filter (where not g) / count(v) filter (where not g)) as se,
           count(*) filter (where g) as n_a, count(*) filter (where not g) as n_b, (avg(s) filter (where g) - avg(s) filter (where not g)) * 100 as diff_pp,
           sqrt((avg(s) filter (where g)) * (1 - avg(s) filter (where g)) / count(*) filter (where g) + (avg(s) filter (where not g)) * (1 - avg(s) filter (where not g)) / count(*) filter (where not g)) * 100 as se_pp
           from (select a.ann_burst > 0 as g, cast(a.why = 'stop' as int) as s, h.v from annt a left join (
             select a2.symbol, a2.ix, case when count(*) >= 3 then stddev_pop(b.close / p.close - 1e0) * 100 end as v from annt a2 join bars b on b.symbol = a2.symbol and b.ix between a2.ix + 2 and a2.exit_ix
               join bars p on p.symbol = b.symbol and p.ix = b.ix - 1 group by 1, 2) h using (symbol, ix)))""",
        *ANN_TRADES,
    ),
)
def risk_by_tone(spark, sf):
    t = outcomes.held_volatility(announced_trades(spark, sf))
    g = F.col("ann_burst") > 0
    prop = stats.proportion_columns(F.col("stopped"), g, ~g)
    return t.agg(*stats.spread_columns(F.col("held_vol"), g, ~g), *prop[:4], prop[4].alias("t_stop"))


SPREAD_SQL = lambda b="true": f"case when count(ret) filter (where hi and {b}) >= 2 and count(ret) filter (where lo and {b}) >= 2 then avg(ret) filter (where hi and {b}) - avg(ret) filter (where lo and {b}) end"

TONE_FACTS = f"""tnl as materialized (select *, case when feature = 'ann_tone' then x > 0 else x > med end as hi, case when feature = 'ann_tone' then x < 0 else x <= med end as lo from (
  select *, median(x) over (partition by feature) as med from (select ret, band, rs_raw, 'ann_burst' as feature, ann_burst as x from annt union all select ret, band, rs_raw, 'ann_tone', ann_tone from annt))),
tnf as materialized (select feature, {SPREAD_SQL()} as spread, sqrt(var_samp(ret) filter (where hi) / nullif(count(ret) filter (where hi), 0) + var_samp(ret) filter (where lo) / nullif(count(ret) filter (where lo), 0)) as se,
  corr(x, rs_raw) as echo, {SPREAD_SQL("band = 'micro'")} as micro, {SPREAD_SQL("band = 'small'")} as small, (select {SPREAD_SQL()} from (select ret, ann_flag > 0 as hi, ann_flag = 0 as lo from annt)) as category_spread from tnl group by feature),
tnr as materialized (select *, spread / nullif(se, 0) as t, [('resolved', abs(spread / nullif(se, 0)) >= 2.64e0), ('beats_category', spread > category_spread), ('not_momentum', abs(echo) < 0.3e0), ('one_sign', (micro > 0) = (small > 0))] as c from tnf)"""


@query(
    "tone_adoption", "I26", "feature:s spread:f t:f category_spread:f echo:f micro:f small:f failed:s adopt:b",
    o.sql("bands sess annv", """select feature, spread, t, category_spread, echo, micro, small, array_to_string(list_transform(list_filter(c, lambda x: not coalesce(x[2], false)), lambda x: x[1]), ',') as failed,
       len(list_filter(c, lambda x: not coalesce(x[2], false))) = 0 as adopt from tnr""", *ANN_TRADES, TONE_FACTS),
)
def tone_adoption(spark, sf):
    """The pre-set bar of a text score over random trades: burst and tone of announcements against the error category alone."""
    t = announced_trades(spark, sf).select("symbol", "day", "band", "ret", "rs_raw", "ann_burst", "ann_tone", "ann_flag")
    facts = evidence.tone_facts(evidence.unpivot_features(t, ("ann_burst", "ann_tone", "ann_flag")), "ann_flag", "rs_raw")
    return evidence.adoption(facts, evidence.tone_rule()).drop("n_hi", "n_lo", "se")


@query("echo_correlation", "I16", "r:f", o.sql("trades", "select corr(rs_raw, near_high) as r from trades"))
def echo_correlation(spark, sf):
    return trades(spark, sf).agg(stats.correlation("rs_raw", "near_high").alias("r"))


HALF = "concat(year({d}), case when month({d}) <= 6 then 'H1' else 'H2' end)"


@query("half_year_sums", "I17", "block:s n:i total:f worst:b",
       o.sql("trades", f"select block, n, total, total = min(total) over () as worst from (select {HALF.format(d='exit_day')} as block, count(*) as n, sum(ret) as total from trades group by 1)"))
def half_year_sums(spark, sf):
    rows = trades(spark, sf).groupBy(stats.half_year(F.col("exit_day")).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))
    return rows.withColumn("worst", F.col("total") == F.min("total").over(Window.partitionBy(F.lit(0))))


@query("regime_means", "I18", "regime:s n:i mean:f",
       o.sql("trades", "select case when year(exit_day) + 21 <= 2021 then '2019-21' when year(exit_day) + 21 <= 2023 then '2022-23' else '2024-26' end as regime, count(*) as n, avg(ret) as mean from trades group by 1"))
def regime_means(spark, sf):
    # The made-up calendar ends in 2001; shifted by 21 years it spans the fixed regimes.
    return trades(spark, sf).groupBy(stats.regime(F.add_months("exit_day", 252)).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"))


CURVE = """crv as materialized (select a.arm, s.day, 300000e0 + sum(coalesce(p.p, 0e0)) over (partition by a.arm order by s.day) as equity
  from (select distinct arm from al) a, sess s left join (select arm, exit_day, sum(ret * 450e0 / 100) as p from al group by 1, 2) p on p.arm = a.arm and p.exit_day = s.day)"""
BLOCKS = f"""blk as materialized (select arm, block, count(*) as points, max((peak - equity) / peak) * 100 as dd, (arg_max(equity, day) / arg_min(equity, day) - 1) * 100 as ret_pct from (
  select *, max(equity) over (partition by arm, block order by day) as peak from (select *, {HALF.format(d='day')} as block from crv)) group by 1, 2 having count(*) >= 20)"""


def curves(spark, sf):
    return evidence.daily_curve(arm_trades(spark, sf), sessions(spark, sf), ARM_NAMES, 300_000.0, 450.0)


@query("block_drawdowns", "I19", "arm:s block:s points:i dd:f ret_pct:f", o.sql("signals bars sess", "select * from blk", *ARM_CTES, CURVE, BLOCKS))
def block_drawdowns(spark, sf):
    return evidence.block_drawdowns(curves(spark, sf))


PAIRED = """pdf as materialized (select b.arm, b.block, b.dd - c.dd as d from blk b join blk c on c.block = b.block and c.arm = 's10_t20_h10' where b.arm <> 's10_t20_h10'),
pdw as materialized (select *, row_number() over (partition by arm order by abs(d) desc, block) as w from pdf),
pdr as materialized (select arm, count(*) as n, avg(d) as mean_diff, stddev_samp(d) / sqrt(count(*)) as se, median(d) as median_diff, 100e0 * sum(cast(d < 0 as int)) / count(*) as win_pct,
  case when stddev_samp(d) filter (where w > 1) > 0 then avg(d) filter (where w > 1) / (stddev_samp(d) filter (where w > 1) / sqrt(count(*) - 1)) else 0e0 end as loo_t from pdw group by arm)"""


@query("paired_blocks", "I20 K3", "arm:s n:i mean_diff:f se:f t:f median_diff:f win_pct:f loo_t:f",
       o.sql("signals bars sess", "select *, case when se > 0 then mean_diff / se else 0e0 end as t from pdr", *ARM_CTES, CURVE, BLOCKS, PAIRED))
def paired_blocks(spark, sf):
    return evidence.paired_blocks(evidence.block_drawdowns(curves(spark, sf)), "s10_t20_h10")


PATH = """pth as materialized (select arm, arg_max(equity, day) as equity, max((peak - equity) / peak) * 100 as maxdd, date_diff('day', min(day), max(day)) / 365.25e0 as years from (
  select *, greatest(max(equity) over (partition by arm order by day), 300000e0) as peak from crv) group by arm),
pths as materialized (select *, (equity / 300000e0 - 1) * 100 as total_pct, case when years > 0.5 and equity > 0 then (pow(equity / 300000e0, 1 / years) - 1) * 100 end as cagr from pth)"""


@query("path_summary", "I21", "arm:s equity:f total_pct:f cagr:f maxdd:f", o.sql("signals bars sess", "select * from pths", *ARM_CTES, CURVE, PATH))
def path_summary(spark, sf):
    return evidence.path_summary(curves(spark, sf), 300_000.0)


OCC = """occ as materialized (select a.arm, s.day, (select count(*) from al t where t.arm = a.arm and t.entry_day <= s.day and t.exit_day > s.day) as held from (select distinct arm from al) a, sess s),
occr as materialized (select arm, avg(held) as mean_held, sum(cast(held >= 5 as int)) / count(*) * 100 as full_pct, sum(cast(held = 0 as int)) / count(*) * 100 as empty_pct, max(held) as most from occ group by arm)"""


@query("occupancy_report", "I22", "arm:s mean_held:f full_pct:f empty_pct:f most:i", o.sql("signals bars sess", "select * from occr", *ARM_CTES, OCC))
def occupancy_report(spark, sf):
    return evidence.occupancy_report(evidence.occupancy(arm_trades(spark, sf), sessions(spark, sf), ARM_NAMES), 5)


@query("occupancy_histogram", "I22", "arm:s held:i sessions:i pct:f",
       o.sql("signals bars sess", "select arm, held, count(*) as sessions, count(*) * 100e0 / sum(count(*)) over (partition by arm) as pct from occ group by 1, 2", *ARM_CTES, OCC))
def occupancy_histogram(spark, sf):
    h = evidence.occupancy(arm_trades(spark, sf), sessions(spark, sf), ARM_NAMES).groupBy("arm", "held").agg(F.count(F.lit(1)).alias("sessions"))
    return h.withColumn("pct", F.col("sessions") * 100.0 / F.sum("sessions").over(Window.partitionBy("arm")))


@query("exit_mix", "I24", "band:s stop:i target:i time:i win_pct:f avg_stop:f",
       o.sql("trades", "select band, count(*) filter (where why = 'stop') as stop, count(*) filter (where why = 'target') as target, count(*) filter (where why = 'time') as time, avg(cast(ret > 0 as int)) * 100 as win_pct, avg(ret) filter (where why = 'stop') as avg_stop from trades group by band"))
def exit_mix(spark, sf):
    of = lambda w: F.count(F.when(F.col("why") == w, 1)).alias(w)
    return trades(spark, sf).groupBy("band").agg(
        of("stop"), of("target"), of("time"), (F.avg((F.col("ret") > 0).cast("int")) * 100).alias("win_pct"), F.avg(F.when(F.col("why") == "stop", F.col("ret"))).alias("avg_stop")
    )


@query("target_timing", "I25", "n:i by3:f by5:f p10:f p50:f p90:f",
       o.sql("trades", """select count(*) as n, avg(cast(held <= 3 as int)) * 100 as by3, avg(cast(held <= 5 as int)) * 100 as by5, max(case when k = n // 10 then dist end) as p10,
          max(case when k = n // 2 then dist end) as p50, max(case when k = n * 9 // 10 then dist end) as p90 from (
          select *, row_number() over (order by dist, symbol, day) - 1 as k, count(*) over () as n from (select *, exit_ix - ix - 1 as held, floor(abs(ret) * 1000000 + 0.5e0) / 1000000 as dist from trades where why = 'target'))"""))
def target_timing(spark, sf):
    hit = trades(spark, sf).filter("why = 'target'").withColumn("held", F.col("exit_ix") - F.col("ix") - 1)
    hit = hit.withColumn("dist", F.floor(F.abs("ret") * 1_000_000 + 0.5) / 1_000_000)
    r = ranking.wide_ranked(hit, [], [F.col("dist"), F.col("symbol"), F.col("day")], "_k", "_m")
    at = lambda num, den: F.max(F.when(F.col("_k") - 1 == F.floor(F.col("_m") * num / den), F.col("dist")))
    return r.agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("held") <= 3).cast("int")) * 100).alias("by3"), (F.avg((F.col("held") <= 5).cast("int")) * 100).alias("by5"),
        at(1, 10).alias("p10"), at(1, 2).alias("p50"), at(9, 10).alias("p90"),
    )


DECIDE = f"""dec as materialized (select p.arm, p.mean_diff, p.se, case when p.se > 0 then p.mean_diff / p.se else 0e0 end as t, p.median_diff, p.loo_t, g.gap, g.gap_t
   from pdr p join (select e.arm, e.mean - c.mean as gap, (e.mean - c.mean) / nullif(sqrt(e.sd * e.sd / e.n + c.sd * c.sd / c.n), 0) as gap_t from ({EDGE_SQL}) e, ({EDGE_SQL}) c where c.arm = 's10_t20_h10') g using (arm))"""


@query(
    "adoption_table", "I26", "arm:s resolved:b one_way:b not_one_episode:b no_return_cost:b failed:s adopt:b",
    o.sql(
        "signals bars sess",
        """select *, array_to_string(list_filter([case when not resolved then 'resolved' end, case when not one_way then 'one_way' end, case when not not_one_episode then 'not_one_episode' end,
             case when not no_return_cost then 'no_return_cost' end], lambda x: x is not null), ',') as failed, resolved and one_way and not_one_episode and no_return_cost as adopt from (
           select arm, coalesce(abs(t) > 2 and mean_diff < 0, false) as resolved, coalesce((median_diff < 0) = (mean_diff < 0), false) as one_way, coalesce(abs(loo_t) > 1.5, false) as not_one_episode,
             coalesce(not (gap_t < -2), false) as no_return_cost from dec)""",
        *ARM_CTES, CURVE, BLOCKS, PAIRED, DECIDE,
    ),
)
def adoption_table(spark, sf):
    t = arm_trades(spark, sf)
    pairs = evidence.paired_blocks(evidence.block_drawdowns(evidence.daily_curve(t, sessions(spark, sf), ARM_NAMES, 300_000.0, 450.0)), "s10_t20_h10")
    gaps = evidence.welch_vs_control(t.groupBy("arm").agg(*stats.sample_bars()), "s10_t20_h10").select("arm", "gap", "gap_t")
    return evidence.adoption(pairs.join(gaps, "arm"), [
        ("resolved", (F.abs("t") > 2) & (F.col("mean_diff") < 0)),
        ("one_way", (F.col("median_diff") < 0) == (F.col("mean_diff") < 0)),
        ("not_one_episode", F.abs("loo_t") > 1.5),
        ("no_return_cost", ~(F.col("gap_t") < -2)),
    ])


FACTS = f"""fct0 as materialized (select arm, avg(ret) filter (where band = 'micro') as micro, avg(ret) filter (where band = 'small') as small from al group by arm),
fct1 as materialized (select arm, min(t) as worst from (select arm, {HALF.format(d='exit_day')} as b, sum(ret) as t from al group by all) group by arm),
fct2 as materialized (select arm, count(*) as names, greatest(max(t), 0e0) / nullif(sum(greatest(t, 0e0)), 0) * 100 as top1 from (select arm, symbol, sum(ret) as t from al group by all) group by arm),
fct3 as materialized (select e.arm, e.mean - c.mean as gap, (e.mean - c.mean) / nullif(sqrt(e.sd * e.sd / e.n + c.sd * c.sd / c.n), 0) as gap_t from ({EDGE_SQL}) e, ({EDGE_SQL}) c where c.arm = 's10_t20_h10'),
fct4 as materialized (select *, list_position({ARM_NAMES!r}, arm) as place from fct0 join fct1 using (arm) join fct2 using (arm) join fct3 using (arm) join (select arm, maxdd from pths) using (arm)),
fct as materialized (select f.*, c.micro as c_micro, c.small as c_small, c.worst as c_worst, c.names as c_names, c.top1 as c_top1, c.maxdd as c_maxdd, p.t, p.mean_diff, p.median_diff, p.loo_t,
  (select bool_and(u) or bool_and(d) from (select coalesce(gap >= lag(gap) over (order by place), true) as u, coalesce(gap <= lag(gap) over (order by place), true) as d from fct4)) as one_way,
  (select gap from fct4 where arm = 's10_t20_h20') as long_gap, (select corr(o.mean_held, b.dd) from occr o join (select arm, avg(dd) as dd from blk group by arm) b using (arm)) as expo
  from fct4 f join fct4 c on c.arm = 's10_t20_h10' join (select *, case when se > 0 then mean_diff / se else 0e0 end as t from pdr) p on p.arm = f.arm),
rls as materialized (
  select 'seats' as rule, arm, [('resolved', abs(gap_t) > 2), ('one_way', one_way), ('both_bands', micro > c_micro and small > c_small), ('no_deeper_fall', maxdd <= c_maxdd + 3)] as c from fct
  union all select 'pooled', arm, [('better', gap_t > 2), ('worst_block', worst >= c_worst), ('concentration', top1 <= c_top1), ('breadth', names >= c_names), ('block_falls', not (coalesce(t, 0) > 2))] from fct
  union all select 'pattern', arm, [('resolved', abs(gap_t) >= 2.6e0), ('both_bands', micro > 0 and small > 0), ('worst_block', worst >= c_worst), ('not_looser', not coalesce(long_gap >= gap, false))] from fct
  union all select 'falls', arm, [('resolved', abs(t) >= 2.81e0 and mean_diff < 0), ('not_one_episode', (median_diff < 0) = (mean_diff < 0) and abs(loo_t) > 1.5e0), ('not_exposure', abs(expo) < 0.7e0), ('no_return_cost', not coalesce(gap_t <= -2, false))] from fct
  union all select 'exit', arm, [('resolved', abs(gap_t) >= 2.6e0), ('both_bands', micro > 0 and small > 0), ('worst_block', worst >= c_worst), ('not_longer', not coalesce(gap > 0 and long_gap >= 0.5e0 * gap, false))] from fct)"""


@query(
    "adoption_rules", "I26", "rule:s arm:s failed:s adopt:b",
    o.sql("signals bars sess", "select rule, arm, array_to_string(list_transform(list_filter(c, lambda x: not coalesce(x[2], false)), lambda x: x[1]), ',') as failed, len(list_filter(c, lambda x: not coalesce(x[2], false))) = 0 as adopt from rls",
          *ARM_CTES, CURVE, BLOCKS, PAIRED, PATH, OCC, FACTS),
)
def adoption_rules(spark, sf):
    """Five pre-set bars over the arms of the sweep; the longest hold stands for the looser and the longer arm."""
    control, longest = "s10_t20_h10", "s10_t20_h20"
    t, s = arm_trades(spark, sf), sessions(spark, sf)
    every = Window.partitionBy(F.lit(0))
    curve = evidence.daily_curve(t, s, ARM_NAMES, 300_000.0, 450.0)
    falls = evidence.path_summary(curve, 300_000.0).select("arm", "maxdd")
    blocks = evidence.block_drawdowns(curve)
    held = evidence.occupancy_report(evidence.occupancy(t, s, ARM_NAMES), 5)
    expo = held.join(blocks.groupBy("arm").agg(F.avg("dd").alias("dd")), "arm").agg(stats.correlation("mean_held", "dd")).scalar()
    facts = evidence.arm_facts(t, control, ARM_NAMES).join(falls, "arm")
    facts = facts.withColumn("c_maxdd", F.max(F.when(F.col("arm") == control, F.col("maxdd"))).over(every)).withColumn("long_gap", F.max(F.when(F.col("arm") == longest, F.col("gap"))).over(every))
    facts = facts.withColumn("expo", expo).join(evidence.paired_blocks(blocks, control).select("arm", "t", "mean_diff", "median_diff", "loo_t"), "arm")
    rules = {
        "seats": evidence.seats_rule(), "pooled": evidence.pooled_rule(), "pattern": evidence.pattern_rule(F.col("long_gap")), "falls": evidence.falls_rule(F.col("expo")), "exit": evidence.exit_rule(F.col("long_gap")),
    }
    out = [evidence.adoption(facts, conditions).select(F.lit(r).alias("rule"), "arm", "failed", "adopt") for r, conditions in rules.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "keep_bar", "I27", "arm:s cagr:f maxdd:f n:i win:f ok_cagr:b ok_dd:b ok_n:b ok_win:b failed:s adopt:b",
    o.sql(
        "signals bars sess",
        """select *, array_to_string(list_filter([case when not ok_cagr then 'ok_cagr' end, case when not ok_dd then 'ok_dd' end, case when not ok_n then 'ok_n' end, case when not ok_win then 'ok_win' end],
             lambda x: x is not null), ',') as failed, ok_cagr and ok_dd and ok_n and ok_win as adopt from (
           select arm, cagr, maxdd, n, win, coalesce(cagr > 5, false) as ok_cagr, maxdd < 55 as ok_dd, n >= 150 as ok_n, win >= 30 as ok_win
           from pths join (select arm, count(*) as n, avg(cast(ret > 0 as int)) * 100 as win from al group by arm) using (arm))""",
        *ARM_CTES, CURVE, PATH,
    ),
)
def keep_bar(spark, sf):
    t = arm_trades(spark, sf)
    path = evidence.path_summary(evidence.daily_curve(t, sessions(spark, sf), ARM_NAMES, 300_000.0, 450.0), 300_000.0)
    wins = t.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("ret") > 0).cast("int")) * 100).alias("win"))
    return evidence.keep_bar(path.join(wins, "arm"))


@query(
    "walk_forward", "I28", "param:s chosen:s early:f late:f oos_rank:i oos_of:i oos_best:s verdict:s",
    o.sql(
        "signals bars sess",
        """select param, arm as chosen, early, late, oos_rank, oos_of, oos_best, case when oos_rank >= oos_of and oos_of > 1 then 'anti' when oos_rank > 1 then 'weak' else 'ok' end as verdict from (
           select *, row_number() over (partition by param order by late desc nulls last, arm) as oos_rank, count(*) over (partition by param) as oos_of,
             first_value(arm) over (partition by param order by late desc nulls last, arm) as oos_best, row_number() over (partition by param order by early desc nulls last, arm) as f from (
             select 'exit rule' as param, arm, avg(ret) filter (where session_ix < (select floor(count(*) * 0.5e0) from sess)) as early, avg(ret) filter (where session_ix >= (select floor(count(*) * 0.5e0) from sess)) as late
             from al join sess using (day) group by arm)) where f = 1""",
        *ARM_CTES,
    ),
)
def walk_forward(spark, sf):
    s = sessions(spark, sf)
    cut = s.agg(F.floor(F.count(F.lit(1)) * 0.5)).scalar()
    t = arm_trades(spark, sf).join(s, "day").withColumn("half", F.when(F.col("session_ix") < cut, "early").otherwise("late"))
    halves = t.groupBy("arm", "half").agg(F.avg("ret").alias("mean")).withColumn("param", F.lit("exit rule"))
    return evidence.walk_forward(halves)


def result_ledger(spark, sf):
    """A stand-in result ledger: one row per (band, half-year block) run, with several runs per variant."""
    rows = trades(spark, sf).groupBy(F.col("band").alias("variant"), stats.half_year(F.col("exit_day")).alias("batch")).agg(
        F.max("exit_day").alias("run_at"), F.avg("ret").alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return rows.withColumn("track", F.when(F.col("batch").endswith("H1"), "cluster")).withColumn("void", F.col("n") < 20)


RESULTS = f"""rl as materialized (select *, case when batch like '%H1' then 'cluster' end as track, n < 20 as void from (
  select band as variant, {HALF.format(d='exit_day')} as batch, max(exit_day) as run_at, avg(ret) as mean, count(*) as n from trades group by 1, 2))"""


@query("newest_result", "I29", "variant:s batch:s run_at:d mean:f n:i best:b",
       o.sql("trades", "select * exclude (k), mean = max(mean) over () as best from (select *, row_number() over (partition by variant order by run_at desc) as k from rl) where k = 1", RESULTS))
def newest_result(spark, sf):
    rows = evidence.newest(result_ledger(spark, sf), "variant", "run_at")
    return rows.withColumn("best", F.col("mean") == F.max("mean").over(Window.partitionBy(F.lit(0))))


@query("ledger_append", "A16", "batch:s symbol:s day:d net_ret:f",
       o.sql("trades", "select band as batch, symbol, day, net_ret from trades"))
def ledger_append(spark, sf):
    """Two batches appended to a fresh ledger and read back."""
    path = f"{shared_dir(spark)}/crosstape/appended-{uuid.uuid4().hex}"
    rows = trades(spark, sf).select("band", "symbol", "day", "net_ret")
    for band in ("micro", "small"):
        ledger.append(rows.filter(F.col("band") == band).drop("band"), path, band)
    return ledger.read_ledger(spark, path).select("batch", "symbol", "day", "net_ret")


@query("ledger_read", "A17", "variant:s batch:s run_at:d mean:f n:i",
       o.sql("trades", "select * from rl where coalesce(track, 'cluster') = 'cluster' and not void order by run_at desc, variant limit 5", RESULTS))
def ledger_read(spark, sf):
    return ledger.filtered(result_ledger(spark, sf).withColumnRenamed("run_at", "at"), track="cluster", limit=5).withColumnRenamed("at", "run_at")


@query(
    "exposure_control", "I31", "arms:i r:f",
    o.sql("signals bars sess", "select count(*) as arms, corr(o.mean_held, b.dd) as r from occr o join (select arm, avg(dd) as dd from blk group by arm) b using (arm)", *ARM_CTES, CURVE, BLOCKS, OCC),
)
def exposure_control(spark, sf):
    t, s = arm_trades(spark, sf), sessions(spark, sf)
    held = evidence.occupancy_report(evidence.occupancy(t, s, ARM_NAMES), 5)
    dd = evidence.block_drawdowns(evidence.daily_curve(t, s, ARM_NAMES, 300_000.0, 450.0)).groupBy("arm").agg(F.avg("dd").alias("dd"))
    return held.join(dd, "arm").agg(F.count(F.lit(1)).alias("arms"), stats.correlation("mean_held", "dd").alias("r"))


# --- variants of selection ----------------------------------------------------


def _label_picks(spark, sf, picks, arm: str = "arm"):
    """Picks labelled once for each value of ``arm``; picks are some seats of every session.

    A picked bar is marked where it lies, in its symbol's partition: only marked bars get a path, and none is shuffled.
    The marks follow the calendar, not the listed names, so they are broadcast, from files: what ranks the days may
    take longer than a broadcast is waited for.
    """
    marks = durable(picks.groupBy("symbol", "day").agg(F.collect_list(arm).alias("_arms")))
    picked = F.col("_arms").isNotNull()
    rows = features(spark, sf).select("symbol", "day", "ix", "open", "high", "low", "close").join(F.broadcast(marks), ["symbol", "day"], "left")
    labelled = outcomes.barrier(outcomes.with_path(rows, 10, only=picked).filter(picked)).drop("path")
    return labelled.withColumn(arm, F.explode("_arms")).drop("_arms")


LIT = ["base", "skip_month", "max_screen", "both"]


def _lit_sql() -> tuple[str, ...]:
    parts = [f"mb as materialized (select b.*, lag21.m as mom from bands b join (select symbol, day, lag(close, 21) over ({o.S}) / lag(close, 146) over ({o.S}) - 1e0 as m from bars) lag21 using (symbol, day))"]
    sel = []
    for name in LIT:
        mom = "mom" if name in ("skip_month", "both") else "rs_raw"
        src = "mb"
        if name in ("max_screen", "both"):
            src = f"l_{name}"
            parts.append(f"""{src} as materialized (select * from (select *, row_number() over (partition by day, band order by coalesce(max_ret21, 0e0) desc, size_rank) as k,
              count(*) over (partition by day, band) as m from mb where {mom} is not null) where k > floor(m * 0.1e0))""")
        parts.append(o.scored_cte(f"s_{name}", src, momentum=mom))
        sel.append(f"""select '{name}' as arm, symbol, day, ix from (select *, row_number() over (partition by day, band order by score desc, size_rank) as rank from s_{name})
          where rank <= case band when 'micro' then 3 else 2 end and breakout and not locked""")
    parts.append("lits as materialized (" + " union all ".join(sel) + ")")
    parts.append(o.label_cte("lt", "lits", keys="arm"))
    return tuple(parts)


@query("literature_variants", "I32 C10 B4", "arm:s n:i mean:f se:f", o.sql("bands", "select arm, count(ret) as n, avg(ret) as mean, stddev_samp(ret) / sqrt(count(ret)) as se from lt group by arm", *_lit_sql()))
def literature_variants(spark, sf):
    """All four variants ride in one pass as an arm column; ranks are taken per arm."""
    mom = features(spark, sf).select("symbol", "day", bar_return(125, 21).alias("mom"))
    rows = bands(spark, sf).join(mom, ["symbol", "day"])
    rows = outcomes.arm_grid(rows, [{"arm": a, "skip": a in ("skip_month", "both"), "share": 0.1 if a in ("max_screen", "both") else 0.0} for a in LIT])
    rows = selection.scoreable(rows.withColumn("momentum", F.when(F.col("skip"), F.col("mom")).otherwise(F.col("rs_raw"))), "momentum")
    by = ["arm", "day", "band"]
    rows = selection.lottery_screen(rows, by, F.col("share"))
    top = selection.pick(selection.score(rows, by), by, 3)
    quota = F.when(F.col("band") == "micro", 3).otherwise(2)
    arms = top.filter((F.col("rank") <= quota) & F.col("trig") & ~F.col("locked")).select("symbol", "day", "ix", "arm")
    return _label_picks(spark, sf, arms).groupBy("arm").agg(*stats.sample_bars())


WEIGHTS = {"neutral": (1.0, 1.0, 1.0, 1.0), "deliv_15": (1.0, 1.5, 1.0, 1.0), "deliv_20": (1.0, 2.0, 1.0, 1.0), "rs_15": (1.5, 1.0, 1.0, 1.0), "near_high_15": (1.0, 1.0, 1.0, 1.5)}


def _weights_sql() -> tuple[str, ...]:
    arm = lambda n, w: (
        f"select '{n}' as arm, *, (0e0 + r_rs * {w[0]}e0 + r_deliv * {w[1]}e0 + r_liq * {w[2]}e0 + r_near_high * {w[3]}e0) / {sum(w)}e0 as sc from scored"
    )
    return (
        "wa as materialized (" + " union all ".join(arm(n, w) for n, w in WEIGHTS.items()) + ")",
        "wp as materialized (select * from (select *, row_number() over (partition by arm, day, band order by sc desc, size_rank) as rank from wa) where rank <= case band when 'micro' then 3 else 2 end and breakout and not locked)",
        o.label_cte("wt", "wp", keys="arm"),
    )


@query("weight_variants", "I33", "arm:s n:i mean:f se:f gap:f gap_t:f",
       o.sql("scored", """select e.arm, e.n, e.mean, e.se, case when e.n >= 2 and c.n >= 2 then e.mean - c.mean end as gap, case when e.n >= 2 and c.n >= 2 then (e.mean - c.mean) / nullif(sqrt(e.sd * e.sd / e.n + c.sd * c.sd / c.n), 0) end as gap_t
          from we e, we c where c.arm = 'neutral'""", *_weights_sql(),
             "we as materialized (select arm, count(ret) as n, avg(ret) as mean, stddev_samp(ret) as sd, stddev_samp(ret) / sqrt(count(ret)) as se from wt group by arm)"))
def weight_variants(spark, sf):
    sets = {n: dict(zip(selection.SCORED, w)) for n, w in WEIGHTS.items()}
    rows = selection.score_by_weights(selection.scoreable(bands(spark, sf)), ["day", "band"], sets)
    top = selection.pick(rows, ["arm", "day", "band"], 3)
    quota = F.when(F.col("band") == "micro", 3).otherwise(2)
    arms = top.filter((F.col("rank") <= quota) & F.col("trig") & ~F.col("locked")).select("symbol", "day", "ix", "arm")
    return evidence.welch_vs_control(_label_picks(spark, sf, arms).groupBy("arm").agg(*stats.sample_bars()), "neutral")


IMPACTS = (0.0, 0.5, 1.0, 2.0, 3.0)


@query(
    "impact_sensitivity", "I34", "c:f n:i mean_net:f median_impact:f max_impact:f surviving_pct:f break_even_c:f",
    o.sql(
        "label",
        "select *, max(case when mean_net > 0 then c end) over () as break_even_c from (" + " union all ".join(
            f"select {c}e0 as c, count(*) as n, avg(net_ret) as mean_net, median(imp) as median_impact, max(imp) as max_impact, avg(cast(net_ret > 0 as int)) * 100 as surviving_pct from n{i}" for i, c in enumerate(IMPACTS)
        ) + ")",
        *[o.net_cte(f"n{i}", "label", c=f"{c}e0") for i, c in enumerate(IMPACTS)],
    ),
)
def impact_sensitivity(spark, sf):
    base = trades(spark, sf).select(*[c for c in TRADE_COLUMNS if c not in ("qty", "buy", "net", "net_ret", "cost_pct", "imp")])
    arms = outcomes.arm_grid(base, [{"c": c} for c in IMPACTS])
    net = outcomes.net_trade(arms, c=F.col("c"))
    med = evidence.exact_median(net, "imp", ["c"], "median_impact").drop("n")
    rows = net.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.avg("net_ret").alias("mean_net"), F.max("imp").alias("max_impact"), (F.avg((F.col("net_ret") > 0).cast("int")) * 100).alias("surviving_pct")
    ).join(med, "c")
    return rows.withColumn("break_even_c", F.max(F.when(F.col("mean_net") > 0, F.col("c"))).over(Window.partitionBy(F.lit(0))))


@query(
    "pooled_vs_band", "I36", "measure:s band_value:f pooled_value:f winner:s",
    o.sql(
        "cands pooled_cands bars",
        """select measure, b as band_value, p as pooled_value, case when b is null or p is null or round(b, 9) = round(p, 9) then 'tie' when (b > p) = up then 'band' else 'pooled' end as winner from (
           select m.measure, m.up, max(case when arm = 'band' then v end) as b, max(case when arm = 'pooled' then v end) as p from (
             select arm, unnest(['n', 'mean', 'sd', 'se', 'win', 'worst', 'best', 'stops', 'targets']) as measure, unnest([n, mean, sd, se, win, worst, best, stops, targets]) as v from (
               select arm, cast(count(*) as double) as n, avg(ret) as mean, stddev_samp(ret) as sd, stddev_samp(ret) / sqrt(count(*)) as se, avg(cast(ret > 0 as int)) * 100 as win, min(ret) as worst, max(ret) as best,
                 avg(cast(why = 'stop' as int)) * 100 as stops, avg(cast(why = 'target' as int)) * 100 as targets from pvt group by arm)) x
             join (values ('n', true), ('mean', true), ('sd', false), ('se', false), ('win', true), ('worst', true), ('best', true), ('stops', false), ('targets', true)) m(measure, up) using (measure) group by 1, 2)""",
        """pvs as materialized (select 'band' as arm, symbol, day, ix from cands where triggered and band_rank <= case band when 'micro' then 3 else 2 end
           union all select 'pooled', symbol, day, ix from (select *, row_number() over (partition by day order by floor(score * 10 + 0.5e0) / 10 desc, band_ix, rank) as slot from pooled_cands) where slot <= 5 and triggered)""",
        o.label_cte("pvt", "pvs", keys="arm"),
    ),
)
def pooled_vs_band(spark, sf):
    a = selection.allocate(candidates(spark, sf)).select("symbol", "day", "ix", F.lit("band").alias("arm"))
    b = selection.allocate_pooled(pooled_candidates(spark, sf)).select("symbol", "day", "ix", F.lit("pooled").alias("arm"))
    t = _label_picks(spark, sf, a.unionByName(b))
    pct = lambda c: (F.avg(c.cast("int")) * 100)
    m = t.groupBy("arm").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), (F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1)))).alias("se"),
        pct(F.col("ret") > 0).alias("win"), F.min("ret").alias("worst"), F.max("ret").alias("best"), pct(F.col("why") == "stop").alias("stops"), pct(F.col("why") == "target").alias("targets"),
    )
    long = m.unpivot(["arm"], [c for c in m.columns if c != "arm"], "measure", "v")
    wide = long.groupBy("measure").agg(
        F.max(F.when(F.col("arm") == "band", F.col("v"))).alias("band_value"), F.max(F.when(F.col("arm") == "pooled", F.col("v"))).alias("pooled_value")
    )
    up = ~F.col("measure").isin("sd", "se", "stops")
    x, y = F.col("band_value"), F.col("pooled_value")
    return wide.withColumn("winner", F.when(x.isNull() | y.isNull() | (F.round(x, 9) == F.round(y, 9)), "tie").when((x > y) == up, "band").otherwise("pooled"))


@query(
    "grouped_error_bars", "K1", "grp:i band:s block:s n:i mean:f se:f",
    o.sql("trades", f"""select case when grouping(band) = 1 and grouping(block) = 1 then 3 when grouping(block) = 1 then 1 else 2 end as grp, band, block, count(ret) as n, avg(ret) as mean, stddev_samp(ret) / sqrt(count(ret)) as se
       from (select band, {HALF.format(d='exit_day')} as block, ret from trades) group by grouping sets ((), (band), (block))"""),
)
def grouped_error_bars(spark, sf):
    t = trades(spark, sf).withColumn("block", stats.half_year(F.col("exit_day")))
    rows = t.groupingSets([[], [F.col("band")], [F.col("block")]], F.col("band"), F.col("block")).agg(F.grouping_id().alias("grp"), *stats.sample_bars())
    return rows


FWD = """fwd as materialized (select count(*) as closed, avg(held) as mean_hold, avg(ret) as mean, (select date_diff('day', min(day), max(day)) / 30.4375e0 from trades) as months, stddev_samp(ret) / sqrt(count(*)) as se
  from (select *, exit_ix - ix - 1 as held from trades))"""


@query(
    "forward_checks", "I30", "check_name:s value:f state:s",
    o.sql("trades sess", """select 'rate' as check_name, closed as value, case when months < 6 then 'early' when closed between 2.86e0 * months - 1.96e0 * sqrt(greatest(2.86e0 * months, 1e0)) and 2.86e0 * months + 1.96e0 * sqrt(greatest(2.86e0 * months, 1e0)) then 'pass' else 'fail' end as state from fwd
       union all select 'hold', mean_hold, case when closed < 10 then 'early' when mean_hold between 4 and 10 then 'pass' else 'fail' end from fwd
       union all select 'occupancy', oc, case when closed < 10 then 'early' when abs(oc - 3.1e0) <= 1 then 'pass' else 'fail' end from fwd, (
         select avg(h) as oc from (select s.day, (select count(*) from trades t where t.entry_day <= s.day and t.exit_day > s.day) as h from sess s))
       union all select 'edge', mean, case when closed < 195 then 'early' when abs(mean - 2.15e0) <= 1.96e0 * sqrt(se * se + 1.08e0 * 1.08e0) then 'pass' else 'fail' end from fwd""", FWD),
)
def forward_checks(spark, sf):
    t = trades(spark, sf)
    f = t.agg(
        F.count(F.lit(1)).alias("closed"), F.avg(F.col("exit_ix") - F.col("ix") - 1).alias("mean_hold"), F.avg("ret").alias("mean"),
        (F.datediff(F.max("day"), F.min("day")) / 30.4375).alias("months"), (F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )
    occ = evidence.occupancy(t.withColumn("arm", F.lit("main")), sessions(spark, sf), ["main"]).agg(F.avg("held")).scalar()
    return evidence.forward_checks(f.withColumn("occ", occ))
