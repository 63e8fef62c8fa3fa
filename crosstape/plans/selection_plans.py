"""Cross-sectional bands, scores, picks, allocation and sizing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.indicators import bar_return
from ..operators import asof, ranking, selection
from ..sources import derived
from . import oracle as o
from .common import bands, bars, candidates, corpus, picks, pooled_candidates, scored, sessions
from .spec import query

TONE = {"error": -1, "purchase": 1, "signup": 1, "view": 0}
FLAG_CATEGORIES = ("error",)

CAND_COLS = "symbol:s day:d band:s score:f rank:i band_rank:i qty:i stop:f target:f risk:f triggered:b"


@query("size_bands", "D3", "symbol:s day:d band:s size_rank:i size_med:f", o.sql("bands", "select * from bands"))
def size_bands(spark, sf):
    return bands(spark, sf)


@query(
    "size_bands_four", "D3", "symbol:s day:d band:s",
    o.sql(
        "bands",
        """select symbol, day, case when size_rank < floor(cut / 4) then 'q1' when size_rank < floor(2 * cut / 4) then 'q2'
           when size_rank < floor(3 * cut / 4) then 'q3' else 'q4' end as band from bands""",
    ),
)
def size_bands_four(spark, sf):
    return ranking.size_bands(corpus(spark, sf), ("q1", "q2", "q3", "q4"))


RANK_COLS = "symbol:s day:d band:s r_rs:f r_deliv:f r_liq:f r_near_high:f score:f"


@query("band_scores", "D4 D6 B3", RANK_COLS, o.sql("scored", "select * from scored"))
def band_scores(spark, sf):
    return scored(spark, sf)


@query(
    "inverted_score", "D6", "symbol:s day:d score:f",
    o.sql("scored", "select symbol, day, (0e0 + r_rs * 1e0 + (100e0 - r_deliv) * 1.5e0 + r_liq * 1e0 + r_near_high * 1e0) / 4.5e0 as score from scored"),
)
def inverted_score(spark, sf):
    return scored(spark, sf, inverted=("deliv",))


NEUTRAL = """case when {f} is null then 50e0 else row_number() over (partition by day, band, {f} is not null order by {f}, size_rank)
  / count(*) over (partition by day, band, {f} is not null) * 100e0 end"""
ANN_FEATURES_CTE = """ann_days as materialized (select symbol, visible_from, count(*) as n, max(category = 'error') as flagged,
   arg_min(case category when 'error' then -1e0 when 'purchase' then 1e0 when 'signup' then 1e0 when 'view' then 0e0 end, (an_dt, event_id))
     filter (where category in ('error', 'purchase', 'signup', 'view')) as tone
   from annv group by 1, 2),
annf as materialized (select p.symbol, p.day, coalesce(sum(a.n), 0) as base_n, coalesce(sum(a.n) filter (where a.visible_from >= p.day - 30), 0) as recent_n,
   arg_max(a.tone, a.visible_from) filter (where a.visible_from >= p.day - 30 and a.tone is not null) as t, max(a.flagged) filter (where a.visible_from >= p.day - 30) as fl
   from bars p left join ann_days a on a.symbol = p.symbol and a.visible_from between p.day - 365 and p.day group by 1, 2),
annx as materialized (select symbol, day, recent_n, base_n, case when base_n > 0 then (recent_n - base_n / 365 * 30) / (base_n / 365 * 30 + 1e0) end as ann_burst,
   case when base_n > 0 then coalesce(t, 0e0) end as ann_tone, case when base_n > 0 then case when fl then 1e0 else 0e0 end end as ann_flag from annf)"""


def announcement_points(spark, sf, points, names=None):
    """Attach the announcement features to (symbol, day) rows. ``names``: the symbols of the points, where these are few."""
    cal = sessions(spark, sf).filter(F.weekday("day") < 5)
    raw = derived.announcements_raw(spark, sf)
    if names is not None:
        raw = raw.join(F.broadcast(names), "symbol", "left_semi")
    vis = asof.with_visibility(raw, cal)
    return asof.announcement_features(points, asof.announcement_days(vis, TONE, FLAG_CATEGORIES))


@query(
    "announcement_score", "D5 D7", "symbol:s day:d r_burst:f r_tone:f score:f",
    o.sql(
        "bands annv",
        """select symbol, day, r_burst, r_tone, (0e0 + r_rs * 1e0 + r_deliv * 1.5e0 + r_liq * 1e0 + r_near_high * 1e0 + r_burst * 1e0 + r_tone * 1e0) / 6.5e0 as score
           from z1 where close > sma200""",
        ANN_FEATURES_CTE,
        """z0 as materialized (select b.*, rs_raw as x_rs, coalesce(deliv_mean, 0e0) as x_deliv, coalesce(liq, 0e0) as x_liq, near_high as x_near_high,
           a.ann_burst, a.ann_tone from bands b join annx a using (symbol, day) where rs_raw is not null)""",
        f"z1 as materialized (select *, {o.SCORE_RANKS('day, band')}, {NEUTRAL.format(f='ann_burst')} as r_burst, {NEUTRAL.format(f='ann_tone')} as r_tone from z0)",
    ),
)
def announcement_score(spark, sf):
    rows = selection.scoreable(announcement_points(spark, sf, bands(spark, sf)))
    out = selection.score(rows, ["day", "band"], extra=("ann_burst", "ann_tone"))
    return out.withColumnRenamed("r_ann_burst", "r_burst").withColumnRenamed("r_ann_tone", "r_tone")


@query("band_picks", "D8", "symbol:s day:d band:s score:f rank:i", o.sql("picks", "select * from picks"))
def band_picks(spark, sf):
    return picks(spark, sf)


@query("pooled_picks", "D8 K4", CAND_COLS, o.sql("pooled_cands", "select * from pooled_cands"))
def pooled_picks(spark, sf):
    return pooled_candidates(spark, sf)


@query("candidates", "D9 B1 B2", CAND_COLS, o.sql("cands", "select * from cands"))
def candidates_query(spark, sf):
    return candidates(spark, sf)


@query("allocation", "D10", "symbol:s day:d band:s band_rank:i seat:i", o.sql("alloc", "select * from alloc"))
def allocation(spark, sf):
    return selection.allocate(candidates(spark, sf))


@query(
    "allocation_second_cohort", "D10 D13", "symbol:s day:d band:s band_rank:i seat:i",
    o.sql(
        "cands",
        """select *, row_number() over (partition by day order by slot) as seat from (
             select *, row_number() over (partition by day order by band_rank - 1 - quota, take_ix) as slot from qt where band_rank > quota and band_rank <= 2 * quota) where triggered""",
        "qt as materialized (select *, case band when 'micro' then 3 else 2 end as quota, case band when 'micro' then 0 else 1 end as take_ix from cands)",
    ),
)
def allocation_second_cohort(spark, sf):
    return selection.allocate(candidates(spark, sf), offset=1)


@query(
    "allocation_pooled", "D11", "symbol:s day:d band:s slot:i",
    o.sql(
        "pooled_cands",
        """select * from (select *, row_number() over (partition by day order by floor(score * 10 + 0.5e0) / 10 desc, band_ix, rank) as slot from pooled_cands)
           where slot <= 5 and triggered""",
    ),
)
def allocation_pooled(spark, sf):
    return selection.allocate_pooled(pooled_candidates(spark, sf))


@query(
    "allocation_minimum", "D12", "symbol:s day:d triggered:b seat:i",
    o.sql(
        "cands",
        """select * from (select *, sum(cast(triggered as int)) over (partition by day) as nt, row_number() over (partition by day order by triggered desc, slot) as seat from (
             select *, row_number() over (partition by day order by band_rank - 1, take_ix) as slot from qt where band_rank <= quota)) where seat <= greatest(nt, 2)""",
        "qt as materialized (select *, case band when 'micro' then 3 else 2 end as quota, case band when 'micro' then 0 else 1 end as take_ix from cands)",
    ),
)
def allocation_minimum(spark, sf):
    return selection.allocate(candidates(spark, sf), minimum=2)


@query(
    "rank_cohorts", "D13", "cohort:i band:s n:i fired:i",
    o.sql(
        "cands",
        """select cohort, band, count(*) as n, sum(cast(triggered as int)) as fired from (
             select *, floor((band_rank - 1) / case band when 'micro' then 3 else 2 end) as cohort from cands) where cohort < 6 group by 1, 2""",
    ),
)
def rank_cohorts(spark, sf):
    rows = selection.cohorts(candidates(spark, sf))
    return rows.groupBy("cohort", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("triggered").cast("int")).alias("fired"))


@query(
    "seat_scarcity", "D14", "day:d gated:i triggered:i bought:i missed:i median_missed_rank:f deepest_missed_rank:i",
    o.sql(
        "cands",
        """select day, count(*) as gated, sum(cast(triggered as int)) as triggered, sum(cast(triggered and band_rank <= q as int)) as bought,
           count(m) as missed, median(m) as median_missed_rank, max(m) as deepest_missed_rank from (
             select *, case when triggered and band_rank > q then band_rank end as m from (
               select *, case band when 'micro' then 3 else 2 end as q from cands)) group by day""",
    ),
)
def seat_scarcity(spark, sf):
    return selection.seat_scarcity(candidates(spark, sf))


TAIL = "list(ret1) filter (where ret1 is not null) over " + o.win(-59)
REFRESH_CANDS = f"""tails as materialized (select symbol, day, {TAIL} as tail60 from feat),
rc as materialized (select c.symbol, c.day, t.tail60, row_number() over (partition by c.day order by floor(c.score * 10 + 0.5e0) / 10 desc, c.band_ix, c.rank) as slot
  from cands c join tails t using (symbol, day) join sess s using (day) where s.session_ix % 5 = 0),
pr0 as materialized (select a.day, a.slot as slot_a, b.slot as slot_b, a.symbol as sym_a, b.symbol as sym_b, a.tail60 as ta, b.tail60 as tb, least(len(a.tail60), len(b.tail60)) as n
  from rc a join rc b on a.day = b.day and a.slot < b.slot),
pr1 as materialized (select *, list_slice(ta, len(ta) - n + 1, len(ta)) as xa, list_slice(tb, len(tb) - n + 1, len(tb)) as xb from pr0),
pr2 as materialized (select *, list_transform(xa, lambda x: x - list_sum(xa) / n) as ca, list_transform(xb, lambda x: x - list_sum(xb) / n) as cb from pr1),
pr3 as materialized (select *, list_dot_product(ca, ca) as va, list_dot_product(cb, cb) as vb, list_dot_product(ca, cb) as cv from pr2),
pairs as materialized (select day, slot_a, slot_b, sym_a, sym_b, case when n >= 20 and va > 1e-18 and vb > 1e-18 then cv / (sqrt(va) * sqrt(vb)) else 0e0 end as corr from pr3)"""


def refresh_candidates(spark, sf, every=selection.REFRESH):
    """Candidates of every ``every``-th session in list order, each with its last 60 returns."""
    b = bars(spark, sf).withColumn("ret1", bar_return(1)).withColumn("tail60", selection.tail_returns(bars(spark, sf)))
    c = candidates(spark, sf)
    w = Window.partitionBy("day").orderBy(selection.tenths("score").desc(), "band_ix", "rank")
    s = sessions(spark, sf).filter(F.col("session_ix") % every == 0).select("day")
    return c.join(s, "day", "left_semi").withColumn("slot", F.row_number().over(w)).join(b.select("symbol", "day", "tail60"), ["symbol", "day"])


@query(
    "pair_correlations", "D15 G12", "day:d sym_a:s sym_b:s corr:f",
    o.sql("cands sess feat", "select * from pairs", REFRESH_CANDS),
)
def pair_correlations(spark, sf):
    return selection.pair_correlations(refresh_candidates(spark, sf))


# Rows are decided in list order; a row stays unless it clashes with a row already kept.
DECORRELATED = """days as materialized (select day, max(slot) as n from rc group by day),
           walk as (select day, n, 1 as slot, [1] as keep from days
             union all select w.day, w.n, w.slot + 1,
               case when exists (select 1 from pairs p where p.day = w.day and p.slot_b = w.slot + 1 and list_contains(w.keep, cast(p.slot_a as int)) and abs(p.corr) > 0.2e0)
                 then w.keep else list_append(w.keep, w.slot + 1) end from walk w where w.slot < w.n),
           kept as (select day, unnest(keep) as slot from walk where slot = n)"""
KEPT = "select k.day, k.slot, rc.symbol from kept k join rc using (day, slot)"


@query("decorrelated", "D16", "day:d slot:i symbol:s", o.sql("cands sess feat", KEPT, REFRESH_CANDS, DECORRELATED))
def decorrelated(spark, sf):
    return selection.decorrelated(refresh_candidates(spark, sf), 0.2)


@query("decorrelated_other_sessions", "D16 G12", "day:d slot:i symbol:s", o.sql("cands sess feat", KEPT, REFRESH_CANDS.replace("s.session_ix % 5 = 0", "s.session_ix % 3 = 0"), DECORRELATED))
def decorrelated_other_sessions(spark, sf):
    """The same with another refresh interval."""
    return selection.decorrelated(refresh_candidates(spark, sf, 3), 0.2)


@query(
    "position_sizes", "D17", "symbol:s day:d qty:i qty_small_book:i qty_twelve:i risk_rupees:f",
    o.sql(
        "feat",
        """select symbol, day, least(floor(300000e0 * 2e0 / 100 / (next_open * 10e0 / 100)), floor(300000e0 * 75e0 / 100 / 5 * 1e0 / next_open)) as qty,
           least(floor(50000e0 * 2e0 / 100 / (next_open * 10e0 / 100)), floor(50000e0 * 75e0 / 100 / 5 * 1e0 / next_open)) as qty_small_book,
           least(floor(300000e0 * 2e0 / 100 / (next_open * 10e0 / 100)), floor(300000e0 * 75e0 / 100 / 12 * 1e0 / next_open)) as qty_twelve,
           least(floor(300000e0 * 2e0 / 100 / (next_open * 10e0 / 100)), floor(300000e0 * 75e0 / 100 / 5 * 1e0 / next_open)) * (next_open * 10e0 / 100) as risk_rupees
           from feat where next_open > 0""",
    ),
)
def position_sizes(spark, sf):
    from ..functions.frames import series

    e = F.col("next_open")
    rows = bars(spark, sf).withColumn("next_open", F.lead("open", 1).over(series())).filter(e > 0)
    return rows.select(
        "symbol", "day", costs.position_qty(e).alias("qty"), costs.position_qty(e, 50_000.0).alias("qty_small_book"),
        costs.position_qty(e, seats=12).alias("qty_twelve"), (costs.position_qty(e) * (e * 10.0 / 100)).alias("risk_rupees"),
    )


MULT_INV = "case when vol_pct > 0 and med > 0 then greatest(0.5e0, least(2e0, med / vol_pct)) else 1e0 end"
MULT_CONV = "greatest(0.5e0, least(2e0, 1.6e0 - 0.3e0 * (seat - 1)))"


@query(
    "size_multipliers", "D18", "symbol:s day:d seat:i scheme:s mult:f sized_qty:i",
    o.sql(
        "alloc",
        " union all ".join(
            f"""select symbol, day, seat, '{n}' as scheme, {m} as mult, least(floor(300000e0 * 2e0 / 100 / (next_open * 10e0 / 100)),
                floor(300000e0 * 75e0 / 100 / 5 * ({m}) / next_open)) as sized_qty from am"""
            for n, m in [("equal", "1e0"), ("invvol", MULT_INV), ("conviction", MULT_CONV), ("both", f"sqrt(({MULT_INV}) * ({MULT_CONV}))")]
        ),
        "am as materialized (select *, median(vol_pct) over (partition by day) as med from alloc where next_open > 0)",
    ),
)
def size_multipliers(spark, sf):
    rows = selection.allocate(candidates(spark, sf)).filter(F.col("next_open") > 0)
    med = F.percentile("vol_pct", 0.5).over(Window.partitionBy("day"))
    rows = rows.withColumn("_med", med)
    cells = [
        F.struct(F.lit(s).alias("scheme"), costs.size_mult(s, F.col("seat") - 1, F.col("vol_pct"), F.col("_med")).alias("mult"))
        for s in ("equal", "invvol", "conviction", "both")
    ]
    out = rows.withColumn("_c", F.explode(F.array(*cells))).select("symbol", "day", "seat", "next_open", "_c.*")
    return out.withColumn("sized_qty", costs.position_qty(F.col("next_open"), mult=F.col("mult")))


@query(
    "chosen_untriggered", "D19", "symbol:s day:d band:s band_rank:i triggered:b",
    o.sql("cands", "select * from cands where band_rank <= case band when 'micro' then 3 else 2 end"),
)
def chosen_untriggered(spark, sf):
    return selection.chosen(candidates(spark, sf))


@query(
    "band_capped", "D20", "symbol:s day:d band:s held:i take_no:i",
    o.sql(
        "cands sess",
        """select symbol, day, band, held, take_no from (select c.*, coalesce(h.held, 0) as held, row_number() over (partition by c.day, c.band order by c.band_rank) as take_no
             from cands c left join held h on h.day = c.day and h.band = c.band) where take_no <= 3 - held""",
        """held as materialized (select s.day, band, count(*) as held from (select symbol, day, band, session_ix from cands join sess using (day) where triggered and band_rank <= 2) o
             join sess s on s.session_ix between o.session_ix + 1 and o.session_ix + 3 group by 1, 2)""",
    ),
)
def band_capped(spark, sf):
    c = candidates(spark, sf)
    s = sessions(spark, sf)
    # Taken names stay three sessions; each adds to the count of the sessions after it.
    taken = c.filter(F.col("triggered") & (F.col("band_rank") <= 2)).join(s, "day").groupBy("band", "session_ix").agg(F.count(F.lit(1)).alias("n"))
    later = taken.select("band", "n", F.explode(F.sequence(F.col("session_ix") + 1, F.col("session_ix") + 3)).alias("session_ix"))
    held = later.groupBy("band", "session_ix").agg(F.sum("n").alias("held")).join(s, "session_ix").select("day", "band", "held")
    return selection.band_capped(c, held, 3)


@query(
    "lottery_screened", "B4 I32", "symbol:s day:d band:s score:f rank:i",
    o.sql(
        "bands",
        "select * from (select *, row_number() over (partition by day, band order by score desc, size_rank) as rank from ls) where rank <= 20",
        """lot as materialized (select * from (select *, row_number() over (partition by day, band order by coalesce(max_ret21, 0e0) desc, size_rank) as k,
           count(*) over (partition by day, band) as m from bands where rs_raw is not null) where k > floor(m * 0.1e0))""",
        o.scored_cte("ls", "lot"),
    ),
)
def lottery_screened(spark, sf):
    rows = selection.lottery_screen(selection.scoreable(bands(spark, sf)), ["day", "band"], 0.1)
    return selection.pick(selection.score(rows, ["day", "band"]), ["day", "band"], selection.PER_BAND)


@query(
    "refresh_sessions", "G12", "day:d session_ix:i",
    o.sql("sess", "select * from sess where session_ix % 5 = 0"),
)
def refresh_sessions(spark, sf):
    return sessions(spark, sf).filter(F.col("session_ix") % selection.REFRESH == 0)
