"""Order book, quality assertions and reports over position events derived from the trade ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import asof, book, selection, universe
from ..session import durable
from . import oracle as o
from .common import bars, candidates, corpus, denylist, sessions, trades
from .spec import query


def as_date(text: str):
    return F.lit(text).cast("date")


EVENTS = """psr as materialized (select *, 'main' as bucket, nqty as bqty from trades union all
  select *, 'pooled' as bucket, case when ix % 6 = 0 then nqty + 2 else nqty end from trades where ix % 3 = 0),
ps as materialized (select *, concat(bucket, '|', symbol, '|', cast(ix as varchar)) as id, ix % 50 = 7 as void from psr),
evs as materialized (
  select id, 1 as seq, day as at_day, symbol, band, bucket, 'pending' as status, day as queued_on, null::date as entry_day, null::double as entry_px, bqty as qty, close * (1 - 10e0 / 100) as stop, close * (1 + 20e0 / 100) as target,
    null::date as exit_day, null::double as exit_px, null::varchar as exit_reason, null::double as net from ps
  union all select id, 2, entry_day, symbol, band, bucket, case when void then 'void' else 'open' end, day, case when not void then entry_day end, case when not void then entry_px end, bqty,
    case when void then close * (1 - 10e0 / 100) else stop_px end, case when void then close * (1 + 20e0 / 100) else target_px end, null, null, case when void then 'withdrawn' end, null from ps
  union all select id, 3, exit_day, symbol, band, bucket, 'closed', day, entry_day, entry_px, bqty, stop_px, target_px, exit_day, exit_px, why, net from ps where not void),
stt as materialized (select * exclude (k) from (select *, row_number() over (partition by id order by seq desc) as k from evs where at_day <= (select max(queued_on) from evs)) where k = 1),
lpx as materialized (select symbol, arg_max(close, day) as px from bars where day <= (select max(queued_on) from evs) group by 1)"""

EVENT_COLS = "id seq at symbol band bucket status queued_on entry_day entry_px qty stop target exit_day exit_px exit_reason net".split()


def events(spark, sf):
    """Every status change of every ledger trade, in two buckets, as an append-only log."""
    t = trades(spark, sf)
    main = t.withColumn("bucket", F.lit("main"))
    pool = t.filter(F.col("ix") % 3 == 0).withColumn("bucket", F.lit("pooled"))
    pool = pool.withColumn("qty", F.when(F.col("ix") % 6 == 0, F.col("qty") + 2).otherwise(F.col("qty")))
    p = main.unionByName(pool).withColumn("id", F.concat_ws("|", "bucket", "symbol", F.col("ix").cast("string"))).withColumn("void", F.col("ix") % 50 == 7)
    none = lambda kind: F.lit(None).cast(kind)
    ref_stop, ref_target = F.col("close") * (1 - 10.0 / 100), F.col("close") * (1 + 20.0 / 100)

    def event(seq, at, status, entry, exit_, stop, target, reason):
        e = (F.col("entry_day"), F.col("entry_px")) if entry is True else (F.when(entry, F.col("entry_day")), F.when(entry, F.col("entry_px"))) if entry is not False else (none("date"), none("double"))
        x = (F.col("exit_day"), F.col("exit_px"), F.col("net")) if exit_ else (none("date"), none("double"), none("double"))
        return F.struct(
            F.lit(seq).alias("seq"), at.alias("at"), status.alias("status"), e[0].alias("entry_day"), e[1].alias("entry_px"), stop.alias("stop"), target.alias("target"),
            x[0].alias("exit_day"), x[1].alias("exit_px"), reason.alias("exit_reason"), x[2].alias("net"),
        )

    live = ~F.col("void")
    log = F.array(
        event(1, F.col("day"), F.lit("pending"), False, False, ref_stop, ref_target, none("string")),
        event(2, F.col("entry_day"), F.when(live, "open").otherwise("void"), live, False, F.when(live, F.col("stop_px")).otherwise(ref_stop),
              F.when(live, F.col("target_px")).otherwise(ref_target), F.when(~live, "withdrawn")),
        event(3, F.col("exit_day"), F.lit("closed"), True, True, F.col("stop_px"), F.col("target_px"), F.col("why")),
    )
    # A withdrawn order has no third event.
    log = F.filter(log, lambda e: (e["seq"] < 3) | live)
    flat = p.select("id", "symbol", "band", "bucket", F.col("day").alias("queued_on"), "qty", F.explode(log).alias("_e"))
    return flat.select("id", "symbol", "band", "bucket", "queued_on", "qty", "_e.*").select(*EVENT_COLS)


def book_day(spark, sf):
    """The book is read on the last day an order was queued, unless a day is given."""
    return trades(spark, sf).agg(F.max("day")).scalar()


def state(spark, sf, day=None):
    return book.current_state(events(spark, sf), book_day(spark, sf) if day is None else day)


STATE_COLS = "id:s symbol:s bucket:s status:s queued_on:d entry_day:d entry_px:f qty:i stop:f target:f exit_day:d exit_px:f exit_reason:s net:f"


@query("position_state", "A18", STATE_COLS, o.sql("trades", "select * from stt", EVENTS))
def position_state(spark, sf):
    return state(spark, sf)


@query("pending_orders", "A18", STATE_COLS, o.sql("trades", "select * from stt where status = 'pending'", EVENTS))
def pending_orders(spark, sf):
    return book.view(state(spark, sf), "pending")


@query("open_orders", "A18", STATE_COLS, o.sql("trades", "select * from stt where status = 'open'", EVENTS))
def open_orders(spark, sf):
    return book.view(state(spark, sf), "open")


@query("closed_orders", "A18", STATE_COLS, o.sql("trades", "select * from stt where status = 'closed'", EVENTS))
def closed_orders(spark, sf):
    return book.view(state(spark, sf), "closed")


@query(
    "record_replay", "A19 K2", "only_in:s id:s status:s",
    # The live table is the full state with the rows of one week lost; the replay finds exactly those.
    o.sql("trades", """select 'log' as only_in, id, status from (select *, row_number() over (partition by id order by seq desc) as k from evs) where k = 1 and queued_on between date '1998-03-02' and date '1998-03-06'""", EVENTS),
)
def record_replay(spark, sf):
    log = events(spark, sf)
    live = book.current_state(log).filter(~F.col("queued_on").between(as_date("1998-03-02"), as_date("1998-03-06")))
    return book.replay_difference(live, log, ["id", "status", "symbol", "bucket", "qty", "entry_px", "exit_px", "net"])


@query("book_summary", "F10", "bucket:s pending:i open:i closed:i realised:f equity:f",
       o.sql("trades", """select bucket, sum(cast(status = 'pending' as int)) as pending, sum(cast(status = 'open' as int)) as open, sum(cast(status = 'closed' as int)) as closed,
         sum(case when status = 'closed' then net else 0e0 end) as realised, 300000e0 + sum(case when status = 'closed' then net else 0e0 end) as equity from stt group by bucket""", EVENTS))
def book_summary(spark, sf):
    return book.summary(state(spark, sf))


@query(
    "queue_orders", "L2", "day:d bucket:s symbol:s queue_no:i",
    o.sql(
        "cands trades",
        """select * from (select c.day, 'main' as bucket, c.symbol, row_number() over (partition by c.day order by floor(c.score * 10 + 0.5e0) / 10 desc, c.band_ix, c.rank) as queue_no from cands c
           where not exists (select 1 from spans s where s.bucket = 'main' and s.symbol = c.symbol and s.since < c.day and (s.until is null or c.day < s.until))) where queue_no <= 5""",
        EVENTS, "spans as materialized (select bucket, symbol, min(queued_on) as since, min(case when status in ('closed', 'void') then at_day end) as until from evs group by id, bucket, symbol)",
    ),
)
def queue_orders(spark, sf):
    rows = candidates(spark, sf).withColumn("bucket", F.lit("main"))
    return book.queue(rows, book.live_spans(events(spark, sf)), 5, [selection.tenths("score").desc(), F.col("band_ix"), F.col("rank")])


@query("double_live", "M9", "bucket:s symbol:s n:i", o.sql("trades", "select bucket, symbol, count(*) as n from stt where status in ('pending', 'open') group by 1, 2 having count(*) > 1", EVENTS))
def double_live(spark, sf):
    return book.double_live(state(spark, sf))


@query(
    "wallet", "M1", "bucket:s cash:f invested:f unrealised:f realised:f",
    o.sql(
        "trades",
        """select bucket, 300000e0 + sum(case when status = 'closed' then net else 0e0 end) - sum(case when status in ('pending', 'open') then qty * coalesce(entry_px, px) else 0e0 end) as cash,
           sum(case when status in ('pending', 'open') then qty * px else 0e0 end) as invested, sum(case when status = 'open' then qty * (px - entry_px) else 0e0 end) as unrealised,
           sum(case when status = 'closed' then net else 0e0 end) as realised from (select s.* , coalesce(l.px, s.entry_px, 0e0) as px from stt s left join lpx l using (symbol)) group by bucket""",
        EVENTS,
    ),
)
def wallet(spark, sf):
    return book.wallet(state(spark, sf), book.latest_close(bars(spark, sf), book_day(spark, sf)))


SAME = ", ".join(book.SAME_TRADE)


@query("merged_positions", "M2", "symbol:s queued_on:d entry_px:f qty:i buckets:s copies:i",
       o.sql("trades", f"select {SAME}, array_to_string(list_sort(list(distinct bucket)), ',') as buckets, count(*) as copies from stt group by {SAME}", EVENTS))
def merged_positions(spark, sf):
    return book.merged(state(spark, sf))


@query("listed_twice", "M3", "symbol:s lines:i",
       o.sql("trades", f"select symbol, count(*) as lines from (select distinct {SAME} from stt where status in ('open', 'pending')) group by symbol having count(*) > 1", EVENTS))
def listed_twice(spark, sf):
    return book.listed_twice(book.merged(state(spark, sf).filter(F.col("status").isin(*book.LIVE))))


@query("level_distance", "M4", "id:s px:f to_stop:f to_target:f",
       o.sql("trades", "select id, px, (stop / px - 1) * 100 as to_stop, (target / px - 1) * 100 as to_target from stt join lpx using (symbol) where status = 'open'", EVENTS))
def level_distance(spark, sf):
    rows = book.view(state(spark, sf), "open").join(book.latest_close(bars(spark, sf), book_day(spark, sf)), "symbol")
    return rows.select("id", "px", book.away_pct(F.col("px"), F.col("stop")).alias("to_stop"), book.away_pct(F.col("px"), F.col("target")).alias("to_target"))


@query(
    "gate_table", "M5", "gate:s verdict:s",
    o.sql(
        "trades sess",
        """select 'point-in-time data' as gate, case when (select count(*) from sess) > 1000 and gaps = 0 then 'PASS' else 'GAPS' end as verdict from x
           union all select 'enough trades to judge', case when closed >= 213 then 'PASS' else 'PENDING' end from x
           union all select 'forward paper evidence', case when closed = 0 then 'PENDING' else 'MEASURING' end from x
           union all select 'direction', case when closed < 30 then 'TOO EARLY TO SAY' when net > 0 then 'YES' else 'NO' end from x""",
        EVENTS,
        """x as materialized (select (select count(*) from stt where bucket = 'main' and status = 'closed') as closed, (select sum(net) from stt where bucket = 'main' and status = 'closed') as net,
           (select count(*) from (select unnest(generate_series((select min(day) from sess)::timestamp, (select max(day) from sess)::timestamp, interval 1 day)) as d)
              where dayofweek(d) between 1 and 5 and cast(d as date) not in (select day from sess)) as gaps)""",
    ),
)
def gate_table(spark, sf):
    days = sessions(spark, sf).select("day")
    gaps = universe.weekday_gaps(days, days.limit(0))
    done = state(spark, sf).filter("bucket = 'main' and status = 'closed'")
    facts = done.agg(F.count(F.lit(1)).alias("closed"), F.sum("net").alias("net"))
    facts = facts.withColumn("sessions", days.agg(F.count(F.lit(1))).scalar()).withColumn("gaps", gaps.agg(F.count(F.lit(1))).scalar())
    return book.gates(facts.withColumn("needed", stats.trades_needed(F.lit(2.15))))


@query(
    "quality_assertions", "M6 A19 D10", "rule:s ok:b violations:i",
    o.sql(
        "bands cands alloc bars corpus trades sess",
        """select rule, violations = 0 as ok, violations from (
           select 'bands are disjoint' as rule, count(*) as violations from (select symbol, day from bands group by 1, 2 having count(distinct band) > 1)
           union all select 'most liquid names are excluded', count(*) from (select day, max(size_med) as m from band0 group by day) x join bands b on b.day = x.day and b.size_med > x.m
           union all select 'no pick below its 200-bar mean', count(*) from picks where not close > sma200
           union all select 'no restricted candidate', count(*) from cands where asm is not null and surveillance_known
           union all select 'quota respected', count(*) from (select day, band, count(*) as n from alloc group by 1, 2) where n > case band when 'micro' then 3 else 2 end
           union all select 'every taken name has triggered', count(*) from alloc where not triggered
           union all select 'delisted symbols are lost', count(*) from bars where symbol not in (select symbol from corpus) and symbol not in (select symbol from deny) and ix >= 199
           union all select 'bar dated in the future', count(*) from bars where day > date '2026-01-01'
           union all select 'shadow level not below entry', count(*) from trades where not entry_px * 0.95e0 < entry_px
           union all select 'locked bar bought', count(*) from alloc where locked)""",
    ),
)
def quality_assertions(spark, sf):
    from .common import bands, picks

    on = lambda cond: F.count_if(cond)
    banded = bands(spark, sf).select("symbol", "day", "band", "size_med")
    # Three rules read what is taken of the picks (at most forty a day): computed once, kept reliably.
    top_picks = durable(picks(spark, sf))
    c = selection.candidates(top_picks)
    taken = selection.allocate(c).groupBy("day", "band").agg(F.count(F.lit(1)).alias("n"), on(~F.col("triggered")).alias("idle"), on(F.col("locked")).alias("locked"))
    eligible = corpus(spark, sf).filter((F.col("ix") >= 200) & (F.col("size_n") > 100))
    # One row per session: bounded by the calendar.
    top = F.broadcast(eligible.groupBy("day").agg(F.max("size_med").alias("m")))
    named = banded.join(top, "day", "left").groupBy("symbol", "day").agg((F.min("band") != F.max("band")).alias("twice"), on(F.col("size_med") > F.col("m")).alias("above"))
    # Bars are bucketed by symbol, so one row per symbol needs no shuffle.
    b = bars(spark, sf).groupBy("symbol").agg(on(F.col("ix") >= 199).alias("late_bars"), on(F.col("day") > as_date("2026-01-01")).alias("future"))
    known = corpus(spark, sf).select("symbol").union(denylist(spark, sf).select("symbol")).distinct().withColumn("known", F.lit(True))
    quota = F.when(F.col("band") == "micro", 3).otherwise(2)
    return book.assertions([
        named.agg(on(F.col("twice")).alias("bands are disjoint"), F.sum("above").alias("most liquid names are excluded")),
        top_picks.agg(on(~(F.col("close") > F.col("sma200"))).alias("no pick below its 200-bar mean")),
        c.agg(on(F.expr("asm is not null and surveillance_known")).alias("no restricted candidate")),
        taken.agg(on(F.col("n") > quota).alias("quota respected"), F.sum("idle").alias("every taken name has triggered"), F.sum("locked").alias("locked bar bought")),
        b.join(known, "symbol", "left").agg(F.sum(F.when(F.col("known").isNull(), F.col("late_bars")).otherwise(0)).alias("delisted symbols are lost"), F.sum("future").alias("bar dated in the future")),
        trades(spark, sf).agg(on(~(F.col("entry_px") * 0.95 < F.col("entry_px"))).alias("shadow level not below entry")),
    ])


@query("closed_summary", "M7", "band:s n:i won:i hit_rate:f net:f",
       o.sql("trades", "select band, count(*) as n, sum(cast(net > 0 as int)) as won, avg(cast(net > 0 as int)) * 100 as hit_rate, sum(net) as net from stt where status = 'closed' and bucket = 'main' group by grouping sets ((), (band))", EVENTS))
def closed_summary(spark, sf):
    return book.closed_summary(state(spark, sf))


@query("band_shortfall", "M8", "day:d band:s have:i need:i",
       o.sql("cands", """select * from (select d.day, x.band, (select count(*) from cands c where c.day = d.day and c.band = x.band) as have, x.need from (select distinct day from cands) d,
          (values ('micro', 3), ('small', 2)) x(band, need)) where have < need"""))
def band_shortfall(spark, sf):
    return book.shortfall(candidates(spark, sf), selection.TAKE)


@query(
    "reconciled_fills", "H10 L5", "id:s was:f entry_px:f stop:f target:f fill_source:s",
    o.sql(
        "trades",
        """select id, prov as was, case when abs(official - prov) > 0.005e0 then official else prov end as entry_px,
           case when abs(official - prov) > 0.005e0 then official * (1 - 10e0 / 100) else stop end as stop, case when abs(official - prov) > 0.005e0 then official * (1 + 20e0 / 100) else target end as target,
           case when abs(official - prov) > 0.005e0 then 'reconciled' else 'confirmed' end as fill_source from filled""",
        EVENTS,
        """opn as materialized (select *, case when (length(id) + qty) % 3 = 0 then entry_px * 1.01e0 else entry_px end as prov from stt where status = 'open'),
           filled as materialized (select p.*, b.open as official from opn p join (select symbol, day, open from bars where day in (select entry_day from opn)) b on b.symbol = p.symbol and b.day = p.entry_day)""",
    ),
)
def reconciled_fills(spark, sf):
    return asof.reconciled(provisional_fills(spark, sf), bars(spark, sf))


def provisional_fills(spark, sf):
    """The open book as a live feed filled it: one price in three is off."""
    fills = book.view(state(spark, sf), "open")
    drift = F.when((F.length("id") + F.col("qty")) % 3 == 0, F.col("entry_px") * 1.01).otherwise(F.col("entry_px"))
    return fills.withColumn("entry_px", drift).withColumn("fill_source", F.lit("live:feed"))


FORWARD = """wnd as materialized (select *, (select max(queued_on) from stt) as today from stt where bucket = 'main'),
fw as materialized (select count(*) filter (where status in ('open', 'closed')) as entered, count(*) filter (where status = 'closed') as closed, count(*) filter (where status = 'pending' and date_diff('day', queued_on, today) > 5) as stale,
  date_diff('day', min(queued_on), max(today)) / 30.4375e0 as months from wnd)"""


@query(
    "forward_fills", "I30", "check_name:s value:f state:s",
    o.sql("trades", """select 'fills' as check_name, stale as value, case when stale > 0 then 'fail' else 'pass' end as state from fw
       union all select 'rate', entered, case when months < 6 then 'early' when entered between 2.86e0 * months - 1.96e0 * sqrt(greatest(2.86e0 * months, 1e0)) and 2.86e0 * months + 1.96e0 * sqrt(greatest(2.86e0 * months, 1e0)) then 'pass' else 'fail' end from fw""",
          EVENTS, FORWARD),
)
def forward_fills(spark, sf):
    """Orders of the main book that wait too long for a fill, and the rate of entered positions, on the book's last day."""
    from ..operators import evidence

    rows = state(spark, sf).filter("bucket = 'main'")
    today = state(spark, sf).agg(F.max("queued_on")).scalar()
    n = lambda *s: F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0))
    facts = rows.agg(n("open", "closed").alias("entered"), n("closed").alias("closed"), (F.datediff(today, F.min("queued_on")) / 30.4375).alias("months"))
    facts = facts.withColumn("stale", evidence.stale_pending(rows, today).select("stale").scalar())
    for c in ("mean_hold", "occ", "mean", "se"):
        facts = facts.withColumn(c, F.lit(None).cast("double"))
    return evidence.forward_checks(facts).filter(F.col("check_name").isin("fills", "rate"))
