"""Universe rules and data-quality scans over the derived feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import universe
from ..sources import derived
from . import oracle as o
from .common import bars, corpus, denylist, sessions, table
from .spec import query

# A session is taken as a holiday when its day of the month is in this list; so
# the gap scan has something to exclude on made-up calendars.
HOLIDAY_DAYS = (1, 26)


@query(
    "daily_bars", "A1", "symbol:s day:d open:f high:f low:f close:f volume:i turnover:f deliv_pct:f ix:i",
    o.sql("bars", "select * from bars"),
)
def daily_bars(spark, sf):
    return derived.bars_query(spark, sf)


@query(
    "denylist", "A5 K2", "symbol:s",
    o.sql("", """select concat('S', lpad(cast(s_suppkey as varchar), 6, '0')) as symbol from supplier
               except select concat('S', lpad(cast(s_suppkey as varchar), 6, '0')) from supplier where s_suppkey % 17 <> 0"""),
)
def denylist_query(spark, sf):
    return denylist(spark, sf)


@query(
    "surveillance_enriched", "A6 B2", "symbol:s day:d asm:s gsm:s fo_ban:b surveillance_known:b restricted:b",
    o.sql(
        "bars",
        """select b.symbol, b.day, a.asm, g.gsm, n.symbol is not null as fo_ban, k.day is not null as surveillance_known,
           a.asm is not null or g.gsm is not null or n.symbol is not null as restricted
           from bars b left join a on a.symbol = b.symbol and a.day = b.day left join gl g on g.symbol = b.symbol and g.day = b.day
           left join n on n.symbol = b.symbol and n.day = b.day left join (select distinct day from a) k on k.day = b.day""",
        "a as (select symbol, day, 'Stage I' as asm from bars where volume > 80 and day >= date '1998-01-01')",
        "gl as (select symbol, day, 'GSM' as gsm from bars where turnover > 200000 and day >= date '1998-01-01')",
        "n as (select symbol, day from bars where deliv_pct > 68 and day >= date '1998-01-01')",
    ),
)
def surveillance_enriched(spark, sf):
    b = bars(spark, sf)
    known = b.filter(F.col("day") >= F.lit("1998-01-01").cast("date"))
    asm = known.filter("volume > 80").select("symbol", "day", F.lit("Stage I").alias("asm"))
    gsm = known.filter("turnover > 200000").select("symbol", "day", F.lit("GSM").alias("gsm"))
    ban = known.filter("deliv_pct > 68").select("symbol", "day")
    plain = b.drop("asm", "gsm", "fo_ban", "surveillance_known")
    return universe.enriched(plain, asm, gsm, ban, asm.select("day").distinct())


@query(
    "corpus_bars", "A7", "symbol:s bars:i first_day:d last_day:d",
    o.sql("corpus", "select symbol, count(*) as bars, min(day) as first_day, max(day) as last_day from corpus group by symbol"),
)
def corpus_bars(spark, sf):
    rows = universe.corpus(bars(spark, sf), denylist(spark, sf))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    "session_calendar", "A8", "day:d session_ix:i prev_session:d next_session:d",
    o.sql("sess", "select day, session_ix, lag(day) over (order by day) as prev_session, lead(day) over (order by day) as next_session from sess"),
)
def session_calendar(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy("session_ix")  # the calendar: one row per session
    return sessions(spark, sf).withColumn("prev_session", F.lag("day").over(w)).withColumn("next_session", F.lead("day").over(w))


@query(
    "weekday_gaps", "A9", "day:d kind:s",
    o.sql(
        "sess",
        """select day, 'bars' as kind from cal where day not in (select day from sess)
           union all select day, 'surveillance' from cal where day in (select day from sess)
             and day not in (select day from coll) and day >= (select min(day) from coll)""",
        f"""cal as materialized (select cast(d as date) as day from (select unnest(generate_series(
              (select min(day) from sess)::timestamp, (select max(day) from sess)::timestamp, interval 1 day)) as d)
              where dayofweek(d) between 1 and 5 and day(d) not in {HOLIDAY_DAYS})""",
        "coll as materialized (select distinct day from bars where surveillance_known and volume > 80)",
    ),
)
def weekday_gaps(spark, sf):
    days = sessions(spark, sf).select("day")
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    holidays = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day")).filter(F.dayofmonth("day").isin(*HOLIDAY_DAYS))
    collected = bars(spark, sf).filter("surveillance_known and volume > 80").select("day").distinct()
    return universe.weekday_gaps(days, holidays, collected)


@query(
    "stale_files", "A10", "folder:d inside:d rows:i",
    o.sql(
        "",
        """select folder, inside, rows from (select cast(o_orderdate as date) as folder, cast(max(l_shipdate) as date) as inside, count(*) as rows
             from lineitem join orders on l_orderkey = o_orderkey group by 1) where inside <> folder""",
    ),
)
def stale_files(spark, sf):
    li, od = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    files = (
        li.join(od, li.l_orderkey == od.o_orderkey).groupBy(F.to_date("o_orderdate").alias("folder"))
        .agg(F.to_date(F.max("l_shipdate")).alias("inside"), F.count(F.lit(1)).alias("rows"))
    )
    return universe.stale_files(files)
