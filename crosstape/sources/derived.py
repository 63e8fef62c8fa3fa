"""Bars, filings, announcements and headlines derived from the star-schema tables.

The statements are plain ANSI SQL: Spark runs them here, and the checks run the
same text elsewhere. Rounding is ``floor(x + 0.5)`` on doubles because engines
break ``round`` ties differently.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ledger

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# One row per supplier and ship date: a deterministic random walk.
BARS_DAYS = """
  select concat('S', lpad(cast(l_suppkey as varchar(20)), 6, '0')) as symbol, cast(l_shipdate as date) as day,
         sum(cast(floor(100*l_discount + 0.5e0) as int) - 5) as step, max(cast(floor(100*l_tax + 0.5e0) as int)) as tx,
         max(cast(floor(100*l_discount + 0.5e0) as int)) as dc, sum(cast(floor(100*l_tax + 0.5e0) as int) - 4) as ot,
         cast(sum(l_quantity) as bigint) as volume, floor(sum(l_extendedprice)*100 + 0.5e0)/100 as turnover,
         case when min(l_returnflag) = 'R' then null else 20 + avg(l_quantity) end as deliv_pct
  from lineitem group by 1, 2"""
# The least flag is R: no flag comes before R, and some flag is R. As a number it is kept in a hash table; the least
# text would have every line sorted before it is combined.
HASHED_FLAG = ("min(l_returnflag) = 'R'", "max(case when l_returnflag < 'R' then 2 when l_returnflag = 'R' then 1 else 0 end) = 1")
BARS_WALK = """p as (select *, floor(10000*exp(0.01e0*sum(step) over (partition by symbol order by day)) + 0.5e0)/100 as c from g),
q as (select *, (tx = 8 and dc = 10) as locked,
             floor(100*coalesce(lag(c) over (partition by symbol order by day), 100e0)*(1 + 0.002e0*ot) + 0.5e0)/100 as o from p)
"""
BARS_CTES = f"\ng as ({BARS_DAYS}),\n{BARS_WALK}"
BARS_SELECT = """
select symbol, day, case when locked then c else o end as open,
       case when locked then c else floor(100*greatest(o, c)*(1 + 0.002e0*tx) + 0.5e0)/100 end as high,
       case when locked then c else floor(100*least(o, c)*(1 - 0.002e0*dc) + 0.5e0)/100 end as low,
       c as close, volume, turnover, deliv_pct,
       case when volume > 80 then 'Stage I' end as asm, cast(null as varchar(8)) as gsm, false as fo_ban,
       day >= date '1998-01-01' as surveillance_known,
       cast(row_number() over (partition by symbol order by day) - 1 as int) as ix
from q
"""

# The session calendar and registered users wrap around the supplier list.
ANNOUNCE_SELECT = """
select concat('S', lpad(cast(user_id % (select count(*) from supplier) as varchar(20)), 6, '0')) as symbol,
       ts - interval '24' year as an_dt, event_type as category, props as text, event_id
from events
"""

FILINGS_CTE = """
fq as (
  select o_custkey % (select count(*) from supplier) as k, year(o_orderdate) as y, quarter(o_orderdate) as qn,
         floor(sum(o_totalprice)*100 + 0.5e0)/100 as revenue,
         floor(sum(case when o_orderstatus = 'F' then o_totalprice else -0.5e0*o_totalprice end)*100 + 0.5e0)/100 as net_profit
  from orders group by 1, 2, 3)
"""
FILINGS_SELECT = """
select concat('S', lpad(cast(k as varchar(20)), 6, '0')) as symbol,
       cast(last_day(make_date(cast(y as int), cast(qn*3 as int), 1)) as date) as quarter_end,
       cast(last_day(make_date(cast(y as int), cast(qn*3 as int), 1)) as date) + cast(20 + (k*7 + qn*11) % 50 as int) as visible_from,
       revenue, net_profit
from fq
"""

# Every 17th supplier stands for a listed instrument that is not a company.
DENY_EVERY = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...]) -> DataFrame:
    """Run a statement whose ``{name}`` markers are bound to file scans, leaving no view behind."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def bars_query(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Bars straight from lineitem, lazily.

    Raw rows shrink to one per (symbol, day) with map-side partial aggregation
    before anything is partitioned by symbol, so a supplier holding a third of
    all lines still yields at most one row per session. With ``parts`` these rows
    are laid in that many partitions by symbol, which the windows then share.
    """
    days = _run(spark, sf_dir, BARS_DAYS.replace(*HASHED_FLAG).replace("from lineitem", "from {lineitem}"), ("lineitem",))
    if parts:
        days = days.repartition(parts, "symbol")
    return spark.sql(f"with {BARS_WALK} {BARS_SELECT}".replace("from g)", "from {g})"), g=days)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested bars table, bucketed and sorted by symbol.

    Ingest happens once per application into the shared folder; after that the
    per-symbol windows read it without a shuffle.
    """
    return ledger.bucketed(spark, sf_dir, "bars", lambda s, d: bars_query(s, d, ledger.buckets(s, d)), laid=True)


def sessions(bars_: DataFrame) -> DataFrame:
    """Trading calendar: distinct days numbered from 0. Its size is the calendar's, not the data's."""
    w = Window.orderBy("day")
    return bars_.select("day").distinct().withColumn("session_ix", F.row_number().over(w) - 1)


def symbol_key(key) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 6, "0"))


def company_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.filter(F.col("s_suppkey") % DENY_EVERY != 0).select(
        symbol_key(F.col("s_suppkey")).alias("symbol"), F.col("s_name").alias("company")
    )


def announcements_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = ANNOUNCE_SELECT.replace("from supplier", "from {supplier}").replace("from events", "from {events}")
    return _run(spark, sf_dir, sql, ("supplier", "events"))


# FILINGS_CTE with its sums taken in the order of the order keys. Half prices put a sum on the half cent that
# floor() decides, so sums of another order would give another cent with every number of partitions. A running sum
# holds one row at a time, whatever a company's quarter holds.
FILINGS_IN_ORDER = """
fo as (
  select o_custkey % (select count(*) from supplier) as k, year(o_orderdate) as y, quarter(o_orderdate) as qn, o_totalprice as paid,
         case when o_orderstatus = 'F' then o_totalprice else -0.5e0*o_totalprice end as kept, o_orderkey as nr, o_orderstatus as st
  from orders),
fr as (
  select k, y, qn, row_number() over w as n, sum(paid) over w as paid, sum(kept) over w as kept from fo
  window w as (partition by k, y, qn order by nr, paid, st rows between unbounded preceding and current row)),
fq as (
  select k, y, qn, floor(max_by(paid, n)*100 + 0.5e0)/100 as revenue, floor(max_by(kept, n)*100 + 0.5e0)/100 as net_profit
  from fr group by k, y, qn)
"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = f"with {FILINGS_IN_ORDER} {FILINGS_SELECT}".replace("from supplier", "from {supplier}").replace("from orders", "from {orders}")
    return _run(spark, sf_dir, sql, ("supplier", "orders"))
