"""File parsers and streaming jobs run over text and rows that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import derived, files, ledger
from ..streaming import positions
from . import oracle as o
from . import text_plans
from .common import bars, sessions, table, trades
from .spec import query


@query(
    "parsed_bar_rows", "A1", "symbol:s day:d open:f high:f low:f close:f volume:i turnover:f deliv_pct:f",
    o.sql("bars", "select symbol, day, open, high, low, close, volume, coalesce(turnover, 0e0) as turnover, deliv_pct from bars where ix % 10 <> 3"),
)
def parsed_bar_rows(spark, sf):
    # Each bar as the text columns of a feed row: padded names, a dash for missing delivery, one bar in ten of another series.
    b = bars(spark, sf)
    pad = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" "))
    raw = b.select(
        pad("symbol").alias("SYMBOL"), F.when(F.col("ix") % 10 == 3, " BE").otherwise(" EQ").alias("SERIES"), "day", pad("open").alias("OPEN_PRICE"),
        pad("high").alias("HIGH_PRICE"), pad("low").alias("LOW_PRICE"), pad("close").alias("CLOSE_PRICE"), F.lit("x").alias("PREV_CLOSE"),
        pad("volume").alias("TTL_TRD_QNTY"), (F.col("turnover") / files.LACS).cast("string").alias("TURNOVER_LACS"), F.lit("-").alias("DELIV_QTY"),
        F.coalesce(F.col("deliv_pct").cast("string"), F.lit(" -")).alias("DELIV_PER"),
    )
    return files.clean_bars(raw)


@query(
    "parsed_surveillance", "A2 A3 A4 A6", "day:d symbol:s asm:s gsm:s banned:b",
    o.sql(
        "bars",
        """select day, symbol, case when volume > 80 then case when ix % 2 = 0 then 'Stage I' else 'ASM' end end as asm, case when turnover > 200000 then 'GSM' end as gsm, coalesce(deliv_pct > 68, false) as banned
           from bars where volume > 80 or turnover > 200000 or deliv_pct > 68""",
    ),
)
def parsed_surveillance(spark, sf):
    # One small list file per flagged bar, in the nested shapes of the feed.
    b = bars(spark, sf)
    entry = F.concat(F.lit('{"symbol":"'), F.col("symbol"), F.lit('","asmSurvIndicator":"'), F.when(F.col("ix") % 2 == 0, "Stage I").otherwise(""), F.lit('"}'))
    asm = b.filter("volume > 80").select("day", F.concat(F.lit('{"shortterm":{"data":[]},"longterm":{"data":['), entry, F.lit("]}}")).alias("content"))
    gsm = b.filter("turnover > 200000").select("day", F.concat(F.lit('[{"symbol":"'), F.col("symbol"), F.lit('","gsmStage":null}]')).alias("content"))
    ban = b.filter("deliv_pct > 68").select("day", F.concat(F.lit("Securities in ban\n1,"), F.col("symbol"), F.lit("\n")).alias("content"))
    keys = ["day", "symbol"]
    out = files.asm_rows(asm).join(files.gsm_rows(gsm), keys, "full").join(files.ban_rows(ban).withColumn("banned", F.lit(True)), keys, "full")
    return out.withColumn("banned", F.coalesce("banned", F.lit(False)))


@query("file_manifest", "A11", "path:s bytes:i sha256:s status:s",
       "select concat('doc/', doc_id, '.txt') as path, strlen(coalesce(text, '')) as bytes, sha256(coalesce(text, '')) as sha256, case when strlen(coalesce(text, '')) > 0 then 'ok' else 'empty' end as status from documents")
def file_manifest(spark, sf):
    # Every document stands for a feed file.
    d = table(spark, sf, "documents")
    return files.manifest_of(d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


@query(
    "parsed_announcements", "A12 H1", "symbol:s an_dt:t visible_from:d category:s text:s",
    o.sql(
        "annv",
        """select symbol, case when event_id % 3 = 0 then date_trunc('minute', an_dt) else date_trunc('second', an_dt) end as an_dt, visible_from, category, left(repeat(text || ' ', 40), 400) as text
           from (select event_id, symbol, an_dt, category, trim(text) as text, visible_from from annv) where event_id % 10 <> 9""",
    ).replace("left(repeat(text || ' ', 40), 400)", "left(trim(repeat(text || ' ', 40)), 400)"),
)
def parsed_announcements(spark, sf):
    a = derived.announcements_raw(spark, sf)
    stamp = F.when(F.col("event_id") % 10 == 9, "soon").when(F.col("event_id") % 3 == 0, F.date_format("an_dt", "dd-MMM-yyyy HH:mm")).otherwise(F.date_format("an_dt", "dd-MMM-yyyy HH:mm:ss"))
    raw = a.select(
        F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), stamp.alias("an_dt"), F.col("category").alias("desc"),
        F.expr("repeat(concat(text, ' '), 40)").alias("attchmntText"),
    )
    return files.parse_announcements(raw, sessions(spark, sf).filter(F.weekday("day") < 5))


XBRL = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:f="urn:facts">
<context id="YTD"><period><startDate>1990-01-01</startDate><endDate>%s</endDate></period></context>
<context id="SEG"><entity><segment><d:explicitMember>x</d:explicitMember></segment></entity><period><startDate>%s</startDate><endDate>%s</endDate></period></context>
<context id="Q"><period><startDate>%s</startDate><endDate>%s</endDate></period></context>
<context id="I"><period><instant>%s</instant></period></context>
<f:RevenueFromOperations contextRef="SEG">7</f:RevenueFromOperations><f:RevenueFromOperations contextRef="YTD">300</f:RevenueFromOperations>
<f:RevenueFromOperations contextRef="Q">%s</f:RevenueFromOperations><f:RevenueFromOperations contextRef="Q">1</f:RevenueFromOperations>
<f:ProfitLossForPeriod contextRef="Q">%s</f:ProfitLossForPeriod><f:Expenses contextRef="I">5</f:Expenses></xbrl>"""


@query("xbrl_figures", "A15", "symbol:s quarter_end:d visible_from:d revenue:f net_profit:f expenses:f", o.sql("fil", "select *, null::double as expenses from fil"))
def xbrl_figures(spark, sf):
    f = derived.filings(spark, sf).withColumn("from_date", F.date_add(F.last_day(F.add_months("quarter_end", -3)), 1))
    f = f.withColumn("path", F.concat_ws("/", "symbol", F.col("quarter_end").cast("string")))
    end, start = F.col("quarter_end").cast("string"), F.col("from_date").cast("string")
    doc = F.format_string(XBRL.replace("\n", ""), end, start, end, start, end, end, F.col("revenue").cast("string"), F.col("net_profit").cast("string"))
    facts = files.xbrl_facts(f.select("path", F.encode(doc, "UTF-8").alias("content")))
    return files.quarter_figures(facts, f.select("path", "symbol", "from_date", "quarter_end", "visible_from"))


PAPER = (
    "tsig as materialized (select * exclude (entry_px, entry_day, stop_px, target_px, exit_ix, exit_day, why, exit_px, ret, hit_ix, last_ix) from trades)",
    o.label_cte("pl", "tsig", first=2, late=1, close_short=False),
    # A name can be queued again from the day its position closes; a position that never closes blocks the rest.
    """nx as materialized (select t.symbol, t.ix, p.exit_ix, (select min(n.ix) from tsig n where n.symbol = t.symbol and n.ix >= p.exit_ix and n.ix > t.ix) as next_ix
       from tsig t left join pl p using (symbol, ix)),
    wk as (select symbol, min(ix) as ix from tsig group by 1 union all select n.symbol, n.next_ix from wk join nx n using (symbol, ix) where n.next_ix is not null)""",
)


@query(
    "position_stream", "L1 L2", "symbol:s queued_on:d entry_day:d entry_px:f exit_day:d exit_px:f exit_reason:s",
    o.sql("trades bars", "select p.symbol, p.day as queued_on, p.entry_day, p.entry_px, p.exit_day, p.exit_px, p.why as exit_reason from wk join pl p using (symbol, ix)", *PAPER).replace("wk as (select", "wk as (select"),
)
def position_stream(spark, sf):
    """Run the streaming position job over every order and bar, a stretch of sessions per micro-batch, then read its closed events."""
    import uuid

    from ..streaming import feeds

    base = f"{shared_dir(spark)}/crosstape/positions-{uuid.uuid4().hex[:12]}"
    b = bars(spark, sf).select(F.lit("main").alias("bucket"), "symbol", "day", F.lit("bar").alias("kind"), F.lit(None).cast("long").alias("qty"), "open", "high", "low", "close")
    none = [F.lit(None).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    orders = trades(spark, sf).select(F.lit("main").alias("bucket"), "symbol", "day", F.lit("order").alias("kind"), F.col("qty").cast("long").alias("qty"), *none)
    # State partitions, and files of a micro-batch: one for four buckets, as every one of them starts a worker in each batch.
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ledger.buckets(spark, sf) // 4))
    feeds.write_in_order(b.unionByName(orders), f"{base}/feed", 5, files=files)
    feed = spark.readStream.schema(positions.INPUT).option("maxFilesPerTrigger", files).parquet(f"{base}/feed")
    positions.run_available(positions.position_events(feed), f"{base}/events", f"{base}/checkpoint", partitions=files)
    closed = spark.read.schema(positions.EVENTS).parquet(f"{base}/events").filter("status = 'closed'")
    return closed.withColumnRenamed("at", "exit_day")


@query(
    "captured_news", "L3 B6", "link:s",
    "select distinct link from (" + text_plans.STORY_SQL + ")",
)
def captured_news(spark, sf):
    """Run the news capture stream over pages seen three times each; every story link is kept once."""
    import uuid

    from ..streaming import feeds

    base = f"{shared_dir(spark)}/crosstape/news-{uuid.uuid4().hex[:12]}"
    p = table(spark, sf, "pages").withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    seen = F.timestamp_seconds(F.unix_timestamp(F.lit("2000-01-03 09:00:00").cast("timestamp")) + F.col("_n") * 3600)
    p.select(
        F.lit("feed").alias("source"), F.lit("").alias("publisher"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.col("url").alias("link"),
        F.lit(None).cast("date").alias("published"), seen.alias("captured_at"), F.lit(None).cast("string").alias("symbol"), F.lit("direct").alias("via"),
    ).write.json(f"{base}/feed")
    positions.run_available(feeds.captured_once(feeds.news_stream(spark, f"{base}/feed", 1000)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(feeds.NEWS).parquet(f"{base}/out").select("link")
