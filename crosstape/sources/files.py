"""Readers for the exchange's daily files, announcements and filings.

Layout: ``<root>/<yyyy-mm-dd>/<file>``. Every reader is one distributed scan over
the whole tree; the day comes from the path.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File names and formats of the exchange feed.
BAR_FILE, ASM_FILE, GSM_FILE, BAN_FILE, MASTER_FILE = "bhavcopy_delivery.csv", "asm.json", "gsm.json", "fo_secban.csv", "equity_master.csv"
TIME_FORMATS = ("dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "dd-MMM-yyyy")
XBRL_FIELDS = {
    "RevenueFromOperations": "revenue",
    "ProfitLossForPeriod": "net_profit",
    "ProfitBeforeTax": "pbt",
    "Expenses": "expenses",
}
LACS = 100_000
TEXT_LIMIT = 400

ASM_TYPE = "map<string,struct<data:array<struct<symbol:string,asmSurvIndicator:string>>>>"
GSM_TYPE = "array<struct<symbol:string,gsmStage:string>>"


def day_of_path(path: Column) -> Column:
    return F.to_date(F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})/[^/]+$", 1))


def day_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(day, content) of one small file per day, read whole."""
    raw = spark.read.text(f"{root}/*/{name}", wholetext=True)
    return raw.select(day_of_path(F.col("_metadata.file_path")).alias("day"), F.col("value").alias("content"))


def read_bar_csv(spark: SparkSession, root: str) -> DataFrame:
    """Raw bar rows as text columns with trimmed names, plus ``day``."""
    raw = spark.read.csv(f"{root}/*/{BAR_FILE}", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cols = [F.col(f"`{c}`").alias(c.strip()) for c in raw.columns if c.strip()]
    return raw.select(*cols, day_of_path(F.col("_metadata.file_path")).alias("day"))


def clean_bars(raw: DataFrame, series: tuple[str, ...] = ("EQ",)) -> DataFrame:
    """Typed bars of the tradeable series. An unreadable price is NULL, an unreadable quantity 0."""
    text = lambda c: F.trim(F.col(c))
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    count = lambda c: F.coalesce(number(c), F.lit(0.0))
    pct = number("DELIV_PER")
    rows = raw.filter(text("SERIES").isin(*series) & (F.coalesce(text("SYMBOL"), F.lit("")) != ""))
    return rows.select(
        text("SYMBOL").alias("symbol"), "day", number("OPEN_PRICE").alias("open"), number("HIGH_PRICE").alias("high"),
        number("LOW_PRICE").alias("low"), number("CLOSE_PRICE").alias("close"), number("PREV_CLOSE").alias("prev_close"),
        count("TTL_TRD_QNTY").cast("long").alias("volume"), (count("TURNOVER_LACS") * LACS).alias("turnover"),
        count("DELIV_QTY").cast("long").alias("deliv_qty"), F.when(pct >= 0, pct).alias("deliv_pct"),
    )


def asm_rows(files: DataFrame) -> DataFrame:
    """(day, symbol, asm) from the nested list; the later horizon wins when a name is in several."""
    blocks = files.select("day", F.map_entries(F.from_json("content", ASM_TYPE)).alias("_b"))
    flat = blocks.select("day", F.posexplode("_b").alias("_pos", "_e")).select("day", "_pos", F.explode("_e.value.data").alias("_r"))
    rows = flat.filter(F.coalesce("_r.symbol", F.lit("")) != "").select(
        "day", F.col("_r.symbol").alias("symbol"), F.col("_pos").alias("pos"), F.coalesce(F.nullif(F.col("_r.asmSurvIndicator"), F.lit("")), F.lit("ASM")).alias("asm")
    )
    return rows.groupBy("day", "symbol").agg(F.max_by("asm", "pos").alias("asm"))


def gsm_rows(files: DataFrame) -> DataFrame:
    flat = files.select("day", F.explode(F.from_json("content", GSM_TYPE)).alias("_r")).filter(F.coalesce("_r.symbol", F.lit("")) != "")
    return flat.select("day", F.col("_r.symbol").alias("symbol"), F.coalesce(F.nullif(F.col("_r.gsmStage"), F.lit("")), F.lit("GSM")).alias("gsm")).distinct()


def ban_rows(files: DataFrame) -> DataFrame:
    """Second field of every line but the first."""
    lines = files.select("day", F.posexplode(F.split("content", r"\r?\n")).alias("_pos", "_line")).filter(F.col("_pos") > 0)
    sym = F.trim(F.get(F.split("_line", ","), F.lit(1)))
    return lines.select("day", sym.alias("symbol")).filter(F.coalesce("symbol", F.lit("")) != "").distinct()


def load_bars(spark: SparkSession, root: str, exclude_non_equity: bool = True) -> DataFrame:
    """The full daily-bar table: bars, denylist and surveillance, from the raw tree.

    Missing optional files mean unknown, not clean; the denylist is empty when no
    snapshot holds a company master.
    """
    from ..operators import universe

    bars = clean_bars(read_bar_csv(spark, root))
    if exclude_non_equity:
        deny = denylist(spark, root, bars)
        bars = bars if deny is None else universe.without(bars, deny)
    asm_files = _optional(spark, root, ASM_FILE)
    return universe.enriched(
        bars, asm_rows(asm_files), gsm_rows(_optional(spark, root, GSM_FILE)), ban_rows(_optional(spark, root, BAN_FILE)), asm_files.select("day").distinct()
    )


def _matches(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.read.text(pattern)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _optional(spark: SparkSession, root: str, name: str) -> DataFrame:
    if _matches(spark, f"{root}/*/{name}"):
        return day_files(spark, root, name)
    return spark.createDataFrame([], "day date, content string")


def denylist(spark: SparkSession, root: str, bars: DataFrame) -> DataFrame | None:
    """Symbols traded in the newest snapshot with a master but not in it; None without any master."""
    from ..operators import universe

    if not _matches(spark, f"{root}/*/{MASTER_FILE}"):
        return None
    raw = spark.read.csv(f"{root}/*/{MASTER_FILE}", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    master = raw.select(F.trim("SYMBOL").alias("symbol"), F.col("`NAME OF COMPANY`").alias("company"), day_of_path(F.col("_metadata.file_path")).alias("day"))
    newest = master.select("day").distinct().join(bars.select("day").distinct(), "day").agg(F.max("day")).scalar()
    return universe.traded_not_listed(bars.filter(F.col("day") == newest), master.filter(F.col("day") == newest))


def bar_file_dates(spark: SparkSession, root: str) -> DataFrame:
    """(folder, inside): the date in the first data row of each bar file against its folder."""
    lines = day_files(spark, root, BAR_FILE)
    second = F.get(F.split("content", r"\r?\n", 3), F.lit(1))
    inside = F.try_to_timestamp(F.trim(F.get(F.split(second, ","), F.lit(2))), F.lit("dd-MMM-yyyy")).cast("date")
    return lines.select(F.col("day").alias("folder"), inside.alias("inside"))


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes, sha256 and status of every feed file; content is hashed where it is read.

    A feed file is read as one value, so a file over 2 GB is refused by the reader.
    """
    return manifest_of(spark.read.format("binaryFile").load(pattern))


def manifest_of(contents: DataFrame) -> DataFrame:
    """The same of (path, content) rows."""
    size = F.octet_length("content").cast("long")
    return contents.select("path", size.alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(size > 0, "ok").otherwise("empty").alias("status"))


def market_time(text: Column) -> Column:
    """Timestamp in any of the feed's precisions, NULL when none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS])


def parse_announcements(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """symbol, visible_from, an_dt, category and text; rows that cannot be placed in time are dropped."""
    from ..operators import asof

    rows = raw.select(
        F.upper(F.trim("symbol")).alias("symbol"), market_time(F.col("an_dt")).alias("an_dt"),
        F.trim(F.coalesce("desc", F.lit(""))).alias("category"), F.left(F.trim(F.coalesce("attchmntText", F.lit(""))), F.lit(TEXT_LIMIT)).alias("text"),
    )
    rows = rows.filter(F.col("an_dt").isNotNull() & (F.coalesce("symbol", F.lit("")) != ""))
    return asof.with_visibility(rows, sessions)


ANNOUNCEMENT_JSON = "symbol string, an_dt string, desc string, attchmntText string"


def read_announcements(spark: SparkSession, path: str, sessions: DataFrame) -> DataFrame:
    return parse_announcements(spark.read.schema(ANNOUNCEMENT_JSON).json(path, multiLine=True), sessions)


def store_announcements(rows: DataFrame, path: str, since: str | None = None, upto: str | None = None) -> None:
    """Rewrite the months present in ``rows``: running it again never duplicates.

    A rebuild names its range (months ``since`` to ``upto``, such as "2024-03"). All its rows are written aside before
    anything is touched, so they may come from ``path`` itself; then its months are replaced, and those that hold no row
    any more are emptied. Where readers must never see a part of that, use ``months.MonthStore``.
    """
    spark = rows.sparkSession
    months = rows.withColumn("month", F.date_format("visible_from", "yyyy-MM"))
    kinds = months.schema
    if since and upto:
        months = months.filter(F.col("month").between(since, upto))
        aside = f"{path.rstrip('/')}-aside-{uuid.uuid4().hex[:12]}"
        months.write.parquet(aside)
        months = spark.read.schema(kinds).parquet(aside)
    months.repartition("month").sortWithinPartitions("symbol", "visible_from", "an_dt").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("month").parquet(path)
    if since and upto:
        there = spark.read.schema(kinds).parquet(path).select("month").filter(F.col("month").between(since, upto)).distinct()
        # At most the months of the range.
        for row in there.join(months.select("month").distinct(), "month", "left_anti").collect():
            spark.createDataFrame([], kinds).drop("month").write.mode("overwrite").parquet(f"{path}/month={row['month']}")


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Filing metadata, one row per filing; undated rows are dropped."""
    raw = spark.read.schema("symbol string, fromDate string, toDate string, broadCastDate string, consolidated string, xbrl string").json(path, multiLine=True)
    return filing_index(raw)


def filing_index(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        "symbol", market_time(F.col("fromDate")).cast("date").alias("from_date"), market_time(F.col("toDate")).cast("date").alias("quarter_end"),
        market_time(F.col("broadCastDate")).cast("date").alias("visible_from"),
        F.coalesce(F.lower(F.trim("consolidated")).startswith("consolidated"), F.lit(False)).alias("consolidated"), "xbrl",
    )
    return rows.filter(F.col("visible_from").isNotNull() & F.col("quarter_end").isNotNull())


_MEMBERS = "struct<explicitMember array<string>>"
#: What is read of a filing: contexts, and the facts by tag. An attribute has an underscore, a text is _VALUE.
XBRL_SCHEMA = (
    f"context array<struct<_id string, entity struct<segment {_MEMBERS}>, scenario {_MEMBERS}, period struct<startDate string, endDate string>>>, "
    + ", ".join(f"{tag} array<struct<_VALUE string, _contextRef string>>" for tag in XBRL_FIELDS)
)


def xbrl_facts(files: DataFrame) -> DataFrame:
    """(path, start_date, end_date, field, pos, value) of every period fact, from (path, content) rows.

    Contexts with a segment member or without a period are skipped, as are values that are no numbers and files that are
    no XML. pos counts the facts of one tag in a file. One filing is some tens of kilobytes; it is parsed where it stands.
    """
    filing = F.from_xml(F.decode("content", "UTF-8"), XBRL_SCHEMA, {"ignoreNamespace": "true"})
    def cells(tag: str, field: str) -> Column:
        return F.transform(F.coalesce(F.col(f"_x.{tag}"), F.array()), lambda v, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), v["_VALUE"].alias("text"), v["_contextRef"].alias("ref")))

    member = lambda c: F.coalesce(c["entity"]["segment"]["explicitMember"], c["scenario"]["explicitMember"])
    plain = F.filter("_x.context", lambda c: member(c).isNull() & c["period"]["startDate"].isNotNull() & c["period"]["endDate"].isNotNull())
    rows = files.select("path", filing.alias("_x")).select("path", plain.alias("_c"), F.explode(F.concat(*[cells(t, f) for t, f in XBRL_FIELDS.items()])).alias("_f"))
    of = F.get(F.reverse(F.filter("_c", lambda c: c["_id"] == F.col("_f.ref"))), F.lit(0))["period"]
    value = F.expr("try_cast(trim(_f.text) as double)")
    found = rows.select("path", F.trim(of["startDate"]).alias("start_date"), F.trim(of["endDate"]).alias("end_date"), "_f.field", "_f.pos", value.alias("value"))
    return found.filter(F.col("start_date").isNotNull() & F.col("value").isNotNull())


def quarter_figures(facts: DataFrame, index: DataFrame) -> DataFrame:
    """Figures of the quarter each filing reports: first value per period and field, own dates only.

    ``index`` carries path, symbol, from_date, quarter_end and visible_from.
    """
    w = Window.partitionBy("path", "start_date", "end_date", "field").orderBy("pos")
    first = facts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1)
    dated = first.select(
        "path", F.expr("try_cast(start_date as date)").alias("from_date"), F.expr("try_cast(end_date as date)").alias("quarter_end"), "field", "value"
    )
    own = index.join(dated, ["path", "from_date", "quarter_end"])
    return own.groupBy("symbol", "quarter_end", "visible_from").pivot("field", sorted(XBRL_FIELDS.values())).agg(F.first("value"))
