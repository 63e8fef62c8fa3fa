"""Which symbols and days a study may use, and data-quality scans of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def traded_not_listed(traded: DataFrame, master: DataFrame) -> DataFrame:
    """Symbols that trade but are not companies: a denylist, so delisted companies stay."""
    return traded.select("symbol").distinct().join(master.select("symbol"), "symbol", "left_anti")


def without(bars: DataFrame, deny: DataFrame) -> DataFrame:
    """Spark broadcasts the denylist only when its measured size allows it."""
    return bars.join(deny.select("symbol"), "symbol", "left_anti")


def corpus(bars: DataFrame, deny: DataFrame | None, min_bars: int = 200, start=None, end=None) -> DataFrame:
    """Bars of symbols with enough history. Without a company master this refuses to run."""
    if deny is None:
        raise ValueError("no company master: an empty denylist would admit every listed fund")
    if start is not None:
        bars = bars.filter(F.col("day") >= F.lit(start))
    if end is not None:
        bars = bars.filter(F.col("day") <= F.lit(end))
    rows = without(bars, deny)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return rows.withColumn("n_bars", n).filter(F.col("n_bars") >= min_bars)


def enriched(bars: DataFrame, asm: DataFrame, gsm: DataFrame, ban: DataFrame, asm_days: DataFrame) -> DataFrame:
    """Attach surveillance labels; a day without an ASM file is unknown, not clean."""
    out = (
        bars.join(asm.select("symbol", "day", "asm"), ["symbol", "day"], "left")
        .join(gsm.select("symbol", "day", "gsm"), ["symbol", "day"], "left")
        .join(ban.select("symbol", "day", F.lit(True).alias("_b")), ["symbol", "day"], "left")
        .join(asm_days.select("day", F.lit(True).alias("_k")), "day", "left")
    )
    return (
        out.withColumn("fo_ban", F.coalesce("_b", F.lit(False)))
        .withColumn("surveillance_known", F.coalesce("_k", F.lit(False)))
        .withColumn("restricted", F.col("asm").isNotNull() | F.col("gsm").isNotNull() | F.col("fo_ban"))
        .drop("_b", "_k")
    )


def weekday_gaps(days: DataFrame, holidays: DataFrame, collected: DataFrame | None = None) -> DataFrame:
    """Weekdays in the span with no bars (kind 'bars'), or bars but no surveillance file.

    A missing surveillance file counts only from the first day one was collected.
    """
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    # An empty feed has no span; sequence over NULL explodes to nothing.
    cal = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))
    cal = cal.filter(F.weekday("day") < 5).join(holidays.select("day"), "day", "left_anti")
    missing = cal.join(days.select("day"), "day", "left_anti").withColumn("kind", F.lit("bars"))
    if collected is None:
        return missing
    since = collected.agg(F.min("day")).scalar()
    have = cal.join(days.select("day"), "day", "left_semi")
    late = have.join(collected.select("day"), "day", "left_anti").filter(F.col("day") >= since)
    return missing.unionByName(late.withColumn("kind", F.lit("surveillance")))


def stale_files(files: DataFrame) -> DataFrame:
    """Files whose content date differs from their folder date (the holiday re-serve trap)."""
    return files.filter(F.col("inside").isNotNull() & (F.col("inside") != F.col("folder")))
