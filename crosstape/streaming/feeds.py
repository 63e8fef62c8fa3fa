"""Streaming news capture, late-news visibility and fill corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, text

NEWS = "source string, publisher string, title string, link string, published date, captured_at timestamp, symbol string, via string"


def news_stream(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(NEWS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def captured_once(items: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Stories only, each link once within the horizon; state is dropped as the watermark passes."""
    return text.stories(items).withWatermark("captured_at", horizon).dropDuplicatesWithinWatermark(["link"])


def laid_down(rows: DataFrame, path: str) -> DataFrame:
    """The rows written once and read back: ``write_in_order`` reads its rows two times per span and once for their days."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_in_order(rows: DataFrame, path: str, parts: int, day: str = "day", files: int = 1) -> int:
    """Lay rows down as ``parts`` equal spans of days, one after the other and ``files`` files each, as a feed would have
    brought them: a stream that takes ``files`` per trigger reads them in that order. Returns how many spans had rows."""
    d = F.col(day).cast("date")
    lo, hi = rows.agg(F.min(d), F.max(d)).first()
    if lo is None:
        return 0
    step = max(1, -(-((hi - lo).days + 1) // parts))
    written = 0
    for k in range(parts):
        since, until = F.date_add(F.lit(lo), k * step), F.date_add(F.lit(lo), (k + 1) * step)
        span = rows.filter((d >= since) & (d < until))
        if not span.isEmpty():
            span.repartition(files).write.mode("append").parquet(path)
            written += 1
    return written


def visible_stream(announcements: DataFrame, sessions: DataFrame) -> DataFrame:
    """The late-news rule as a join of the stream with a calendar that does not change."""
    return asof.with_visibility(announcements, sessions)


def visible_by_calendar(announcements: DataFrame, sessions_path: str, path: str, checkpoint: str) -> None:
    """The late-news rule against a calendar that grows while the stream runs.

    Each micro-batch reads the calendar as it is then. A row whose session is not on it yet waits, and is tried again
    with the next batch. Both parts are written under the batch number (``visible`` and ``waiting``), so a batch that is
    run again replaces what it wrote. Stops when what is there has been read.
    """
    spark = announcements.sparkSession
    cols = announcements.columns

    def step(batch: DataFrame, batch_id: int) -> None:
        sessions = spark.read.schema("day date").parquet(sessions_path)
        rows = batch
        if batch_id:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/waiting/batch={batch_id - 1}"))
        seen = asof.with_visibility(rows, sessions, keep_unknown=True)
        known = F.col("visible_from").isNotNull()
        seen.filter(known).select(*cols, "visible_from").write.mode("overwrite").parquet(f"{path}/visible/batch={batch_id}")
        seen.filter(~known).select(*cols).write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")

    run = announcements.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()


def burst_counts(visible: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sliding 30-day counts per symbol on the visibility day. A window is given out when the watermark has passed its
    end; a row that comes later than ``delay`` counts only in the windows that are still open."""
    ts = F.col("visible_from").cast("timestamp")
    counted = visible.withColumn("visible_ts", ts).withWatermark("visible_ts", delay).groupBy(F.window("visible_ts", "30 days", "1 day"), "symbol").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("date").alias("window_start"), "symbol", "n")


def correct_fills(official: DataFrame, fills: DataFrame, path: str, checkpoint: str):
    """Start a query that compares each batch of official bars with provisional fills.

    Corrections are written under their batch number and a replayed batch
    overwrites its own folder, so every correction is stored exactly once.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        done = asof.reconciled(fills, batch).filter(F.col("fill_source").isin("reconciled", "confirmed"))
        done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return official.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrected_state(fills: DataFrame, path: str, key: str = "id") -> DataFrame:
    """The fills as they stand: each with its latest correction, or as it was while the official file is out."""
    cols = [*fills.columns, "was"]
    fixed = fills.sparkSession.read.schema(fills.withColumn("was", F.lit(0.0)).withColumn("batch", F.lit(0)).schema).parquet(path)
    last = fixed.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key]), "batch").alias("_fix"))
    old = fills.withColumn("was", F.col("entry_px"))
    both = old.join(last, key, "left")
    pick = lambda c: F.when(F.col("_fix").isNotNull(), F.col(f"_fix.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(key, *[pick(c) for c in cols if c != key])
