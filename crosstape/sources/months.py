"""A table by month whose ranges can be rebuilt: written first, visible at once, never half."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, since date, upto date"


class MonthStore:
    """Rows under <path>/rows/version=N/month=yyyy-MM-dd and a log of what each version replaced.

    A rebuild writes its months as a new version, computes every row before anything changes, and then adds one row to
    the log: only that makes it visible, and older rows of all months in its range are then out of sight, also
    of months that have become empty. A job that dies before the log row leaves the table as it was; its
    version is never read and the next rebuild takes a later number. The rows may come from the table itself.
    One writer at a time. Superseded versions stay on disk until ``compact``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _log(self) -> DataFrame:
        return self._read("log", LOG)

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def stage(self, rows: DataFrame, since: str, upto: str, date_col: str = "visible_from") -> int:
        """Write the months since..upto ("2024-03") of rows as a version that nobody sees yet; its number."""
        version = 1 + max(self._log().agg(F.max("version")).first()[0] or 0, self._read("rows", "version long").agg(F.max("version")).first()[0] or 0)
        month = F.trunc(date_col, "month")
        first, last = (F.lit(f"{m}-01").cast("date") for m in (since, upto))
        cut = rows.withColumn("month", month).filter(F.col("month").between(first, last)).withColumn("version", F.lit(version))
        cut.repartition("month").write.mode("append").partitionBy("version", "month").parquet(f"{self.path}/rows")
        return version

    def publish(self, version: int, since: str, upto: str) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(f"{since}-01").cast("date").alias("since"), F.lit(f"{upto}-01").cast("date").alias("upto"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def rebuild(self, rows: DataFrame, since: str, upto: str, date_col: str = "visible_from") -> None:
        self.publish(self.stage(rows, since, upto, date_col), since, upto)

    def rows(self) -> DataFrame:
        """What stands: of each month the newest version that was published for it. The log has a row per rebuild."""
        months = self._log().select("version", F.explode(F.expr("sequence(since, upto, interval 1 month)")).alias("month"))
        current = months.groupBy("month").agg(F.max("version").alias("version"))
        return self._read("rows", f"{self.schema}, version long, month date").join(current, ["version", "month"], "left_semi").drop("version")

    def compact(self, path: str) -> MonthStore:
        """A new store with what stands, as one version."""
        out = MonthStore(self.spark, path, self.schema)
        span = self._log().agg(F.date_format(F.min("since"), "yyyy-MM"), F.date_format(F.max("upto"), "yyyy-MM")).first()
        if span[0]:
            version = 1
            self.rows().withColumn("version", F.lit(version)).repartition("month").write.partitionBy("version", "month").parquet(f"{out.path}/rows")
            out.publish(version, *span)
        return out
