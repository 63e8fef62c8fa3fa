"""Exact dedup against a persistent digest index, in DataFrame and SQL functions only.

The index is a table bucketed and sorted by the SHA-256 of a text: digest, keep_id, keep_row, batch, one row
per distinct text ever seen. A batch of documents is reduced to one row per digest first, whose row
with the largest doc_id would stay (no id: only if no row has one; of rows with equal ids the first one read);
a sort-merge anti-join with the index leaves the new digests, and these are appended. A text that an
earlier batch stored stays with that batch's row. Batches given in descending order of doc_id so leave the largest id
of all; one batch does so too.

Every row of every batch is also logged (its id, row number and digest, never its text), and so are the batch's
groups; report() tells the keeper and the copies of any row. A batch that is given again changes nothing: its log is written anew and
its digests are found in the index. Only one writer may add to an index at a time.

Null text counts as empty; texts are compared without any change, by their UTF-8 bytes' digest. Repeated rows of one
doc_id are copies of each other, of which one is kept. Extra columns are ignored. An empty table adds nothing.

Texts never leave the scan: 40 bytes a row are shuffled. Digests are reduced before they meet, so a group of copies
is one row for each task. Where rows look up their group, digests that hold over a HOT-th of all rows
(so at most HOT of them) are broadcast; all others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests with more than a HOT-th of all rows are looked up without a shuffle; there are at most HOT of them.
HOT = 1000
#: Digests a bucket should hold (about 60 bytes each), and the most buckets.
PER_BUCKET, MOST_BUCKETS = 5_000_000, 20_000
_COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"
_LOGS = {"rows": "doc_id BIGINT, row BIGINT, digest BINARY, batch STRING", "groups": "digest BINARY, n BIGINT, keep_id BIGINT, keep_row BIGINT, batch STRING"}


def _none_if_missing(e: AnalysisException, spark: SparkSession, schema: str) -> DataFrame:
    """No rows where a path does not exist yet; any other failure stays one."""
    if e.getCondition() != "PATH_NOT_FOUND":
        raise e
    return spark.createDataFrame([], schema)


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """The index at a path. expect: about how many distinct texts it will hold; sets the buckets of a new one."""

    def __init__(self, spark: SparkSession, path: str, expect: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = "digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        try:
            known = spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()
        except AnalysisException as e:
            known = _none_if_missing(e, spark, "buckets int").first()
        if known:
            buckets = known[0]
        else:
            floor = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
            buckets = max(floor, min(MOST_BUCKETS, -(-expect // PER_BUCKET)))
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/layout")
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/index'"
        )

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def seen(self, kind: str) -> DataFrame:
        """rows: doc_id, row, digest, batch of every row seen. groups: digest, n, keep_id, keep_row, batch."""
        try:
            return self.spark.read.schema(_LOGS[kind]).parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            return _none_if_missing(e, self.spark, _LOGS[kind])

    def _log(self, rows: DataFrame, kind: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Log a batch, append its new digests and return them (digest, keep_id, keep_row)."""
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(docs[text_col].cast("string")).alias("digest"))
        self._log(rows, "rows", batch)
        # The largest id, nulls least; of equal ids the first row.
        best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", (-F.col("row")).alias("back")))
        groups = self.seen("rows").filter(F.col("batch") == batch).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
        # Written first: else Catalyst moves the anti-join below the reduction, and copies meet the index one by one.
        self._log(groups.select("digest", "n", F.col("b.doc_id").alias("keep_id"), (-F.col("b.back")).alias("keep_row")), "groups", batch)
        groups = self.seen("groups").filter(F.col("batch") == batch).select("digest", "keep_id", "keep_row", "batch")
        fresh = groups.join(self.stored().select("digest").hint("merge"), "digest", "left_anti")
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/index").saveAsTable(self.table)
        return self.stored().filter(F.col("batch") == batch).drop("batch")

    def report(self) -> DataFrame:
        """One row per logged row: doc_id, batch, keep_id, group_size, kept, text_sha256."""
        rows, seen = self.seen("rows"), self.seen("groups")
        total = rows.count()
        sizes = seen.groupBy("digest").agg(F.sum("n").alias("group_size"))
        groups = sizes.join(self.stored().withColumnRenamed("batch", "keep_batch").hint("merge"), "digest")
        hot = groups.filter(F.col("group_size") * HOT > total)
        of_hot = rows.join(F.broadcast(hot), "digest")
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.filter(F.col("group_size") * HOT <= total), "digest")
        kept = (F.col("batch") == F.col("keep_batch")) & (F.col("row") == F.col("keep_row"))
        return of_hot.unionByName(rest).select("doc_id", "batch", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def drop_copies(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; its rows whose text no earlier batch stored, one of each group of copies, all columns."""
        fresh = self.add(docs, batch, id_col, text_col).select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"))
        named = docs.select(F.struct("*").alias("_row"), docs[id_col].cast("long").alias("_id"), digest(docs[text_col].cast("string")).alias("_digest"))
        held = named.join(fresh, "_digest").filter(F.col("_id").eqNullSafe(F.col("_keep")))
        return held.dropDuplicates(["_digest"]).select("_row.*")


def deduplicate(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index a table in two batches, the upper half of its ids first, so that the second one meets what the first has
    stored; one row per row: doc_id, keep_id (the largest id of the group), group_size, kept, text_sha256."""
    key = docs[id_col].cast("long")
    low, high, n = docs.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    index = DigestIndex(docs.sparkSession, path, expect=n)
    middle = 0 if low is None else (low + high) // 2
    upper = F.coalesce(key > middle, F.lit(False))
    index.add(docs.filter(upper), "upper", id_col, text_col)
    index.add(docs.filter(~upper), "lower", id_col, text_col)
    return index.report().select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
from d window same as (partition by t)"""
