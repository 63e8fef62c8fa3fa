"""Append-only result ledgers and tables written once per application."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

_BUCKETED: dict[tuple[str, str, str], str] = {}
_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_BYTES: dict[tuple[str, str, str], int] = {}
# Spark refuses over 100,000 buckets by default; far fewer hold any table here.
MOST_BUCKETS = 20_000
# Input behind one bucket: about half a million bars, a task of seconds in the heaviest per-symbol step.
BUCKET_BYTES = 8 << 20
# Input behind one file split while a table is written: what a task combines before the first exchange.
SPLIT_BYTES = 32 << 20


def _write_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        tag = hashlib.sha256("|".join(key).encode()).hexdigest()[:12]
        path = f"{shared_dir(spark)}/crosstape/{name}-{tag}"
        df = build(spark, sf_dir)
        with sized(spark, sf_dir):
            df.write.mode("overwrite").parquet(path)
        _WRITTEN[key] = (path, df.schema)
    return _WRITTEN[key]


def _source_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the largest input table, from the file listing alone."""
    key = (spark.sparkContext.applicationId, sf_dir, "lineitem")
    if key not in _BYTES:
        listed = spark.read.format("binaryFile").load(f"{sf_dir}/lineitem.parquet")
        _BYTES[key] = int(listed.agg(F.sum("length")).first()[0] or 0)
    return _BYTES[key]


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the per-symbol tables: one for each BUCKET_BYTES of input, so that a task's work stays the same."""
    floor_parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    return min(MOST_BUCKETS, max(floor_parts, -(-_source_bytes(spark, sf_dir) // BUCKET_BYTES)))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of an exchange of bars by another key: two for each bucket, whatever the session's own number."""
    return 2 * buckets(spark, sf_dir)


def _as_bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


@contextmanager
def sized(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """While a table is written its exchanges and file splits follow the input, so that no task's memory grows with it."""
    shuffle, split = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    usual = {k: spark.conf.get(k) for k in (shuffle, split)}
    wanted = {shuffle: max(int(usual[shuffle]), parts(spark, sf_dir)), split: min(_as_bytes(usual[split]), SPLIT_BYTES)}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def bucketed(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame], laid: bool = False
) -> DataFrame:
    """A per-symbol table bucketed and sorted by symbol, written once per application.

    Bucket count follows the input bytes up to MOST_BUCKETS: raw rows shrink to one per symbol and session, so
    buckets stay far below a task's memory. Windows and joins on symbol then need no shuffle. ``laid``: the rows
    already lie in these buckets (they come from such a table, or from an exchange of theirs), so none is added.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUCKETED:
        tag = hashlib.sha256("|".join(key).encode()).hexdigest()[:12]
        n = buckets(spark, sf_dir)
        rows = build(spark, sf_dir)
        with sized(spark, sf_dir):
            (
                (rows if laid else rows.repartition(n, "symbol")).write.mode("overwrite").format("parquet")
                .option("path", f"{shared_dir(spark)}/crosstape/{name}-{tag}")
                .bucketBy(n, "symbol").sortBy("symbol", "day").saveAsTable(f"crosstape_{name}_{tag}")
            )
        _BUCKETED[key] = f"crosstape_{name}_{tag}"
    return spark.table(_BUCKETED[key])


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Drop what is remembered of an input that has changed: the next query writes its tables anew."""
    for known in (_BUCKETED, _WRITTEN, _BYTES):
        for key in [k for k in known if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
            del known[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Read a derived table, writing it to the shared folder the first time."""
    path, schema = _write_once(spark, sf_dir, name, build)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Append result rows tagged with the time and the batch; earlier rows are never touched."""
    rows.withColumn("at", F.current_timestamp()).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(path)


def read_ledger(
    spark: SparkSession, path: str, schema: StructType | None = None, *, batch: str | None = None, track: str | None = None,
    status: str | None = None, include_void: bool = False, limit: int | None = None,
) -> DataFrame:
    """Filtered ledger rows, newest first when limited. Rows before ``track`` existed count as 'cluster'."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return filtered(reader.parquet(path), batch=batch, track=track, status=status, include_void=include_void, limit=limit)


def filtered(rows: DataFrame, *, batch=None, track=None, status=None, include_void=False, limit=None) -> DataFrame:
    cols = set(rows.columns)
    if batch is not None:
        rows = rows.filter(F.col("batch") == batch)
    if track is not None and "track" in cols:
        rows = rows.filter(F.coalesce("track", F.lit("cluster")) == track)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if not include_void and "void" in cols:
        rows = rows.filter(~F.coalesce("void", F.lit(False)))
    if limit is not None:
        keys = [F.col("at").desc(), *[F.col(c) for c in ("variant", "symbol") if c in cols]]
        rows = rows.orderBy(*keys).limit(limit)
    return rows


def weight_rows(ledger: DataFrame) -> DataFrame:
    """Only the main book's trades, and the seed rows that predate any book, may move weights."""
    return ledger.filter(F.col("portfolio").isNull() | (F.col("portfolio") == "main"))
