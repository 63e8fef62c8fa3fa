"""Row numbers inside groups: one window per session, range slabs where a group grows with the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

# Share of the universe, from the least liquid end, that bands are cut from.
TRADEABLE = 2 / 3


def ranked(df: DataFrame, by: list[str], order: list[Column], into: str, count_into: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group (and the group size), one window per group.

    For groups of one session: they hold a row per listed symbol. ``order`` must be total.
    Groups that grow with the history go through ``wide_ranked``.
    """
    out = df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    if count_into:
        out = out.withColumn(count_into, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return out


def wide_ranked(
    df: DataFrame, by: list[str], order: list[Column], into: str, count_into: str | None = None, slabs: int | None = None
) -> DataFrame:
    """As ``ranked``, for groups of any size, or one group of all rows.

    Rows are range partitioned over (group, order), numbered inside each slab and
    shifted by the rows of earlier slabs, so no task ever holds a whole group. A
    hash of the row ends the order: rows that are equal under it spread over
    slabs too, and their places are repeatable.
    """
    spark = df.sparkSession
    slabs = slabs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.xxhash64(*df.columns)]
    # Slab ids must not move between the two reads below, hence the checkpoint.
    laid = durable(df.repartitionByRange(slabs, *by, *order).withColumn("_slab", F.spark_partition_id()))
    # At most one row per slab plus one per group boundary.
    sizes = laid.groupBy("_slab", *by).agg(F.count(F.lit(1)).alias("_n"))
    keys = by or [F.lit(0)]
    run = Window.partitionBy(*keys).orderBy("_slab")
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if count_into:
        sizes = sizes.withColumn(count_into, F.sum("_n").over(Window.partitionBy(*keys)))
    local = F.row_number().over(Window.partitionBy("_slab", *by).orderBy(*order))
    return (
        # As many partitions as slabs: the exchange by slab may not put them together again.
        laid.repartition(slabs, "_slab", *by).withColumn("_local", local)
        .join(sizes.drop("_n"), ["_slab", *by])
        .withColumn(into, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_local", "_before", "_slab")
    )


def percentile_rank(df: DataFrame, by: list[str], value: str, ties: list[str], into: str) -> DataFrame:
    """Position / group size * 100; equal values take consecutive places in ``ties`` order."""
    return percentile_ranks(df, by, {value: into}, ties)


def percentile_ranks(df: DataFrame, by: list[str], values: dict[str, str], ties: list[str]) -> DataFrame:
    """``percentile_rank`` of several columns of the same groups, whose sizes are counted once, in the first one's order."""
    out = df
    for k, (value, into) in enumerate(values.items()):
        order = [F.col(value), *[F.col(t) for t in ties]]
        out = ranked(out, by, order, "_k", None if k else "_m").withColumn(into, F.col("_k") / F.col("_m") * 100)
    return out.drop("_k", "_m")


def neutral_percentile_rank(df: DataFrame, by: list[str], value: str, ties: list[str], into: str) -> DataFrame:
    """As percentile_rank over the known values; an unknown value sits at 50.

    Unknown values stand last in the group's own order, so no exchange is added.
    """
    known = F.col(value).isNotNull()
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy((~known).cast("int"), value, *ties))
    of = F.count(F.when(known, 1)).over(group)
    return df.withColumn(into, F.when(known, place / of * 100).otherwise(F.lit(50.0)))


def relative_strength(bars: DataFrame, lookbacks) -> DataFrame:
    """Per-day percentile of each k-bar return among the symbols that have one; all from one exchange on the day."""
    from ..functions.indicators import bar_return

    out = bars
    for k in lookbacks:
        out = out.withColumn(f"_r{k}", bar_return(k))
    day = Window.partitionBy("day")
    for k in lookbacks:
        known = F.col(f"_r{k}").isNotNull()
        place = F.row_number().over(day.orderBy((~known).cast("int"), f"_r{k}", "symbol"))
        out = out.withColumn(f"rs_{k}", F.when(known, place / F.count(F.when(known, 1)).over(day) * 100))
    return out.drop(*[f"_r{k}" for k in lookbacks])


def breadth(bars_with_ema: DataFrame, ema: str = "ema50") -> DataFrame:
    """Share of symbols above their own mean, per day, among those that have one."""
    known = bars_with_ema.filter(F.col(ema).isNotNull())
    return known.groupBy("day").agg(
        F.avg(F.when(F.col("close") > F.col(ema), 1.0).otherwise(0.0)).alias("breadth"),
        F.count(F.lit(1)).alias("n"),
    )


def size_bands(features: DataFrame, names: tuple[str, ...] = ("micro", "small")) -> DataFrame:
    """Turnover bands per day: the most liquid third is cut, the rest split in equal bands.

    Integer arithmetic on the ascending rank; an ntile would place remainders differently.
    Adds band, band_ix and size_rank (0-based over the day).
    """
    eligible = features.filter((F.col("ix") >= 200) & (F.col("size_n") > 100))
    out = ranked(eligible, ["day"], [F.col("size_med"), F.col("symbol")], "_k", "_m")
    k = len(names)
    out = out.withColumn("_cut", F.floor(F.col("_m") * TRADEABLE)).withColumn("size_rank", F.col("_k") - 1)
    ix = None
    for b in range(k):
        lo, hi = F.floor(F.lit(b) * F.col("_cut") / k), F.floor(F.lit(b + 1) * F.col("_cut") / k)
        hit = (F.col("size_rank") >= lo) & (F.col("size_rank") < hi)
        ix = F.when(hit, b) if ix is None else ix.when(hit, b)
    out = out.withColumn("band_ix", ix).filter(F.col("band_ix").isNotNull())
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("band_ix") + 1)
    return out.withColumn("band", label).drop("_k", "_m", "_cut")
