"""One place for window specs, so operators on the same frame share one Window node.

Every per-symbol window is bounded: a symbol has at most one bar per session
(the ingest groups raw rows by symbol and day), so a partition never holds more
rows than the calendar has days, however skewed the raw feed is.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("day")


def trailing(first: int, last: int = 0) -> WindowSpec:
    """Rows first..last relative to the current bar; gaps have no rows, so ROWS not RANGE."""
    return series().rowsBetween(first, last)


def full(expr: Column, n: int) -> Column:
    """NULL until n bars exist: too little history is unknown, not zero."""
    return F.when(F.col("ix") >= n - 1, expr)


def lag(name: str, k: int) -> Column:
    return F.lag(name, k).over(series())


def let(values: dict[str, Column], body) -> Column:
    """Evaluate each named value once and hand them to ``body``.

    A window expression mentioned twice in a formula would be computed twice;
    bound here it is computed once. Pass plain columns in as well: a name inside
    a lambda would resolve to an alias of the same select before the input column.
    """
    cell = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(cell), lambda x: body(*[x[k] for k in values])), F.lit(0))
