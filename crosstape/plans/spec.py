"""Query registry: a DataFrame builder, its output columns and the check statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    """``cols`` is 'name:kind' text; kinds: s text, d date, t timestamp, f number, i integer, b boolean.

    Both engines project to exactly these columns, dates as ISO text and
    numbers at 6 digits, so results compare by value.
    """

    name: str
    covers: str
    build: Callable[[SparkSession, str], DataFrame]
    cols: str
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.cols.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.select(*[_spark_cell(n, k) for n, k in self.columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cells = ", ".join(_sql_cell(n, k) for n, k in self.columns())
        return f"select {cells} from ({self.sql}) as result"


def _spark_cell(name: str, kind: str):
    c = F.col(name)
    if kind == "f":
        # Adding zero turns -0.0 into 0.0.
        c = F.round(c.cast("double"), 6) + F.lit(0.0)
    elif kind == "d":
        c = c.cast("date").cast("string")
    elif kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("boolean")
    else:
        c = c.cast("string")
    return c.alias(name)


def _sql_cell(name: str, kind: str) -> str:
    if kind == "f":
        e = f"round(cast({name} as double), 6) + 0e0"
    elif kind == "d":
        e = f"cast(cast({name} as date) as varchar)"
    elif kind == "t":
        e = f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    elif kind == "i":
        e = f"cast({name} as bigint)"
    elif kind == "b":
        e = f"cast({name} as boolean)"
    else:
        e = f"cast({name} as varchar)"
    return f"{e} as {name}"


def query(name: str, covers: str, cols: str, sql: str | None = None):
    """Register a builder under ``name``; ``covers`` lists the inventory ids it answers."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, covers, fn, cols, sql)
        return fn

    return wrap
