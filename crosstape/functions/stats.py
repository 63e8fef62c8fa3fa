"""Error bars as aggregate expressions: every one is a single map-side-combined pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_of(x: Column) -> Column:
    return F.count(x)


def population_bars(ret: str = "ret") -> list[Column]:
    """n, mean, se from the population deviation, 95% limits, t, significant; NULLs under 2 rows."""
    x = F.col(ret)
    n, m = F.count(x), F.avg(x)
    se = F.when(n >= 2, F.stddev_pop(x) / F.sqrt(n))
    t = F.when(n >= 2, F.when(se > 0, m / F.nullif(se, F.lit(0.0))).otherwise(F.lit(0.0)))
    return [
        n.alias("n"), m.alias("mean"), se.alias("se"), (m - 1.96 * se).alias("lo"), (m + 1.96 * se).alias("hi"),
        t.alias("t"), F.coalesce(F.abs(t) > 1.96, F.lit(False)).alias("significant"),
    ]


def sample_bars(ret: str = "ret") -> list[Column]:
    """n, mean, sample deviation and the standard error from it; unknown under 2 rows."""
    x = F.col(ret)
    n = F.count(x)
    sd = F.when(n >= 2, F.stddev_samp(x))
    return [n.alias("n"), F.avg(x).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.nullif(n, F.lit(0)))).alias("se")]


def spread_columns(x: Column, hi: Column, lo: Column) -> list[Column]:
    """Mean difference hi - lo with its Welch error from two conditional samples."""
    h, l = F.when(hi, x), F.when(lo, x)
    nh, nl = F.count(h), F.count(l)
    ok = (nh >= 2) & (nl >= 2)
    se = F.sqrt(F.var_samp(h) / F.nullif(nh, F.lit(0)) + F.var_samp(l) / F.nullif(nl, F.lit(0)))
    sp = F.avg(h) - F.avg(l)
    return [
        nh.alias("n_hi"), nl.alias("n_lo"), F.when(ok, sp).alias("spread"), F.when(ok, se).alias("se"),
        F.when(ok & (se > 0), F.try_divide(sp, se)).alias("t"),
    ]


def proportion_columns(flag: Column, a: Column, b: Column, least: int = 5) -> list[Column]:
    """Difference of two proportions in points, its error and t; unknown when either side is tiny."""
    x = flag.cast("double")
    na, nb = F.count(F.when(a, x)), F.count(F.when(b, x))
    pa, pb = F.avg(F.when(a, x)), F.avg(F.when(b, x))
    ok = (na >= least) & (nb >= least)
    se = F.sqrt(pa * (1 - pa) / F.nullif(na, F.lit(0)) + pb * (1 - pb) / F.nullif(nb, F.lit(0)))
    return [
        na.alias("n_a"), nb.alias("n_b"), F.when(ok, (pa - pb) * 100).alias("diff_pp"),
        F.when(ok, se * 100).alias("se_pp"), F.when(ok & (se > 0), F.try_divide(pa - pb, se)).alias("t"),
    ]


def correlation(x: str, y: str) -> Column:
    """Pearson r; NULL under 3 rows or when a side is flat."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    ok = (F.count(a) >= 3) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    # The built-in corr() divides by zero on a flat side under ANSI rules.
    return F.when(ok, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def slope_columns(x: str, y: str) -> list[Column]:
    """Least-squares slope of y on x, its standard error and t over the rows."""
    X, Y = F.col(x).cast("double"), F.col(y)
    n, b = F.count(F.when(X.isNotNull() & Y.isNotNull(), F.lit(1))), F.regr_slope(Y, X)
    sse = F.greatest(F.regr_syy(Y, X) - b * F.regr_sxy(Y, X), F.lit(0.0))
    se = F.when(n > 2, F.sqrt(F.try_divide(F.try_divide(sse, n - 2), F.regr_sxx(Y, X))))
    return [n.alias("n"), b.alias("slope"), se.alias("se"), F.when(se > 0, F.try_divide(b, se)).alias("t")]


def trades_needed(edge: Column, sd: Column | float = 16.0) -> Column:
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return F.when(edge != 0, F.floor(F.pow(1.96 * sd / F.abs(F.nullif(edge, F.lit(0.0))), F.lit(2))) + 1)


def half_year(day: Column, sep: str = "") -> Column:
    return F.concat(F.year(day).cast("string"), F.lit(sep), F.when(F.month(day) <= 6, F.lit("H1")).otherwise(F.lit("H2")))


def regime(day: Column) -> Column:
    """Three fixed spans of market history."""
    y = F.year(day)
    return F.when(y <= 2021, "2019-21").when(y <= 2023, "2022-23").otherwise("2024-26")
