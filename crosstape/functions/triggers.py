"""Entry triggers: a name to a boolean Column on the signal bar (never NULL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import lag, let, trailing
from .indicators import sma

# Pattern thresholds, fixed before any run.
FLAG_POLE, FLAG_LEN = 20, 5
FLAG_MIN_GAIN, FLAG_MAX_RETRACE, FLAG_MAX_RANGE = 15.0, 0.50, 0.60
TRI_WINDOW, TRI_TOP_TOL, TRI_MIN_RISE = 20, 0.03, 0.02
CUP_WINDOW, CUP_HANDLE = 60, 5
CUP_DEPTH_MIN, CUP_DEPTH_MAX, CUP_RIM_TOL, CUP_HANDLE_MAX = 0.15, 0.50, 0.06, 0.35


def _sure(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _top(first: int, last: int) -> Column:
    return F.max("high").over(trailing(first, last))


def _floor(first: int, last: int) -> Column:
    return F.min("low").over(trailing(first, last))


def none() -> Column:
    return F.lit(True)


def volume() -> Column:
    return _sure(let({"mean": sma("volume", 20), "v": F.col("volume")}, lambda mean, v: (mean > 0) & (v > 1.5 * mean)))


def breakout() -> Column:
    """Close at or above the highest high of the 20 bars before this one."""
    return _sure((F.col("ix") >= 20) & (F.col("close") >= _top(-20, -1)))


def not_overbought() -> Column:
    return _sure(F.col("rsi14") < 75)


def rsi_band() -> Column:
    return _sure(F.col("rsi14").between(50, 70))


def pullback() -> Column:
    gap = (F.col("close") - F.col("ema20")) / F.col("ema20")
    return _sure((gap >= 0) & (gap <= 0.04))


def vol_and_breakout() -> Column:
    return volume() & breakout()


def flag() -> Column:
    """A sharp advance (the pole), then a shallow, quiet pause."""
    start, end = -(FLAG_POLE + FLAG_LEN), -FLAG_LEN
    gain = (lag("close", FLAG_LEN) / lag("close", FLAG_POLE + FLAG_LEN) - 1.0) * 100
    frames = {
        "top": _top(start, end), "low": _floor(start, end), "pause_top": _top(end + 1, 0), "pause_low": _floor(end + 1, 0), "gain": gain,
    }
    shape = lambda top, low, p_top, p_low, g: (
        (g >= FLAG_MIN_GAIN) & (top > low)
        & (top - p_low <= FLAG_MAX_RETRACE * (top - low)) & (p_top - p_low <= FLAG_MAX_RANGE * (top - low))
    )
    return _sure((F.col("ix") >= FLAG_POLE + FLAG_LEN) & let(frames, shape))


def ascending_triangle() -> Column:
    """Two half windows with level highs and a rising floor."""
    half = TRI_WINDOW // 2
    frames = {
        "a_top": _top(-(TRI_WINDOW - 1), -half), "b_top": _top(-(half - 1), 0),
        "a_low": _floor(-(TRI_WINDOW - 1), -half), "b_low": _floor(-(half - 1), 0),
    }
    shape = lambda a_top, b_top, a_low, b_low: (
        (F.abs(b_top - a_top) / a_top <= TRI_TOP_TOL) & ((b_low - a_low) / a_low >= TRI_MIN_RISE)
    )
    return _sure((F.col("ix") >= TRI_WINDOW - 1) & let(frames, shape))


def cup_handle() -> Column:
    """A rounded recovery to the old rim, then a small pause."""
    q = CUP_WINDOW // 4
    lo = -(CUP_HANDLE + CUP_WINDOW - 1)
    frames = {
        "left": _top(lo, lo + q - 1), "trough": _floor(lo + q, -(CUP_HANDLE + q)),
        "right": _top(-(CUP_HANDLE + q - 1), -CUP_HANDLE), "handle": _floor(-(CUP_HANDLE - 1), 0),
    }
    shape = lambda left, trough, right, handle: (
        ((left - trough) / left).between(CUP_DEPTH_MIN, CUP_DEPTH_MAX)
        & (F.abs(right - left) / left <= CUP_RIM_TOL)
        & ((right - handle) / F.when(left > trough, left - trough)).between(0, CUP_HANDLE_MAX)
    )
    return _sure((F.col("ix") >= CUP_HANDLE + CUP_WINDOW - 1) & let(frames, shape))


def any_pattern() -> Column:
    return flag() | ascending_triangle() | cup_handle()


TRIGGERS: dict[str, Callable[[], Column]] = {
    "none": none,
    "volume": volume,
    "breakout": breakout,
    "not_overbought": not_overbought,
    "rsi_band": rsi_band,
    "pullback": pullback,
    "vol+breakout": vol_and_breakout,
    "flag": flag,
    "asc_triangle": ascending_triangle,
    "cup_handle": cup_handle,
    "pattern": any_pattern,
}
# Triggers that read the smoothed columns rsi14 / ema20 besides the bars.
NEEDS_SMOOTHING = {"not_overbought", "rsi_band", "pullback"}
