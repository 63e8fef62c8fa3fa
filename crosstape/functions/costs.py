"""Fills, charges, impact, sizing and gates as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delivery-segment charge rates and the book's fixed settings.
BROKERAGE, STT, EXCHANGE_TXN, SEBI, GST, STAMP_BUY, DP_SELL = 20.0, 0.001, 0.0000297, 1e-6, 0.18, 0.00015, 15.93
CAPITAL, RISK_PCT, STOP_PCT, TARGET_PCT, HOLD_DAYS = 300_000.0, 2.0, 10.0, 20.0, 10
MAX_POSITIONS, DEPLOY_PCT = 5, 75.0
MIN_RR, RR_EPS = 3.0, 1e-9
MAX_ADV_PARTICIPATION, MAX_PORTFOLIO_HEAT, RISK_PER_TRADE, MAX_COST_RATIO = 0.01, 0.06, 0.005, 0.10
UNPRICEABLE_IMPACT = 5.0
TAX_RATE = 0.20


def impact_pct(value: Column, adv: Column, vol_pct: Column, c: Column | float = 1.0) -> Column:
    """One-way square-root impact in percent; an unpriceable order pays a flat 5."""
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.when((adv > 0) & (vol_pct > 0), c * vol_pct * F.sqrt(value / adv)).otherwise(F.lit(UNPRICEABLE_IMPACT))


def charge(value: Column, side: str) -> Column:
    txn, sebi = value * EXCHANGE_TXN, value * SEBI
    gst = GST * (F.lit(BROKERAGE) + txn + sebi)
    base = F.lit(BROKERAGE) + value * STT + txn + sebi + gst
    return base + value * STAMP_BUY if side == "BUY" else base + DP_SELL


def slippage_bps(value: Column, turnover: Column, base: float = 5.0, per_pct: float = 10.0) -> Column:
    return F.when(turnover <= 0, F.lit(base * 10)).otherwise(base + per_pct * (value / turnover / 0.01))


def risk_qty(entry: Column, stop: Column, equity: Column) -> Column:
    return F.floor(equity * RISK_PER_TRADE / (entry - stop))


def liquidity_qty(entry: Column, turnover: Column) -> Column:
    return F.floor(MAX_ADV_PARTICIPATION * turnover / entry)


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    risk = entry - stop
    return F.when(risk > 0, (target - entry) / risk).otherwise(F.lit(-1.0))


def gate_reason(entry: Column, stop: Column, target: Column, equity: Column, open_risk: Column) -> Column:
    """First failing invariant as text, NULL when accepted. Reads bar columns by name.

    A CASE chain evaluates in order, so every branch may assume the earlier ones passed.
    """
    risk = F.when(entry > stop, entry - stop)
    rq = F.floor(equity * RISK_PER_TRADE / risk)
    lq = liquidity_qty(entry, F.col("turnover"))
    qty = F.least(rq, lq)
    round_trip = charge(qty * entry, "BUY") + charge(qty * target, "SELL")
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(entry <= stop, "stop_above_entry")
        .when(reward_risk(entry, stop, target) < MIN_RR - RR_EPS, f"rr_below_{MIN_RR}")
        .when(text(F.col("asm")), F.concat(F.lit("asm:"), F.col("asm")))
        .when(text(F.col("gsm")), F.concat(F.lit("gsm:"), F.col("gsm")))
        .when(F.col("fo_ban"), "fo_ban")
        .when(F.col("high") == F.col("low"), "circuit_locked")
        .when(rq < 1, "risk_qty_zero")
        .when(lq < 1, "illiquid")
        .when(round_trip > MAX_COST_RATIO * qty * risk, "costs_exceed_risk")
        .when(open_risk + qty * risk / equity > MAX_PORTFOLIO_HEAT, "portfolio_heat")
    )


def _unlocked(expr: Column) -> Column:
    return F.when(F.col("high") != F.col("low"), expr)


def entry_fill(trigger: Column) -> Column:
    return _unlocked(F.when(F.col("high") >= trigger, F.greatest(trigger, F.col("open"))))


def stop_fill(stop: Column) -> Column:
    return _unlocked(F.when(F.col("low") <= stop, F.least(stop, F.col("open"))))


def target_fill(target: Column) -> Column:
    return _unlocked(F.when(F.col("high") >= target, F.greatest(target, F.col("open"))))


def position_qty(
    entry: Column, capital: Column | float = CAPITAL, mult: Column | float = 1.0, seats: int = MAX_POSITIONS, stop_pct: float = STOP_PCT
) -> Column:
    """Whole shares: risk-based, capped by one seat's share of the deployed pot."""
    capital = capital if isinstance(capital, Column) else F.lit(float(capital))
    mult = mult if isinstance(mult, Column) else F.lit(float(mult))
    by_risk = F.floor((capital * RISK_PCT / 100) / (entry * stop_pct / 100))
    by_cap = F.floor((capital * DEPLOY_PCT / 100 / seats * mult) / entry)
    return F.when(entry > 0, F.least(by_risk, by_cap)).otherwise(F.lit(0))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), x))


def size_mult(scheme: str, rank: Column, vol: Column, med_vol: Column) -> Column:
    """Split of the pot across names; ``rank`` counts from 0."""
    invvol = F.when((vol > 0) & (med_vol > 0), _clamp(med_vol / vol)).otherwise(F.lit(1.0))
    conviction = _clamp(F.lit(1.6) - F.lit(0.3) * rank)
    schemes = {"equal": F.lit(1.0), "invvol": invvol, "conviction": conviction, "both": F.sqrt(invvol * conviction)}
    if scheme not in schemes:
        raise ValueError(f"unknown sizing scheme {scheme!r}")
    return schemes[scheme]


def financial_year(day: Column) -> Column:
    """April-March year, named by its first calendar year."""
    return F.when(F.month(day) > 3, F.year(day)).otherwise(F.year(day) - 1)
