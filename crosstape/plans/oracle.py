"""Check statements in plain SQL, assembled from named common table expressions."""

from __future__ import annotations

from ..sources.derived import ANNOUNCE_SELECT, BARS_CTES, BARS_SELECT, DENY_EVERY, FILINGS_CTE, FILINGS_SELECT

S = "partition by symbol order by day"


def win(a: int, b: int = 0, part: str = S) -> str:
    """ROWS frame a..b relative to the current row."""
    side = lambda k: "current row" if k == 0 else f"{abs(k)} {'preceding' if k < 0 else 'following'}"
    return f"({part} rows between {side(a)} and {side(b)})"


def full(expr: str, n: int) -> str:
    return f"case when ix >= {n - 1} then {expr} end"


def med_list(expr: str) -> str:
    """Median of a sorted list expression."""
    return (
        f"case when len({expr}) > 0 then case when len({expr}) % 2 = 1 then {expr}[len({expr})//2 + 1] "
        f"else ({expr}[len({expr})//2] + {expr}[len({expr})//2 + 1]) / 2 end end"
    )


def smooth_cte(name: str, src: str, value: str, n: int, seed_ix: int, alpha: str) -> str:
    """A recurrence as a recursive walk over the bar index."""
    return f"""
{name}_x as materialized (select symbol, day, ix, {value} as x from {src}),
{name}_s as materialized (select symbol, ix, x, avg(x) over {win(-(n - 1))} as m from {name}_x),
{name} as (select symbol, ix, m as y from {name}_s where ix = {seed_ix}
  union all select t.symbol, t.ix, e.y * (1 - {alpha}) + t.x * {alpha}
  from {name} e join {name}_s t on t.symbol = e.symbol and t.ix = e.ix + 1)
"""


TR = (
    "case when lag(close) over (partition by symbol order by day) is null then high - low else "
    "greatest(high - low, abs(high - lag(close) over (partition by symbol order by day)), "
    "abs(low - lag(close) over (partition by symbol order by day))) end"
)
UP = "greatest(close - lag(close) over (partition by symbol order by day), 0e0)"
DN = "greatest(lag(close) over (partition by symbol order by day) - close, 0e0)"

HI, LO = (lambda a, b: f"max(high) over {win(a, b)}"), (lambda a, b: f"min(low) over {win(a, b)}")

BREAKOUT = f"(ix >= 20 and close >= {HI(-20, -1)})"
VOLUME = f"coalesce(ix >= 19 and volume > 1.5e0 * avg(volume) over {win(-19)}, false)"
FLAG = f"""coalesce(ix >= 25 and (lag(close, 5) over ({S}) / lag(close, 25) over ({S}) - 1e0) * 100 >= 15e0
  and {HI(-25, -5)} - {LO(-25, -5)} > 0
  and {HI(-25, -5)} - {LO(-4, 0)} <= 0.5e0 * ({HI(-25, -5)} - {LO(-25, -5)})
  and {HI(-4, 0)} - {LO(-4, 0)} <= 0.6e0 * ({HI(-25, -5)} - {LO(-25, -5)}), false)"""
TRIANGLE = f"""coalesce(ix >= 19 and abs({HI(-9, 0)} - {HI(-19, -10)}) / {HI(-19, -10)} <= 0.03e0
  and ({LO(-9, 0)} - {LO(-19, -10)}) / {LO(-19, -10)} >= 0.02e0, false)"""
CUP = f"""coalesce(ix >= 64 and ({HI(-64, -50)} - {LO(-49, -20)}) / {HI(-64, -50)} between 0.15e0 and 0.5e0
  and abs({HI(-19, -5)} - {HI(-64, -50)}) / {HI(-64, -50)} <= 0.06e0
  and ({HI(-19, -5)} - {LO(-4, 0)}) / nullif({HI(-64, -50)} - {LO(-49, -20)}, 0) between 0 and 0.35e0, false)"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), f"{BARS_CTES.strip()}, bars as materialized ({BARS_SELECT})"),
    "sess": (("bars",), "sess as materialized (select day, row_number() over (order by day) - 1 as session_ix from (select distinct day from bars))"),
    "deny": ((), f"deny as (select concat('S', lpad(cast(s_suppkey as varchar), 6, '0')) as symbol from supplier where s_suppkey % {DENY_EVERY} = 0)"),
    "ann": ((), f"ann as materialized ({ANNOUNCE_SELECT})"),
    "wk": (("sess",), "wk as materialized (select day, row_number() over (order by day) - 1 as session_ix from sess where dayofweek(day) between 1 and 5)"),
    "annv": (
        ("ann", "wk"),
        """annv as materialized (select a.*, (select min(w.day) from wk w where w.day > cast(a.an_dt as date)
           or (w.day = cast(a.an_dt as date) and hour(a.an_dt) * 60 + minute(a.an_dt) < 930)) as visible_from from ann a)""",
    ),
    "fil": ((), f"{FILINGS_CTE.strip()}, fil as materialized ({FILINGS_SELECT})"),
    "ema20": (("bars",), smooth_cte("ema20", "bars", "close", 20, 19, "(2e0/21)")),
    "ema50": (("bars",), smooth_cte("ema50", "bars", "close", 50, 49, "(2e0/51)")),
    "atr14": (("bars",), smooth_cte("atr14", "bars", TR, 14, 14, "(1e0/14)")),
    "up14": (("bars",), smooth_cte("up14", "bars", UP, 14, 14, "(1e0/14)")),
    "dn14": (("bars",), smooth_cte("dn14", "bars", DN, 14, 14, "(1e0/14)")),
    "rsi14": (
        ("up14", "dn14"),
        "rsi14 as materialized (select u.symbol, u.ix, case when d.y = 0 then 100e0 else 100 - 100 / (1 + u.y / d.y) end as y from up14 u join dn14 d using (symbol, ix))",
    ),
    "feat": (
        ("bars",),
        f"""feat0 as materialized (select *, close / lag(close) over ({S}) - 1e0 as ret1,
  list(case when turnover > 0 then turnover end) filter (where turnover > 0) over {win(-60)} as t61,
  list(case when turnover > 0 then turnover end) filter (where turnover > 0) over {win(-250)} as t251 from bars),
feat1 as materialized (select *, list_sort(t61) as s61, list_sort(t251) as s251 from feat0),
feat as materialized (select * exclude (t61, t251, s61, s251), count(*) over (partition by symbol) as n_bars,
  close / lag(close, 125) over ({S}) - 1e0 as rs_raw, close / lag(close, 63) over ({S}) - 1e0 as ret63,
  round(avg(case when deliv_pct > 0 then deliv_pct end) over {win(-60)}, 9) as deliv_mean,
  {med_list('s61')} as liq, {med_list('s251')} as size_med, coalesce(len(s251), 0) as size_n,
  (max(high) over {win(-125)} - close) / max(high) over {win(-125)} * 100 as off_high,
  -((max(high) over {win(-125)} - close) / max(high) over {win(-125)} * 100) as near_high,
  {full(f'avg(close) over {win(-199)}', 200)} as sma200,
  case when {med_list('s61')} is not null and count(ret1) over {win(-20)} >= 5 then stddev_pop(ret1) over {win(-20)} * 100 end as vol_pct,
  max(ret1) over {win(-20)} as max_ret21, lead(open) over ({S}) as next_open, lead(day) over ({S}) as next_day,
  high = low as locked, {BREAKOUT} as breakout from feat1)""",
    ),
    "corpus": (("feat", "deny"), "corpus as materialized (select * from feat where n_bars >= 200 and symbol not in (select symbol from deny))"),
    "bands": (
        ("corpus",),
        """band0 as materialized (select *, row_number() over (partition by day order by size_med, symbol) - 1 as size_rank,
  floor(count(*) over (partition by day) * (2e0/3e0)) as cut from corpus where ix >= 200 and size_n > 100),
bands as materialized (select *, case when size_rank < floor(cut / 2) then 0 else 1 end as band_ix,
  case when size_rank < floor(cut / 2) then 'micro' else 'small' end as band from band0 where size_rank < cut)""",
    ),
    "scored": (("bands",), None),
    "picks": (
        ("scored",),
        "picks as materialized (select * from (select *, row_number() over (partition by day, band order by score desc, size_rank) as rank from scored) where rank <= 20)",
    ),
    "cands": (("picks",), None),
    "pooled_picks": (("bands",), None),
    "pooled_cands": (("pooled_picks",), None),
    "alloc": (
        ("cands",),
        """quota as materialized (select *, case band when 'micro' then 3 else 2 end as quota, case band when 'micro' then 0 else 1 end as take_ix from cands),
alloc as materialized (select *, row_number() over (partition by day order by slot) as seat from (
  select *, row_number() over (partition by day order by band_rank - 1, take_ix) as slot from quota where band_rank <= quota) where triggered)""",
    ),
    "signals": (("bands",), "signals as materialized (select * from bands where breakout and not locked)"),
    "trades": (("signals", "bars"), None),
}

SCORE_RANKS = lambda part: ", ".join(
    f"row_number() over (partition by {part} order by x_{f}, size_rank) / count(*) over (partition by {part}) * 100e0 as r_{f}"
    for f in ("rs", "deliv", "liq", "near_high")
)


def scored_cte(name: str, src: str = "bands", part: str = "day, band", w=(1.0, 1.5, 1.0, 1.0), momentum: str = "rs_raw") -> str:
    tot = sum(w)
    terms = " + ".join(f"r_{f} * {x}e0" for f, x in zip(("rs", "deliv", "liq", "near_high"), w))
    return f"""{name}0 as materialized (select *, {momentum} as x_rs, coalesce(deliv_mean, 0e0) as x_deliv, coalesce(liq, 0e0) as x_liq, near_high as x_near_high
  from {src} where {momentum} is not null),
{name}1 as materialized (select *, {SCORE_RANKS(part)} from {name}0),
{name} as materialized (select *, (0e0 + {terms}) / {tot}e0 as score from {name}1 where close > sma200)"""


def cands_cte(name: str, src: str, trig: str = "breakout") -> str:
    return f"""{name}0 as materialized (select *, least(floor(300000e0 * 2e0 / 100 / (close * 10e0 / 100)), floor(300000e0 * 75e0 / 100 / 5 * 1e0 / close)) as qty,
  {trig} and not locked as triggered, close * (1 - 10e0 / 100) as stop, close * (1 + 20e0 / 100) as target
  from {src} where not ((coalesce(asm, '') <> '' or coalesce(gsm, '') <> '' or fo_ban) and surveillance_known)),
{name} as materialized (select *, qty * (close * 10e0 / 100) as risk,
  row_number() over (partition by day, band order by floor(score * 10 + 0.5e0) / 10 desc, rank) as band_rank from {name}0 where qty >= 1)"""


def label_cte(name: str, src: str, stop: str = "10e0", target: str = "20e0", hold: str = "10", first: int = 1, late: int = 0,
              close_short: bool = True, keys: str = "", stop_px: str | None = None) -> str:
    """Barrier labels by a range join over the forward bars. ``keys``: extra columns that identify a signal."""
    level = stop_px or f"(e.open * (1 - {stop} / 100))"
    key = ", ".join(["symbol", "ix", *([keys] if keys else [])])
    keep = "" if close_short else f"where t.hit_ix is not null or t.last_ix >= t.ix + {hold} + {late}"
    return f"""{name}_e as materialized (select s.*, e.open as entry_px, e.day as entry_day, {level} as stop_px, e.open * (1 + {target} / 100) as target_px
  from {src} s join bars e on e.symbol = s.symbol and e.ix = s.ix + 1 where e.open > 0),
{name}_h as materialized (select {', '.join('s.' + k for k in key.split(', '))}, min(b.ix) filter (where b.ix >= s.ix + {first} and (b.low <= s.stop_px or b.high >= s.target_px)) as hit_ix,
  max(b.ix) as last_ix from {name}_e s join bars b on b.symbol = s.symbol and b.ix between s.ix + 1 and s.ix + {hold} + {late} group by all),
{name}_t as materialized (select s.*, h.hit_ix, h.last_ix from {name}_e s join {name}_h h using ({key})),
{name} as materialized (select t.*, b.ix as exit_ix, b.day as exit_day,
  case when t.hit_ix is null then 'time' when b.low <= t.stop_px then 'stop' else 'target' end as why,
  case when t.hit_ix is null then b.close when b.low <= t.stop_px then least(t.stop_px, b.open) else greatest(t.target_px, b.open) end as exit_px,
  (case when t.hit_ix is null then b.close when b.low <= t.stop_px then least(t.stop_px, b.open) else greatest(t.target_px, b.open) end / t.entry_px - 1) * 100 as ret
  from {name}_t t join bars b on b.symbol = t.symbol and b.ix = coalesce(t.hit_ix, least(t.ix + {hold} + {late}, t.last_ix)) {keep})"""


def charge(v: str, side: str) -> str:
    base = f"(20e0 + {v} * 0.001e0 + {v} * 0.0000297e0 + {v} * 1e-6 + 0.18e0 * (20e0 + {v} * 0.0000297e0 + {v} * 1e-6)"
    return base + (f" + {v} * 0.00015e0)" if side == "BUY" else " + 15.93e0)")


def impact(v: str, adv: str = "liq", vol: str = "vol_pct", c: str = "1e0") -> str:
    return f"(case when {adv} > 0 and {vol} > 0 then {c} * {vol} * sqrt({v} / {adv}) else 5e0 end)"


def net_cte(name: str, src: str, c: str = "1e0") -> str:
    qty = "least(floor(300000e0 * 2e0 / 100 / (entry_px * 10e0 / 100)), floor(300000e0 * 75e0 / 100 / 5 * 1e0 / entry_px))"
    return f"""{name}_q as materialized (select *, {qty} as nqty from {src}),
{name}_i as materialized (select *, {impact('(nqty * entry_px)', c=c)} as imp_in, {impact('(nqty * exit_px)', c=c)} as imp_out from {name}_q where nqty >= 1),
{name}_b as materialized (select *, nqty * (entry_px * (1 + imp_in / 100)) as buy, nqty * (exit_px * (1 - imp_out / 100)) as sell from {name}_i),
{name} as materialized (select *, sell - buy - ({charge('buy', 'BUY')} + {charge('sell', 'SELL')}) as net,
  (sell - buy - ({charge('buy', 'BUY')} + {charge('sell', 'SELL')})) / buy * 100 as net_ret,
  ({charge('buy', 'BUY')} + {charge('sell', 'SELL')}) / buy * 100 as cost_pct, imp_in + imp_out as imp from {name}_b)"""


CTES["scored"] = (("bands",), scored_cte("scored"))
CTES["cands"] = (("picks",), cands_cte("cands", "picks"))
CTES["pooled_picks"] = (
    ("bands",),
    scored_cte("pscored", part="day")
    + ", pooled_picks as materialized (select * from (select *, row_number() over (partition by day order by score desc, size_rank) as rank from pscored) where rank <= 40)",
)
CTES["pooled_cands"] = (("pooled_picks",), cands_cte("pooled_cands", "pooled_picks"))
CTES["label"] = (("signals", "bars"), label_cte("label", "signals"))
CTES["trades"] = (("label",), net_cte("trades", "label"))


def sql(deps: str, body: str, *more: str) -> str:
    """``with recursive`` over the named expressions (and their needs), extra CTE text, then the body."""
    seen: list[str] = []

    def visit(d: str) -> None:
        for x in CTES[d][0]:
            visit(x)
        if d not in seen:
            seen.append(d)

    for d in deps.split():
        visit(d)
    parts = [CTES[d][1].strip() for d in seen] + [m.strip() for m in more]
    return (f"with recursive {', '.join(parts)} " if parts else "") + body
