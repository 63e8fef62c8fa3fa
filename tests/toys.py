"""Small bar tables for tests."""

from datetime import date, timedelta

START = date(2020, 1, 1)
BAR = "symbol string, day date, open double, high double, low double, close double, volume long, turnover double, deliv_pct double, asm string, gsm string, fo_ban boolean, surveillance_known boolean, ix int"


def series(symbol, closes, highs=None, lows=None, opens=None, volumes=None, turnover=1e6, deliv=40.0):
    out = []
    for i, c in enumerate(closes):
        o = opens[i] if opens else c
        h, lo = (highs[i] if highs else c + 1), (lows[i] if lows else c - 1)
        v = volumes[i] if volumes else 1000
        out.append((symbol, START + timedelta(days=i), float(o), float(h), float(lo), float(c), int(v), float(turnover), deliv, None, None, False, True, i))
    return out


def bars(spark, *rows):
    return spark.createDataFrame([r for s in rows for r in s], BAR)


def column(df, name, symbol="A"):
    return [r[name] for r in df.filter(df.symbol == symbol).orderBy("ix").collect()]
