from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from crosstape.functions import costs, stats
from crosstape.operators import asof, evidence, text


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_impact_and_charges(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert value(spark, costs.impact_pct(lit(100), lit(10000), lit(3))) == pytest.approx(0.3)
    assert value(spark, costs.impact_pct(lit(100), lit(0), lit(3))) == 5.0 and value(spark, costs.impact_pct(lit(100), lit(None), lit(3))) == 5.0
    buy, sell = value(spark, costs.charge(lit(10000), "BUY")), value(spark, costs.charge(lit(10000), "SELL"))
    assert buy == pytest.approx(20 + 10 + 0.297 + 0.01 + 0.18 * 20.307 + 1.5) and sell - buy == pytest.approx(15.93 - 1.5)
    assert value(spark, costs.slippage_bps(lit(100), lit(0))) == 50 and value(spark, costs.slippage_bps(lit(100), lit(10000))) == pytest.approx(15)


def test_gate_reports_the_first_reason(spark):
    cols = "high double, low double, asm string, gsm string, fo_ban boolean, turnover double, e double, s double, t double, heat double"
    ok = (11.0, 9.0, None, None, False, 1e8, 100.0, 90.0, 130.0, 0.0)
    case = lambda **k: tuple({**dict(zip([c.split()[0] for c in cols.split(", ")], ok)), **k}.values())
    rows = [
        (None, case()), ("stop_above_entry", case(s=100.0)), ("rr_below_3.0", case(t=129.0)), ("asm:Stage I", case(asm="Stage I", gsm="G")), ("gsm:G", case(gsm="G")),
        ("fo_ban", case(fo_ban=True)), ("circuit_locked", case(high=9.0)), ("risk_qty_zero", case(e=1e7, s=1e6, t=1e8)), ("illiquid", case(turnover=5.0)),
        ("costs_exceed_risk", case(turnover=2e4)), ("portfolio_heat", case(heat=0.058)),
    ]
    df = spark.createDataFrame([r for _, r in rows], cols).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    got = [r["g"] for r in df.select("i", costs.gate_reason(F.col("e"), F.col("s"), F.col("t"), F.lit(300000.0), F.col("heat")).alias("g")).orderBy("i").collect()]
    assert got == [w for w, _ in rows]


def test_fills_at_gaps_and_locks(spark):
    df = spark.createDataFrame([(105.0, 110.0, 104.0), (95.0, 99.0, 90.0), (100.0, 100.0, 100.0)], "open double, high double, low double")
    got = [tuple(r) for r in df.select(costs.entry_fill(F.lit(102.0)), costs.stop_fill(F.lit(97.0)), costs.target_fill(F.lit(108.0))).collect()]
    assert got == [(105.0, None, 108.0), (None, 95.0, None), (None, None, None)]


def test_sizing(spark):
    lit = F.lit
    assert value(spark, costs.position_qty(lit(100.0))) == 450 and value(spark, costs.position_qty(lit(100.0), seats=12)) == 187
    assert value(spark, costs.size_mult("invvol", lit(0), lit(10.0), lit(2.0))) == 0.5 and value(spark, costs.size_mult("conviction", lit(0), lit(1.0), lit(1.0))) == 1.6
    with pytest.raises(ValueError):
        costs.size_mult("odd", lit(0), lit(1.0), lit(1.0))
    assert value(spark, costs.financial_year(lit("2020-03-31").cast("date"))) == 2019 and value(spark, costs.financial_year(lit("2020-04-01").cast("date"))) == 2020


def test_error_bars(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "ret double")
    p = df.agg(*stats.population_bars()).first()
    assert p["mean"] == 2.5 and p["se"] == pytest.approx(1.118034 / 2, rel=1e-6) and p["significant"]
    s = df.agg(*stats.sample_bars()).first()
    assert s["se"] == pytest.approx(1.2909944 / 2, rel=1e-6)
    one = df.limit(1).agg(*stats.population_bars()).first()
    assert one["se"] is None and one["t"] is None and one["significant"] is False
    assert value(spark, stats.trades_needed(F.lit(2.15))) == 213 and value(spark, stats.trades_needed(F.lit(0.0))) is None


def test_slope_and_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (1 if i % 2 else -1)) for i in range(20)], "x double, y double")
    r = df.agg(*stats.slope_columns("x", "y"), stats.correlation("x", "y").alias("r")).first()
    assert r["slope"] == pytest.approx(2.0, abs=0.02) and r["t"] > 10 and r["r"] > 0.99
    assert df.limit(2).agg(stats.correlation("x", "y").alias("r")).first()["r"] is None
    assert df.withColumn("x", F.lit(1.0)).agg(stats.correlation("x", "y").alias("r")).first()["r"] is None


def test_forward_checks_use_measured_holds(spark):
    df = spark.createDataFrame([(5, 1.0, 6.0, 3.0, 2.0, 1.0), (30, 10.0, 6.9, 3.0, 2.0, 1.0), (300, 10.0, 0.0, 9.0, 9.0, 0.1)], "closed int, months double, mean_hold double, occ double, mean double, se double")
    got = [{x["check_name"]: x["state"] for x in evidence.forward_checks(df.filter(F.col("closed") == n)).collect()} for n in (5, 30, 300)]
    assert set(got[0].values()) == {"early"}
    assert got[1] == {"rate": "pass", "hold": "pass", "occupancy": "pass", "edge": "early"}
    assert set(got[2].values()) == {"fail"}


# --- text -------------------------------------------------------------------------


def tone(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r["tone"] for r in text.text_tone(df, "id", "t", text.lexicon_table(spark)).orderBy("id").collect()]


def test_tone_and_negation(spark):
    got = tone(spark, "Profit surged to a record", "not profitable", "no growth and no loss", "the board met", None, "loss loss profit", "not aa bb cc profit")
    assert got == pytest.approx([1.0, -1.0, 0.0, 0.0, 0.0, -1 / 3, 1.0])


def test_filing_score_and_bands(spark):
    s = lambda c, t: value(spark, text.filing_score(F.lit(c).cast("double"), F.lit(t).cast("double")))
    assert s(1, -1) == pytest.approx(0.4) and s(None, 0.5) == 0.5 and s(-1, 0) == -1 and s(0, None) == 0
    bands = [value(spark, text.band(F.lit(x).cast("double"))) for x in (7, 6.99, 2.99, -3, -7, None)]
    assert bands == ["Very Bullish", "Bullish", "Neutral", "Bearish", "Very Bearish", "No data"]


def test_channel_needs_agreement(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0), ("b", 0.0), ("b", 1.0), ("c", 0.0)], "k string, s double")
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(text.channel_score("s").alias("v")).collect()}
    assert got == {"a": 3.33, "b": 6.0, "c": None}


def test_mentions_need_two_name_words_or_the_ticker(spark):
    master = spark.createDataFrame([("HCGL", "Healthcare Global Enterprises Oncology Chain Limited"), ("YUKEN", "Yuken India Limited"), ("AB", "Alpha Betaworks Ltd")], "symbol string, company string")
    items = spark.createDataFrame(
        [(1, "Global Market: shares little changed"), (2, "Oncology chain opens centre"), (3, "YUKEN wins"), (4, "hcgl rallies"), (5, "oncology only"), (6, "alpha and betaworks merge"), (7, "yukens")], "id int, t string"
    )
    got = sorted((r["id"], r["symbol"]) for r in text.mentions(items, master, "id", "t").collect())
    assert got == [(2, "HCGL"), (3, "YUKEN"), (4, "HCGL"), (6, "AB")]


def test_mentions_equal_brute_force_when_everyone_shares_a_word(spark):
    names = [(f"SYM{i}", f"Common {'Rare' + chr(97 + i % 20)} Word{i % 7}xx") for i in range(60)]
    docs = [(i, " ".join(["common"] * (i % 3) + ["rare" + chr(97 + i % 20)] * (i % 2) + [f"word{i % 9}xx"])) for i in range(120)]
    master, items = spark.createDataFrame(names, "symbol string, company string"), spark.createDataFrame(docs, "id int, t string")
    got = {(r["id"], r["symbol"]) for r in text.mentions(items, master, "id", "t").collect()}
    want = set()
    for i, t in docs:
        have = set(t.split())
        for s, n in names:
            if len(have & set(n.lower().split())) >= 2 or s.lower() in have:
                want.add((i, s))
    assert got == want and want


def test_publishers_and_redirects(spark):
    df = spark.createDataFrame(
        [("Moneycontrol", "x"), ("moneycontrol.com", "x"), ("Morningstar%2c Inc.", "x"), ("", "economictimes.indiatimes.com"), ("et_markets", "x"), ("Mint on MSN", "x"), ("www.Unknown.in", "x")], "raw string, host string"
    )
    got = [r["p"] for r in df.select(text.publisher(F.col("raw"), F.col("host")).alias("p")).collect()]
    assert got == ["Moneycontrol", "Moneycontrol", "Morningstar, Inc.", "The Economic Times", "The Economic Times", "Mint", "Unknown"]
    link = "http://www.bing.com/news/apiclick.aspx?ref=1&url=https%3a%2f%2fa.com%2fx"
    assert value(spark, text.unwrapped(F.lit(link))) == "https://a.com/x" and value(spark, text.unwrapped(F.lit("https://b.com/y"))) == "https://b.com/y"


def test_stories_and_dead_feeds(spark):
    rows = [("a", "t", "https://x.com/topic/y", date(2020, 1, 30), None), ("a", "ABC share price today", "https://x.com/1", date(2020, 1, 30), None), ("a", "ABC wins order", "https://x.com/2", date(2020, 1, 30), None),
            ("d", "old", "https://x.com/3", date(2020, 1, 1), None), ("d", "older", "https://x.com/4", None, None), ("q", "own old", "https://x.com/5", date(2020, 1, 10), "ABC"), ("q", "own older", "https://x.com/6", date(2019, 1, 1), "ABC")]
    df = spark.createDataFrame(rows, "source string, title string, link string, published date, symbol string")
    assert text.stories(df.filter("source = 'a'")).count() == 1
    got = sorted(r["title"] for r in text.fresh(df.filter("source <> 'a'"), F.lit("2020-02-01").cast("date")).collect())
    assert got == ["own old"]


# --- as of ------------------------------------------------------------------------


def test_visibility_rule(spark):
    s = spark.createDataFrame([(date(2020, 1, d), i) for i, d in enumerate((2, 3, 6))], "day date, session_ix int")
    ts = [datetime(2020, 1, 2, 10, 0), datetime(2020, 1, 2, 15, 29, 59), datetime(2020, 1, 2, 15, 30), datetime(2020, 1, 2, 22, 56), datetime(2020, 1, 4, 9, 0), datetime(2019, 12, 1, 9, 0), datetime(2020, 1, 6, 16, 0), datetime(2020, 2, 1, 9, 0)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id int, an_dt timestamp")
    got = {r["id"]: r["visible_from"].day for r in asof.with_visibility(df, s).collect()}
    assert got == {0: 2, 1: 2, 2: 3, 3: 3, 4: 6, 5: 2}


def test_as_of_never_looks_ahead(spark):
    pts = spark.createDataFrame([("A", date(2020, 1, d)) for d in (1, 5, 9)] + [("B", date(2020, 1, 9))], "symbol string, day date")
    facts = spark.createDataFrame([("A", date(2020, 1, 5), date(2019, 12, 31), 10.0), ("A", date(2020, 1, 7), date(2019, 9, 30), 20.0)], "symbol string, visible_from date, quarter_end date, revenue double")
    got = [(r["symbol"], r["day"].day, r["revenue"]) for r in asof.as_of(pts, facts, ["symbol"], "day", "visible_from", ["quarter_end"], ["revenue"]).orderBy("symbol", "day").collect()]
    assert got == [("A", 1, None), ("A", 5, 10.0), ("A", 9, 20.0), ("B", 9, None)]


def test_growth_needs_a_positive_base_and_history(spark):
    q = [date(2019, 3, 31), date(2019, 6, 30), date(2019, 9, 30), date(2019, 12, 31), date(2020, 3, 31), date(2020, 6, 30)]
    rows = [("A", e, date(e.year, e.month, 28), r, r / 10) for e, r in zip(q, (100.0, 0.0, 100.0, 100.0, 120.0, 50.0))]
    got = asof.filing_versions(spark.createDataFrame(rows, "symbol string, quarter_end date, visible_from date, revenue double, net_profit double")).orderBy("fv").collect()
    assert [r["growth_yoy"] for r in got][:4] == [None] * 4 and got[4]["growth_yoy"] == pytest.approx(0.2) and got[5]["growth_yoy"] is None
    assert got[0]["next_expected"] is None and got[4]["margin"] == pytest.approx(10)


def test_announcement_features_windows(spark):
    days = spark.createDataFrame([("A", date(2020, 1, 1), 4, False, 1.0), ("A", date(2020, 3, 1), 2, True, None), ("A", date(2020, 3, 5), 1, False, -1.0)], "symbol string, visible_from date, n long, flagged boolean, tone double")
    pts = spark.createDataFrame([("A", date(2019, 12, 31)), ("A", date(2020, 3, 4)), ("A", date(2020, 3, 5)), ("A", date(2021, 3, 5))], "symbol string, day date")
    got = asof.announcement_features(pts, days).orderBy("day").collect()
    assert got[0]["ann_burst"] is None and got[0]["ann_tone"] is None
    assert (got[1]["recent_n"], got[1]["base_n"], got[1]["ann_tone"], got[1]["ann_flag"]) == (2, 6, 0.0, 1.0)
    assert got[2]["ann_tone"] == -1.0 and got[2]["ann_burst"] == pytest.approx((3 - 7 / 365 * 30) / (7 / 365 * 30 + 1))
    assert (got[3]["recent_n"], got[3]["base_n"]) == (0, 1)
