from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from crosstape.operators import asof, book, universe
from crosstape.sources import files, ledger
from crosstape.streaming import feeds, positions

HEAD = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER"


def bar_line(sym, series="EQ", day="05-Jan-2024", deliv="50", pct="50.00"):
    return f"{sym}, {series}, {day}, 100, 101, 105, 99, 104, 104.5, 102, 1000, 12.5, 90, {deliv}, {pct}"


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "raw" / "2024-01-05"
    d.mkdir(parents=True)
    lines = [HEAD, bar_line("GOOD"), bar_line("FLAGGED"), bar_line("BANNED", deliv=" -", pct=" -"), bar_line("T2TONLY", "BE"), bar_line("SOMEETF")]
    (d / "bhavcopy_delivery.csv").write_text("\n".join(lines) + "\n")
    (d / "asm.json").write_text('{"longterm": {"data": [{"symbol": "FLAGGED", "asmSurvIndicator": "Stage I"}]}, "shortterm": {"data": []}}')
    (d / "gsm.json").write_text("[]")
    (d / "fo_secban.csv").write_text("Securities in Ban For Trade Date 08-JAN-2024:\n1,BANNED\n")
    (d / "equity_master.csv").write_text("SYMBOL,NAME OF COMPANY, SERIES\nGOOD,Good Ltd,EQ\nFLAGGED,Flagged Ltd,EQ\nBANNED,Banned Ltd,EQ\n")
    e = tmp_path / "raw" / "2024-01-08"
    e.mkdir()
    (e / "bhavcopy_delivery.csv").write_text("\n".join([HEAD, bar_line("GOOD"), bar_line("BAD", pct="x").replace("101", "oops")]) + "\n")
    return str(tmp_path / "raw")


def test_load_bars(spark, tree):
    got = {(r["symbol"], r["day"].day): r for r in files.load_bars(spark, tree).collect()}
    assert set(got) == {("GOOD", 5), ("FLAGGED", 5), ("BANNED", 5), ("GOOD", 8), ("BAD", 8)}
    g = got[("GOOD", 5)]
    assert (g["open"], g["volume"], g["turnover"], g["deliv_pct"], g["restricted"], g["surveillance_known"]) == (101.0, 1000, 1_250_000.0, 50.0, False, True)
    assert got[("FLAGGED", 5)]["asm"] == "Stage I" and got[("FLAGGED", 5)]["restricted"]
    assert got[("BANNED", 5)]["fo_ban"] and got[("BANNED", 5)]["deliv_pct"] is None and got[("BANNED", 5)]["deliv_qty"] == 0
    assert got[("BAD", 8)]["open"] is None and got[("GOOD", 8)]["surveillance_known"] is False


def test_stale_file_is_found(spark, tree):
    got = universe.stale_files(files.bar_file_dates(spark, tree)).collect()
    assert [(r["folder"], r["inside"]) for r in got] == [(date(2024, 1, 8), date(2024, 1, 5))]


def test_manifest(spark, tree):
    got = files.manifest(spark, f"{tree}/*/gsm.json").first()
    assert got["bytes"] == 2 and got["sha256"].startswith("4f53cda1") and got["status"] == "ok"


def test_gap_kinds(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 4, 5, 9)], "day date")
    hol = spark.createDataFrame([(date(2024, 1, 3),)], "day date")
    col = spark.createDataFrame([(date(2024, 1, 4),), (date(2024, 1, 9),)], "day date")
    got = sorted((r["day"].day, r["kind"]) for r in universe.weekday_gaps(days, hol, col).collect())
    assert got == [(5, "surveillance"), (8, "bars")]


def test_announcements_parse_and_rewrite(spark, tmp_path):
    s = spark.createDataFrame([(date(2024, 1, d), i) for i, d in enumerate((4, 5, 8))], "day date, session_ix int")
    p = tmp_path / "a.json"
    p.write_text(
        '[{"symbol":" good","an_dt":"04-Jan-2024 10:00:00","desc":"Updates","attchmntText":"' + "x" * 500 + '"},'
        '{"symbol":"GOOD","an_dt":"05-Jan-2024 22:56","desc":"Dividend"},{"symbol":"GOOD","an_dt":"soon"},{"symbol":"","an_dt":"04-Jan-2024"}]'
    )
    rows = files.read_announcements(spark, str(p), s)
    got = sorted((r["symbol"], r["visible_from"].day, r["an_dt"], len(r["text"])) for r in rows.collect())
    assert got == [("GOOD", 4, datetime(2024, 1, 4, 10), 400), ("GOOD", 8, datetime(2024, 1, 5, 22, 56), 0)]
    out = str(tmp_path / "out")
    files.store_announcements(rows, out)
    files.store_announcements(rows, out)
    assert spark.read.parquet(out).count() == 2
    # A rebuilt range loses a month that became empty; months outside the range stay.
    later = rows.withColumn("visible_from", F.add_months("visible_from", 1)).withColumn("symbol", F.lit("FEB"))
    files.store_announcements(later, out)
    files.store_announcements(later.filter("false"), out, since="2024-02", upto="2024-03")
    assert {r["symbol"] for r in spark.read.parquet(out).collect()} == {"GOOD"}


def test_xbrl_prefers_own_dates_and_first_value(spark):
    from crosstape.plans.feed_plans import XBRL

    doc = XBRL % ("2024-03-31", "2024-01-01", "2024-03-31", "2024-01-01", "2024-03-31", "2024-03-31", "100", "10")
    df = spark.createDataFrame([("p", bytearray(doc.encode())), ("broken", bytearray(b"<x"))], "path string, content binary")
    idx = spark.createDataFrame([("p", "A", date(2024, 1, 1), date(2024, 3, 31), date(2024, 5, 1))], "path string, symbol string, from_date date, quarter_end date, visible_from date")
    r = files.quarter_figures(files.xbrl_facts(df), idx).collect()
    assert len(r) == 1 and (r[0]["revenue"], r[0]["net_profit"], r[0]["expenses"], r[0]["pbt"]) == (100.0, 10.0, None, None)


def test_filing_index_and_dedup(spark):
    rows = [("A", "01-Oct-2023", "31-Dec-2023", "20-Jan-2024 20:20", "Non-Consolidated", "x"), ("A", "01-Oct-2023", "31-Dec-2023", "25-Jan-2024 20:20:21", "Consolidated", "y"),
            ("A", "01-Oct-2023", "31-Dec-2023", "30-Jan-2024", "Consolidated", "z"), ("A", None, None, "30-Jan-2024", None, "w")]
    raw = spark.createDataFrame(rows, "symbol string, fromDate string, toDate string, broadCastDate string, consolidated string, xbrl string")
    got = asof.dedup_filings(files.filing_index(raw)).collect()
    assert [(r["xbrl"], r["visible_from"]) for r in got] == [("y", date(2024, 1, 25))]


def test_ledger_appends_and_filters(spark, tmp_path):
    p = str(tmp_path / "ledger")
    ledger.append(spark.createDataFrame([("a", 1.0, None)], "variant string, cagr double, track string"), p, "b1")
    ledger.append(spark.createDataFrame([("b", 2.0, "pattern", True)], "variant string, cagr double, track string, void boolean"), p, "b2")
    assert {r["variant"] for r in ledger.read_ledger(spark, p).collect()} == {"a"}
    assert {r["variant"] for r in ledger.read_ledger(spark, p, include_void=True, limit=5).collect()} == {"a", "b"}
    assert ledger.read_ledger(spark, p, include_void=True, track="cluster").count() == 1 and ledger.read_ledger(spark, p, batch="b2", include_void=True).count() == 1
    w = spark.createDataFrame([(None,), ("main",), ("pooled",)], "portfolio string")
    assert ledger.weight_rows(w).count() == 2


# --- book -------------------------------------------------------------------------


def test_queue_skips_live_names_before_the_limit(spark):
    spans = spark.createDataFrame([("main", "YUKEN", 0, None), ("main", "OLD", 0, 1), ("main", "NEW", 1, None), ("main", "LATER", 5, 9), ("pooled", "VCL", 0, None)], "bucket string, symbol string, since int, until int")
    state = spark.createDataFrame([("main", "YUKEN", "open"), ("main", "OLD", "closed"), ("pooled", "VCL", "open")], "bucket string, symbol string, status string")
    ranked = spark.createDataFrame([("main", "YUKEN", 1, 3.0), ("main", "VCL", 1, 2.0), ("main", "OLD", 1, 1.0), ("main", "NEW", 1, 0.9), ("main", "LATER", 1, 0.8)], "bucket string, symbol string, day int, score double")
    got = [r["symbol"] for r in book.queue(ranked, spans, 4, [F.col("score").desc()]).collect()]
    # A position of the same day, or of a later one, holds nothing back yet.
    assert got == ["VCL", "OLD", "NEW", "LATER"] and book.double_live(state).count() == 0


def test_distance_has_one_sign(spark):
    r = spark.range(1).select(book.away_pct(F.lit(100.0), F.lit(90.0)).alias("s"), book.away_pct(F.lit(100.0), F.lit(120.0)).alias("t")).first()
    assert (round(r["s"], 9), round(r["t"], 9)) == (-10.0, 20.0)


def test_reconcile_moves_levels(spark):
    fills = spark.createDataFrame([("A", date(2024, 1, 5), 101.0, 90.9, 121.2, "live:x"), ("B", date(2024, 1, 5), 50.0, 45.0, 60.0, "live:x"), ("C", date(2024, 1, 5), 7.0, 6.3, 8.4, "live:x")],
                                 "symbol string, entry_day date, entry_px double, stop double, target double, fill_source string")
    off = spark.createDataFrame([("A", date(2024, 1, 5), 100.0), ("B", date(2024, 1, 5), 50.004)], "symbol string, day date, open double")
    got = {r["symbol"]: (r["entry_px"], round(r["stop"], 6), r["fill_source"]) for r in asof.reconciled(fills, off).collect()}
    assert got == {"A": (100.0, 90.0, "reconciled"), "B": (50.0, 45.0, "confirmed"), "C": (7.0, 6.3, "live:x")}


# --- streams ----------------------------------------------------------------------


def loop_events(rows, stop=10.0, target=20.0, hold=10):
    """The life cycle written as one plain loop per name."""
    out, live = [], {}
    for r in sorted(rows, key=lambda r: (r["day"], r["kind"])):
        k = (r["bucket"], r["symbol"])
        p = live.get(k)
        if r["kind"] == "order":
            if p is None:
                live[k] = {"queued": r["day"], "entry": None}
                out.append((*k, "pending", r["day"], None))
        elif p and p["entry"] is None and r["day"] > p["queued"]:
            p.update(entry=r["open"], day=r["day"], held=0)
            out.append((*k, "open", r["day"], None))
        elif p and p["entry"] is not None and r["day"] > p["day"]:
            p["held"] += 1
            why = "stop" if r["low"] <= p["entry"] * (1 - stop / 100) else "target" if r["high"] >= p["entry"] * (1 + target / 100) else "time" if p["held"] >= hold else None
            if why:
                out.append((*k, "closed", r["day"], why))
                del live[k]
    return sorted(out, key=str)


def test_position_stream_over_daily_files_matches_a_loop(spark, tmp_path):
    import json
    from datetime import timedelta

    start, rows = date(2024, 1, 1), []
    for s in range(6):
        px = 100.0
        for d in range(45):
            day = start + timedelta(days=d)
            px = round(px * (1 + (((d * 31 + s * 17) % 11) - 5) / 60), 2)
            rows.append(dict(bucket="main", symbol=f"S{s}", day=day, kind="bar", qty=None, open=px, high=px * 1.03, low=px * 0.97, close=px))
            if d % (4 + s) == 0:
                rows.append(dict(bucket="main", symbol=f"S{s}", day=day, kind="order", qty=10, open=None, high=None, low=None, close=None))
    src = tmp_path / "feed"
    src.mkdir()
    feed = spark.readStream.schema(positions.INPUT).option("maxFilesPerTrigger", 1).json(str(src))
    out, ck = str(tmp_path / "events"), str(tmp_path / "ck")
    # Two runs from one checkpoint: the second continues with open positions.
    for part in ([r for r in rows if r["day"] < start + timedelta(days=20)], [r for r in rows if r["day"] >= start + timedelta(days=20)]):
        (src / f"{part[0]['day']}.json").write_text("\n".join(json.dumps(r, default=str) for r in part))
        positions.run_available(positions.position_events(feed), out, ck)
    got = sorted([(r["bucket"], r["symbol"], r["status"], r["at"], r["exit_reason"]) for r in spark.read.schema(positions.EVENTS).parquet(out).collect()], key=str)
    assert got == loop_events(rows) and {g[4] for g in got} >= {"stop", "time"}


def test_news_is_captured_once(spark, tmp_path):
    import json

    src = tmp_path / "news"
    src.mkdir()
    item = lambda link, at, title="ABC wins order": dict(source="f", publisher="p", title=title, link=link, published="2024-01-05", captured_at=at, symbol=None, via="direct")
    (src / "1.json").write_text("\n".join(json.dumps(x) for x in [item("https://x.com/1", "2024-01-05T09:00:00Z"), item("https://x.com/1", "2024-01-05T09:05:00Z"), item("https://x.com/2", "2024-01-05T09:05:00Z", "X share price")]))
    run = lambda: positions.run_available(feeds.captured_once(feeds.news_stream(spark, str(src))), str(tmp_path / "o"), str(tmp_path / "c"))
    run()
    (src / "2.json").write_text("\n".join(json.dumps(x) for x in [item("https://x.com/1", "2024-01-05T18:00:00Z"), item("https://x.com/3", "2024-01-05T18:00:00Z")]))
    run()
    assert sorted(r["link"] for r in spark.read.schema(feeds.NEWS).parquet(str(tmp_path / "o")).collect()) == ["https://x.com/1", "https://x.com/3"]


def test_visibility_and_corrections_on_streams(spark, tmp_path):
    s = spark.createDataFrame([(date(2024, 1, d), i) for i, d in enumerate((4, 5, 8))], "day date, session_ix int")
    src = str(tmp_path / "a")
    spark.createDataFrame([("A", datetime(2024, 1, 4, 16, 0)), ("A", datetime(2024, 1, 8, 16, 0))], "symbol string, an_dt timestamp").write.parquet(src)
    vis = feeds.visible_stream(spark.readStream.schema("symbol string, an_dt timestamp").parquet(src), s)
    positions.run_available(vis, str(tmp_path / "v"), str(tmp_path / "vc"))
    assert [r["visible_from"] for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [date(2024, 1, 5)]

    bars = str(tmp_path / "b")
    spark.createDataFrame([("A", date(2024, 1, 5), 100.0)], "symbol string, day date, open double").write.parquet(bars)
    fills = spark.createDataFrame([("A", date(2024, 1, 5), 101.0, 90.9, 121.2, "live:x")], "symbol string, entry_day date, entry_px double, stop double, target double, fill_source string")
    q = feeds.correct_fills(spark.readStream.schema("symbol string, day date, open double").parquet(bars), fills, str(tmp_path / "fix"), str(tmp_path / "fc"))
    q.awaitTermination()
    assert [(r["entry_px"], r["fill_source"]) for r in spark.read.parquet(str(tmp_path / "fix")).collect()] == [(100.0, "reconciled")]


def test_a_row_out_of_order_leaves_a_record(spark, tmp_path):
    src = tmp_path / "feed"
    src.mkdir()
    feed = lambda: positions.position_events(spark.readStream.schema(positions.INPUT).json(str(src)))
    bar = '{"bucket":"main","symbol":"A","day":"2024-01-%02d","kind":"bar","open":10,"high":10,"low":10,"close":10}'
    order = '{"bucket":"main","symbol":"A","day":"2024-01-%02d","kind":"order","qty":5}'
    for n, lines in enumerate(([bar % 5], [bar % 3, order % 4, bar % 5])):
        (src / f"{n}.json").write_text("\n".join(lines))
        positions.run_available(feed(), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["at"].day, r["status"], r["exit_reason"]) for r in spark.read.schema(positions.EVENTS).parquet(str(tmp_path / "out")).collect())
    assert got == [(3, "late", "bar"), (4, "late", "order"), (4, "pending", None)]
