"""Streaming jobs over several micro-batches: queue, late rows, a growing calendar, late official prices."""

from datetime import date, datetime, timedelta

from crosstape.operators import asof
from crosstape.streaming import feeds, order_queue, positions

START = date(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


def lay(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def queue_by_hand(rows, room):
    """Day by day: ended orders leave, the best names that are not held are queued, new orders count from the next day."""
    held, out = {}, []
    for bucket in sorted({r[0] for r in rows}):
        for d in sorted({r[1] for r in rows}):
            today = [r for r in rows if r[0] == bucket and r[1] == d]
            for r in today:
                if r[2] == "ended":
                    held[bucket, r[3]] = held.get((bucket, r[3]), 0) - 1
            free = [r[3] for r in sorted((r for r in today if r[2] == "candidate"), key=lambda r: r[4]) if held.get((bucket, r[3]), 0) <= 0]
            out += [(bucket, d, s, i + 1) for i, s in enumerate(free[:room])]
            for r in today:
                if r[2] == "live":
                    held[bucket, r[3]] = held.get((bucket, r[3]), 0) + 1
    return sorted(out)


def test_queue_skips_held_names_before_it_counts(spark, tmp_path):
    rows = []
    for bucket in ("main", "pooled"):
        for d in range(12):
            rows += [(bucket, day(d), "candidate", f"S{(d * 3 + k) % 8}", k) for k in range(5)]
        rows += [(bucket, day(1), "live", "S3", None), (bucket, day(6), "ended", "S3", None), (bucket, day(2), "live", "S7", None)]
    # Two orders of one name overlap: it is held until both have ended.
    rows += [("main", day(2), "live", "S1", None), ("main", day(4), "live", "S1", None), ("main", day(5), "ended", "S1", None), ("main", day(9), "ended", "S1", None)]
    want = queue_by_hand(rows, 2)
    path = str(tmp_path / "feed")
    # A day's rows come in two batches, and bucket by bucket.
    lay(spark, path, [r for r in rows if r[1] < day(4)], order_queue.INPUT)
    lay(spark, path, [r for r in rows if r[1] == day(4) and r[0] == "main"], order_queue.INPUT)
    lay(spark, path, [r for r in rows if (r[1] == day(4) and r[0] != "main") or day(4) < r[1] < day(9)], order_queue.INPUT)
    lay(spark, path, [r for r in rows if r[1] >= day(9)], order_queue.INPUT)
    feed = spark.readStream.schema(order_queue.INPUT).option("maxFilesPerTrigger", 1).parquet(path)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    positions.run_available(order_queue.queued_orders(feed, 2), out, ck)
    read = lambda: sorted(map(tuple, spark.read.schema(order_queue.QUEUED).parquet(out).collect()))
    # Days that the watermark has not passed are not given out yet; a later run goes on from the checkpoint.
    assert read() == [r for r in want if r[1] < day(11)]
    lay(spark, path, [("main", day(30), "clock", "", None)], order_queue.INPUT)
    positions.run_available(order_queue.queued_orders(feed, 2), out, ck)
    assert read() == want


def test_burst_counts_keep_a_row_within_the_delay_and_drop_a_later_one(spark, tmp_path):
    path, schema = str(tmp_path / "feed"), "symbol string, visible_from date"
    lay(spark, path, [("A", day(0)), ("A", day(3)), ("B", day(3))], schema)
    lay(spark, path, [("A", day(60))], schema)
    # Rows are held against the watermark one batch behind.
    lay(spark, path, [("B", day(60))], schema)
    # It stands at day 59: windows that end up to then are closed. Day 40 is late but lies in windows still open,
    # day 1 lies in none.
    lay(spark, path, [("A", day(40)), ("A", day(1)), ("B", day(61))], schema)
    lay(spark, path, [("clock", day(200))], schema)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    positions.run_available(feeds.burst_counts(feed), out, str(tmp_path / "ck"))
    got = {(r.window_start, r.symbol): r.n for r in spark.read.schema("window_start date, symbol string, n long").parquet(out).collect() if r.symbol != "clock"}
    want = {}
    for symbol, d in (("A", 0), ("A", 3), ("B", 3), ("A", 60), ("B", 60), ("B", 61)):
        for k in range(30):
            want[day(d - k), symbol] = want.get((day(d - k), symbol), 0) + 1
    for k in range(30):
        if 40 - k + 30 > 59:  # the window's end
            want[day(40 - k), "A"] = want.get((day(40 - k), "A"), 0) + 1
    assert got == want


def test_rows_wait_for_their_session(spark, tmp_path):
    path, calendar, out = (str(tmp_path / p) for p in ("feed", "calendar", "out"))
    schema = "symbol string, an_dt timestamp"
    news = [[("A", datetime(2024, 1, 1, 10)), ("B", datetime(2024, 1, 2, 16))], [("C", datetime(2024, 1, 3, 9))], [("D", datetime(2024, 1, 9, 20))]]
    known = [[day(0), day(1)], [day(2)], [day(7), day(8)]]
    for rows, days in zip(news, known, strict=True):
        lay(spark, path, rows, schema)
        lay(spark, calendar, [(d,) for d in days], "day date")
        feeds.visible_by_calendar(spark.readStream.schema(schema).parquet(path), calendar, out, str(tmp_path / "ck"))
    all_days = spark.createDataFrame([(d,) for days in known for d in days], "day date")
    want = sorted(map(tuple, asof.with_visibility(spark.createDataFrame([r for rows in news for r in rows], schema), all_days).select("symbol", "visible_from").collect()))
    seen = spark.read.schema(schema + ", visible_from date").parquet(f"{out}/visible")
    assert sorted(map(tuple, seen.select("symbol", "visible_from").collect())) == want == [("A", day(0)), ("B", day(2)), ("C", day(2))]
    # D still waits.
    assert [r.symbol for r in spark.read.schema(schema).parquet(f"{out}/waiting/batch=2").collect()] == ["D"]


def test_corrections_are_stored_once(spark, tmp_path):
    fills = spark.createDataFrame(
        [("a", "A", day(1), 101.0, 90.9, 121.2, "live"), ("b", "B", day(1), 50.0, 45.0, 60.0, "live"), ("c", "C", day(9), 10.0, 9.0, 12.0, "live")],
        "id string, symbol string, entry_day date, entry_px double, stop double, target double, fill_source string",
    )
    path, schema = str(tmp_path / "official"), "symbol string, day date, open double"
    lay(spark, path, [("A", day(1), 100.0)], schema)
    lay(spark, path, [("B", day(1), 50.001), ("A", day(2), 7.0)], schema)
    for run in ("x", "y"):
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        feeds.correct_fills(feed, fills, str(tmp_path / "fix"), str(tmp_path / run)).awaitTermination()
    got = {r.id: (r.entry_px, r.fill_source, r.was) for r in feeds.corrected_state(fills, str(tmp_path / "fix")).collect()}
    assert got == {"a": (100.0, "reconciled", 101.0), "b": (50.0, "confirmed", 50.0), "c": (10.0, "live", 10.0)}
    assert spark.read.parquet(str(tmp_path / "fix")).count() == 2


def test_rows_are_laid_down_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(day(k), k) for k in (5, 0, 19, 3, 18, 11)], "day date, k int")
    assert feeds.write_in_order(rows, str(tmp_path / "f"), 4) == 4
    files = sorted((p.stat().st_mtime_ns, str(p)) for p in (tmp_path / "f").glob("part-*.parquet"))
    ks = [sorted(r.k for r in spark.read.parquet(p).collect()) for _, p in files]
    assert [k for k in ks if k] == [[0, 3], [5], [11], [18, 19]]
    assert feeds.write_in_order(rows.filter("false"), str(tmp_path / "g"), 4) == 0
