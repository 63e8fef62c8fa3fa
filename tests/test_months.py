"""Rebuilding a range of months."""

from datetime import date

from crosstape.sources.months import MonthStore

SCHEMA = "symbol string, visible_from date"


def test_a_rebuild_is_seen_whole_or_not_at_all(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([(s, date(2024, m, 5)) for s, m in rows], SCHEMA)
    store = MonthStore(spark, str(tmp_path / "t"), SCHEMA)
    seen = lambda s=store: sorted((r.symbol, r.month.month) for r in s.rows().collect())
    assert seen() == []
    store.rebuild(make(("A", 1), ("B", 2), ("C", 3)), "2024-01", "2024-03")
    for _ in range(2):
        store.rebuild(make(("D", 2), ("X", 5)), "2024-02", "2024-03")  # March has become empty, May is out of the range
        assert seen() == [("A", 1), ("D", 2)]
    # Dies before it is published: nothing changes, and the next rebuild doesn't pick its rows up.
    store.stage(make(("E", 1)), "2024-01", "2024-02")
    assert seen() == [("A", 1), ("D", 2)]
    # From its own rows.
    store.rebuild(store.rows().select("symbol", "visible_from"), "2024-01", "2024-02")
    assert seen() == [("A", 1), ("D", 2)]
    assert seen(store.compact(str(tmp_path / "u"))) == [("A", 1), ("D", 2)]
    again = MonthStore(spark, str(tmp_path / "t"), SCHEMA)
    again.rebuild(make(("F", 1)), "2024-01", "2024-01")
    assert seen() == [("D", 2), ("F", 1)]
