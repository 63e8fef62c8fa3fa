"""Evidence of every (symbol, day), and names of more than five words."""

import datetime as dt

import pyspark.sql.functions as F

from crosstape.operators import text
from crosstape.plans import text_plans
from crosstape.plans.common import table

DAY = dt.date(2000, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_evidence_of_every_day(spark):
    master = spark.createDataFrame([("AAAA", "amber anvil"), ("BBBB", "birch basin")], "symbol string, company string")
    news = [(1, "x", day(0), "AAAA"), (2, "amber sold an anvil", day(5), None), (3, "birch basin", day(33), None), (4, "nothing", day(33), None)]
    items = spark.createDataFrame(news, "doc_id long, title string, captured_day date, tag string")
    ann = [("BBBB", day(2)), ("BBBB", day(2)), ("AAAA", day(20)), ("ZZZZ", day(20))]
    about = [("AAAA", 0), ("AAAA", 5), ("BBBB", 33)]
    got = {(r.symbol, r.day, r.captured_day) for r in text.news_evidence_days(items, master).collect()}
    assert got == {(s, day(n + k), day(n)) for s, n in about for k in range(8)}
    rows = text.evidence_bundle_days(master, items, spark.createDataFrame(ann, "symbol string, visible_from date")).collect()
    want = {}
    for s in ("AAAA", "BBBB"):
        for n in range(51):
            want[s, day(n)] = (sum(a == s and n - 7 <= m <= n for a, m in about), sum(a == s and day(n - 30) <= m <= day(n) for a, m in ann), DAY)
    assert {(r.symbol, r.day): (r.news_count, r.announcement_count, r.archive_starts) for r in rows} == want and len(rows) == len(want)


def test_names_are_whole(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.symbol: r.company for r in text_plans.name_master(spark, sf).collect()}
    assert got == {f"BNCH{r.item_id}": r.text for r in table(spark, sf, "benchmark").collect()}
    assert max(len(c.split()) for c in got.values()) > 5
    # A document of a name's sixth and later words is about it.
    late = [c for c in sorted(got.values()) if len({w for w in c.lower().split()[5:] if w.isalpha() and len(w) > 4} - set(c.lower().split()[:5])) > 4][0]
    doc = spark.createDataFrame([(1, " ".join(late.split()[5:]))], "doc_id long, text string")
    assert text.mentions(doc, text_plans.name_master(spark, sf).filter(F.col("company") == late), "doc_id", "text").count() == 1


def test_evidence_refuses_an_absurd_span_and_takes_empty_input(spark):
    import pytest

    master = spark.createDataFrame([("AAAA", "amber anvil")], "symbol string, company string")
    items = spark.createDataFrame([(1, "x", dt.date(1, 1, 1), "AAAA"), (2, "x", dt.date(9000, 1, 1), "AAAA")], "doc_id long, title string, captured_day date, tag string")
    ann = spark.createDataFrame([("AAAA", day(2))], "symbol string, visible_from date")
    with pytest.raises(Exception, match="spans over"):
        text.evidence_bundle_days(master, items, ann).collect()
    assert text.evidence_bundle_days(master, items.filter("false"), ann.filter("false")).collect() == []
    plan = text.evidence_bundle_days(master, items, ann)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
