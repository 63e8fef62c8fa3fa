"""Tone of text, channel scores, company matching and publisher names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from . import asof

TOKEN = r"([A-Za-z][A-Za-z\-]+)"
NEGATION_WINDOW = 3
PRIOR = 2.0


def tokens(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), F.lower)


def lexicon_table(spark, positive=lex.POSITIVE, negative=lex.NEGATIVE) -> DataFrame:
    rows = [(w, 1) for w in positive] + [(w, -1) for w in negative]
    return spark.createDataFrame(rows, "word string, polarity int")


def text_tone(docs: DataFrame, key: str, text: str, lexicon: DataFrame, negators=lex.NEGATORS) -> DataFrame:
    """(pos - neg) / (pos + neg) per document; a negator in the 3 words before a hit flips it.

    Words are exploded and met by the lexicon in one equality join, then summed
    per document with map-side combine; a document is never rebuilt in one place.
    """
    marked = F.transform(
        "_w",
        lambda w, i: F.struct(
            w.alias("word"),
            F.exists(
                F.slice(F.col("_w"), F.greatest(i - NEGATION_WINDOW + 1, F.lit(1)), F.least(i, F.lit(NEGATION_WINDOW))),
                lambda p: p.isin(*negators),
            ).alias("neg"),
        ),
    )
    hits = (
        docs.select(key, tokens(text).alias("_w")).select(key, F.explode(marked).alias("_m"))
        .select(key, "_m.word", "_m.neg").join(lexicon, "word")
        .withColumn("_p", F.when(F.col("neg"), -F.col("polarity")).otherwise(F.col("polarity")))
        .groupBy(key).agg(
            F.sum(F.when(F.col("_p") > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("_p") < 0, 1).otherwise(0)).alias("neg")
        )
    )
    out = docs.select(key).join(hits, key, "left").fillna(0, ["pos", "neg"])
    n = F.col("pos") + F.col("neg")
    return out.withColumn("tone", F.when(n > 0, (F.col("pos") - F.col("neg")) / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)))


def lexicon_tone(docs: DataFrame, key: str, text: str, positive=lex.POSITIVE, negative=lex.NEGATIVE, negators=lex.NEGATORS) -> DataFrame:
    """As text_tone for word lists that are fixed: one projection over each document's own tokens, no shuffle."""
    flipped = lambda i: F.exists(
        F.slice(F.col("_w"), F.greatest(i - NEGATION_WINDOW + 1, F.lit(1)), F.least(i, F.lit(NEGATION_WINDOW))), lambda p: p.isin(*negators)
    )
    signed = F.transform("_w", lambda w, i: F.when(w.isin(*positive), F.when(flipped(i), -1).otherwise(1)).when(w.isin(*negative), F.when(flipped(i), 1).otherwise(-1)))
    count = lambda s: F.size(F.filter("_p", lambda p: p == s)).cast("long")
    out = docs.select(key, tokens(text).alias("_w")).select(key, signed.alias("_p")).select(key, count(1).alias("pos"), count(-1).alias("neg"))
    n = F.col("pos") + F.col("neg")
    return out.withColumn("tone", F.when(n > 0, (F.col("pos") - F.col("neg")) / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)))


def filing_score(category_tone: Column, text_score: Column) -> Column:
    """Category leads and text adjusts; alone, whichever speaks."""
    cat, txt = F.coalesce(category_tone, F.lit(0.0)), F.coalesce(text_score, F.lit(0.0))
    both = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.7 * cat + 0.3 * txt))
    return F.when((cat != 0) & (txt != 0), both).when(cat != 0, cat).otherwise(txt)


def half_up(x: Column, digits: int = 2) -> Column:
    k = float(10**digits)
    # The inner rounding absorbs differences in summation order before the tie rule.
    return F.floor(F.round(x, 9) * k + 0.5) / k


def channel_score(score: str) -> Column:
    """Sum of the signals over (2 + how many), on a -10..10 scale; NULL when nothing signals."""
    s = F.when(F.col(score) != 0, F.col(score))
    return F.when(F.count(s) > 0, half_up(F.sum(s) / (PRIOR + F.count(s)) * 10))


def band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "No data").when(score >= 7, "Very Bullish").when(score >= 3, "Bullish")
        .when(score > -3, "Neutral").when(score > -7, "Bearish").otherwise("Very Bearish")
    )


def composite(ann: Column, news: Column) -> Column:
    return F.when(ann.isNotNull() & news.isNotNull(), half_up(0.75 * ann + 0.25 * news)).otherwise(F.coalesce(ann, news))


def stock_sentiment(items: DataFrame) -> DataFrame:
    """Per symbol: channel scores, composite, band and counts from scored items (channel, score)."""
    is_ann = F.col("channel") == "filing"
    rows = items.withColumn("_a", F.when(is_ann, F.col("score"))).withColumn("_n", F.when(~is_ann, F.col("score")))
    out = rows.groupBy("symbol").agg(
        channel_score("_a").alias("announcement_score"), channel_score("_n").alias("news_score"),
        F.count("_a").alias("n_announcements"), F.count("_n").alias("n_news"),
        F.sum(F.when(F.col("score") != 0, 1).otherwise(0)).alias("n_signal"),
    )
    out = out.withColumn("composite", composite(F.col("announcement_score"), F.col("news_score")))
    return out.withColumn("band", band(F.col("composite")))


def drivers(items: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """The n items with the strongest score per key; the limit applies before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.abs("score").desc(), "channel", "item_id")
    return items.filter(F.col("score") != 0).withColumn("driver", F.row_number().over(w)).filter(F.col("driver") <= n)


def name_terms(master: DataFrame) -> DataFrame:
    """(symbol, ticker, terms): name words of four letters or more that are not stop words."""
    words = F.array_distinct(F.split(F.lower("company"), r"[^a-z0-9]+"))
    ticker = F.when(F.length("symbol") >= 4, F.lower("symbol"))
    terms = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*lex.NAME_STOP))
    rows = master.select("symbol", ticker.alias("ticker"), terms.alias("terms"))
    # A word equal to the ticker is the ticker, not a second piece of evidence.
    return rows.withColumn("terms", F.when(F.col("ticker").isNotNull(), F.array_remove("terms", F.col("ticker"))).otherwise(F.col("terms")))


def mentions(items: DataFrame, master: DataFrame, key: str, text: str) -> DataFrame:
    """(item, symbol) pairs plausibly about the company: its ticker, or two distinct name words.

    An inverted index with an exact prefix rule: a company with two or more words
    must match at least one besides its commonest, so the commonest (shared by
    many companies) is never joined on. Where only one such word matched, the
    commonest is looked up for that item alone.
    """
    terms = name_terms(master)
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+")
    each = items.select(key, F.explode(F.array_distinct(words)).alias("word"))
    flat = terms.select("symbol", F.size("terms").alias("n_terms"), F.explode("terms").alias("word"))
    freq = flat.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("symbol").orderBy(F.col("df").desc(), "word")
    ranked = flat.join(freq, "word").withColumn("_k", F.row_number().over(order)).withColumn("common", F.first("word").over(order))
    several = F.col("n_terms") > 1
    names = ranked.filter(~several | (F.col("_k") > 1)).select(
        "word", "symbol", F.when(several, 2).otherwise(1).alias("need"), F.when(several, F.col("common")).alias("common")
    )
    tickers = terms.filter(F.col("ticker").isNotNull()).select(F.col("ticker").alias("word"), "symbol", F.lit(1).alias("need"), F.lit(None).cast("string").alias("common"))
    hits = (
        each.join(names.unionByName(tickers), "word").groupBy(key, "symbol", "need", "common").agg(F.countDistinct("word").alias("n"))
    )
    sure = hits.filter(F.col("n") >= F.col("need")).select(key, "symbol")
    asked = hits.filter(F.col("n") < F.col("need")).select(key, "symbol", F.col("common").alias("word"))
    found = asked.join(each, [key, "word"], "left_semi").select(key, "symbol")
    return sure.unionByName(found).distinct()


def unwrapped(link: Column) -> Column:
    """The publisher's own address behind a search redirect."""
    host, path = F.try_parse_url(link, F.lit("HOST")), F.try_parse_url(link, F.lit("PATH"))
    target = F.try_url_decode(F.try_parse_url(link, F.lit("QUERY"), F.lit("url")))
    redirect = host.contains("bing.com") & path.contains("apiclick")
    return F.when(redirect & target.startswith("http"), target).otherwise(link)


def publisher(raw: Column, host: Column) -> Column:
    """One spelling per publisher: strip site decoration, then the alias table, then feed keys."""
    name = F.trim(F.coalesce(F.try_url_decode(raw), raw, F.lit("")))
    name = F.when(name == "", host).otherwise(name)
    name = F.regexp_replace(name, r"^www\.", "")
    name = F.regexp_replace(name, r"(?i)\.(com|in|co\.in|net|org)$", "")
    name = F.trim(F.regexp_replace(name, r"(?i)\s+on\s+MSN$", ""))
    name = F.when(name == "", host).otherwise(name)
    flat = F.lower(name)
    alias = F.create_map(*[F.lit(x) for kv in lex.PUBLISHERS.items() for x in kv])
    # Parts of a multi-part host, longest first; the alias table is a small literal.
    parts = F.transform(F.split(flat, r"\."), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))
    part = F.get(F.filter(F.transform(F.array_sort(parts), lambda s: F.try_element_at(alias, s["p"])), lambda x: x.isNotNull()), F.lit(0))
    feed = None
    for prefix, canon in lex.FEED_PREFIXES.items():
        feed = F.when(flat.startswith(prefix), canon) if feed is None else feed.when(flat.startswith(prefix), canon)
    return F.coalesce(F.try_element_at(alias, flat), part, feed, name)


def stories(items: DataFrame) -> DataFrame:
    """Drop tag, quote and profile pages by path and by title."""
    path = F.coalesce(F.try_parse_url(F.col("link"), F.lit("PATH")), F.lit(""))
    return items.filter(~path.rlike(lex.NOT_STORY_PATH) & ~F.col("title").rlike(lex.NOT_STORY_TITLE))


def fresh(items: DataFrame, now: Column, item_days: int = 30, feed_days: int = 7) -> DataFrame:
    """Old per-company items go; a general feed whose newest item is old goes whole.

    Items without a readable date stay. The feed's youngest age is aggregated
    first, so a feed of any size is never gathered in one place.
    """
    aged = items.withColumn("age", F.datediff(now, F.col("published")))
    own = aged.filter(F.col("symbol").isNotNull()).filter(F.col("age").isNull() | (F.col("age") <= item_days))
    feed = aged.filter(F.col("symbol").isNull())
    dead = feed.groupBy("source").agg(F.min("age").alias("_y")).filter(F.col("_y") > feed_days).select("source")
    return own.unionByName(feed.join(dead, "source", "left_anti"))


def registered_name(asked: DataFrame, master: DataFrame) -> DataFrame:
    """Registered name per asked symbol from the newest master; empty text when it has none."""
    names = master.select(F.upper("symbol").alias("symbol"), "company")
    return asked.select(F.upper("symbol").alias("symbol")).join(names, "symbol", "left").withColumn("company", F.coalesce("company", F.lit("")))


def news_evidence(items: DataFrame, master: DataFrame, day: Column, window: int = 7) -> DataFrame:
    """Items captured in the ``window`` days up to ``day``: an exact tag settles it, else the name rule.

    Items carry doc_id, title, captured_day and tag (the symbol whose own query found them).
    """
    return attributed(items.filter(F.col("captured_day").between(F.date_sub(day, window), day)), master)


def attributed(items: DataFrame, master: DataFrame) -> DataFrame:
    """(symbol, doc_id, captured_day): an exact tag settles whom an item is about, else the name rule."""
    listed = master.select(F.upper("symbol").alias("_u"), "symbol")
    tagged = items.filter(F.col("tag").isNotNull()).withColumn("_u", F.upper("tag")).join(listed, "_u").select("symbol", "doc_id", "captured_day")
    general = items.filter(F.col("tag").isNull())
    named = mentions(general, master, "doc_id", "title").join(general.select("doc_id", "captured_day"), "doc_id")
    return tagged.unionByName(named.select("symbol", "doc_id", "captured_day"))


def _covered(first: str, window: int) -> Column:
    """The days whose window of ``window`` days back holds this one."""
    return F.explode(F.sequence(F.col(first), F.date_add(first, window))).alias("day")


def news_evidence_days(items: DataFrame, master: DataFrame, window: int = 7) -> DataFrame:
    """news_evidence for every (symbol, day) that has any."""
    return attributed(items, master).select("symbol", _covered("captured_day", window), "doc_id", "captured_day")


def _steps(rows: DataFrame, first: str, window: int, name: str) -> DataFrame:
    """How a symbol's count changes: up by a day's items on that day, down again when the window has left them."""
    per_day = rows.filter(F.col(first).isNotNull()).groupBy("symbol", first).agg(F.count(F.lit(1)).alias("_n"))
    up = F.struct(F.col(first).alias("day"), F.col("_n").alias(name))
    down = F.struct(F.date_add(first, window + 1).alias("day"), (-F.col("_n")).alias(name))
    return per_day.select("symbol", F.explode(F.array(up, down)).alias("_s")).select("symbol", "_s.*")


def evidence_bundle_days(master: DataFrame, items: DataFrame, announcements: DataFrame, window: int = 7, ann_window: int = 30) -> DataFrame:
    """evidence_bundle for every company and every day from the first item or announcement to the last that a window reaches.

    Counts are running sums of changes: two rows per symbol and day with items, however long the window. One window per
    symbol, whose rows are bounded by the calendar; a span of days beyond ``asof.MOST_DAYS`` is refused.
    """
    steps = _steps(attributed(items, master), "captured_day", window, "_news").unionByName(_steps(announcements, "visible_from", ann_window, "_ann"), allowMissingColumns=True)
    seen = items.agg(F.min("captured_day").alias("starts"), F.max("captured_day").alias("_last"))
    told = announcements.agg(F.min("visible_from").alias("_from"), F.max("visible_from").alias("_to"))
    starts = seen.select("starts").scalar()
    lo = F.least(starts, told.select("_from").scalar())
    hi = F.greatest(F.date_add(seen.select("_last").scalar(), window), F.date_add(told.select("_to").scalar(), ann_window))
    days = F.when(F.datediff(hi, lo) <= asof.MOST_DAYS, F.sequence(lo, hi)).when(lo.isNotNull() & hi.isNotNull(), F.raise_error(F.lit(f"evidence spans over {asof.MOST_DAYS} days")).cast("array<date>"))
    grid = master.select("symbol", F.explode(days).alias("day"), F.lit(True).alias("_asked"))
    per_day = steps.unionByName(grid, allowMissingColumns=True).groupBy("symbol", "day").agg(F.sum("_news").alias("_news"), F.sum("_ann").alias("_ann"), F.max("_asked").alias("_asked"))
    upto = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    rows = per_day.select("symbol", "day", "_asked", total("_news").alias("news_count"), total("_ann").alias("announcement_count")).filter("_asked")
    return rows.select("symbol", "day", "news_count", "announcement_count", starts.alias("archive_starts"))


def evidence_bundle(master: DataFrame, news: DataFrame, announcements: DataFrame, day: Column, archive: DataFrame, ann_window: int = 30) -> DataFrame:
    """Counts of what was visible per company, and when the news archive starts."""
    n = news.groupBy("symbol").agg(F.count(F.lit(1)).alias("news_count"))
    a = announcements.filter(F.col("visible_from").between(F.date_sub(day, ann_window), day)).groupBy("symbol").agg(F.count(F.lit(1)).alias("announcement_count"))
    out = master.select("symbol").join(n, "symbol", "left").join(a, "symbol", "left").fillna(0, ["news_count", "announcement_count"])
    return out.withColumn("archive_starts", archive.agg(F.min("captured_day")).scalar())
