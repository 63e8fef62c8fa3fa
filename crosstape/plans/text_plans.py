"""Text tone, channel scores, company matching and news hygiene on documents, pages and benchmark names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..operators import ranking, text
from . import oracle as o
from .common import table
from .spec import query

# Frequent invented words act as negators so that the flip rule has something to do.
NEGATORS = (*lex.NEGATORS, "the", "la", "die")


def word_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOK = "list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z\\-]+'), lambda x: lower(x))"
LEXICON = f"""lx as materialized (select unnest({word_list(lex.POSITIVE)}) as word, 1 as polarity union all select unnest({word_list(lex.NEGATIVE)}), -1)"""
NEG_LIST = word_list(NEGATORS)


def tone_sql(key: str, src: str, col: str) -> str:
    return f"""tt as materialized (select {key}, w, unnest(generate_series(1, len(w))) as i from (select {key}, {TOK.format(c=col)} as w from {src})),
th as materialized (select {key}, case when list_has_any(w[greatest(i - 3, 1):i - 1], {NEG_LIST}) and i > 1 then -polarity else polarity end as p from tt join lx on lx.word = tt.w[i]),
tone as materialized (select d.{key}, coalesce(h.pos, 0) as pos, coalesce(h.neg, 0) as neg,
  case when coalesce(h.pos, 0) + coalesce(h.neg, 0) > 0 then (h.pos - h.neg) / (h.pos + h.neg) else 0e0 end as tone
  from {src} d left join (select {key}, sum(cast(p > 0 as int)) as pos, sum(cast(p < 0 as int)) as neg from th group by 1) h using ({key}))"""


def document_tone(spark, sf):
    return text.lexicon_tone(table(spark, sf, "documents"), "doc_id", "text", negators=NEGATORS)


DOC_TONE = (LEXICON, tone_sql("doc_id", "documents", "text"))


@query("lexicon_words", "J1", "word:s polarity:i n:i", o.sql("", "with recursive " + LEXICON + f", wd as (select unnest({TOK.format(c='text')}) as word from documents) select word, polarity, count(*) as n from wd join lx using (word) group by 1, 2"))
def lexicon_words(spark, sf):
    """How often each lexicon word stands in the corpus."""
    words = table(spark, sf, "documents").select(F.explode(text.tokens("text")).alias("word"))
    counted = words.filter(F.col("word").isin(*lex.POSITIVE, *lex.NEGATIVE)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("word", F.when(F.col("word").isin(*lex.POSITIVE), 1).otherwise(-1).alias("polarity"), "n")


@query("document_tone", "J1", "doc_id:i pos:i neg:i tone:f", o.sql("", "with recursive " + ", ".join(DOC_TONE) + " select * from tone"))
def document_tone_query(spark, sf):
    return document_tone(spark, sf)


# Documents stand for filings (odd sources) and headlines (even sources) about 50 companies.
ITEMS = """itm as materialized (select d.doc_id as item_id, concat('C', lpad(cast(d.doc_id % 50 as varchar), 2, '0')) as symbol, cast(right(d.source, 1) as int) % 2 = 1 as filing,
  case d.doc_id % 5 when 0 then 1e0 when 1 then -1e0 when 2 then 0e0 end as cat, t.tone from documents d join tone t using (doc_id)),
sc as materialized (select *, case when filing then 'filing' else 'news' end as channel, case when not filing then tone
  when coalesce(cat, 0) <> 0 and tone <> 0 then greatest(-1e0, least(1e0, 0.7e0 * cat + 0.3e0 * tone)) when coalesce(cat, 0) <> 0 then cat else tone end as score from itm)"""


def scored_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(document_tone(spark, sf), "doc_id")
    cat = F.when(F.col("doc_id") % 5 == 0, 1.0).when(F.col("doc_id") % 5 == 1, -1.0).when(F.col("doc_id") % 5 == 2, 0.0)
    filing = F.substring("source", -1, 1).cast("int") % 2 == 1
    return d.select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("C"), F.lpad((F.col("doc_id") % 50).cast("string"), 2, "0")).alias("symbol"),
        F.when(filing, "filing").otherwise("news").alias("channel"), F.when(filing, text.filing_score(cat, F.col("tone"))).otherwise(F.col("tone")).alias("score"),
    )


@query("item_scores", "J2", "item_id:i symbol:s channel:s score:f", o.sql("", "with recursive " + ", ".join((*DOC_TONE, ITEMS)) + " select * from sc"))
def item_scores(spark, sf):
    return scored_items(spark, sf)


# Sums differ in the last bit with the order of addition, so both sides round to 9 digits before the half-up step.
CHAN = "case when count(nullif({s}, 0)) > 0 then floor(round(sum(nullif({s}, 0)) / (2e0 + count(nullif({s}, 0))) * 10, 9) * 100 + 0.5e0) / 100 end"
STOCKS = f"""stk as materialized (select symbol, {CHAN.format(s='a')} as announcement_score, {CHAN.format(s='n')} as news_score, count(a) as n_announcements, count(n) as n_news,
  sum(cast(score <> 0 as int)) as n_signal from (select *, case when channel = 'filing' then score end as a, case when channel = 'news' then score end as n from sc) group by symbol),
stc as materialized (select *, case when announcement_score is not null and news_score is not null then floor((0.75e0 * announcement_score + 0.25e0 * news_score) * 100 + 0.5e0) / 100
  else coalesce(announcement_score, news_score) end as composite from stk)"""


@query(
    "stock_sentiment", "J3 J4 J5", "symbol:s announcement_score:f news_score:f composite:f band:s n_announcements:i n_news:i n_signal:i place:i",
    o.sql("", "with recursive " + ", ".join((*DOC_TONE, ITEMS, STOCKS)) + """ select *, case when composite is null then 'No data' when composite >= 7 then 'Very Bullish' when composite >= 3 then 'Bullish'
       when composite > -3 then 'Neutral' when composite > -7 then 'Bearish' else 'Very Bearish' end as band, row_number() over (order by composite desc nulls last, symbol) as place from stc"""),
)
def stock_sentiment(spark, sf):
    rows = text.stock_sentiment(scored_items(spark, sf))
    return ranking.wide_ranked(rows, [], [F.col("composite").desc_nulls_last(), F.col("symbol")], "place")


@query(
    "sentiment_drivers", "J7", "symbol:s driver:i item_id:i channel:s score:f",
    o.sql("", "with recursive " + ", ".join((*DOC_TONE, ITEMS)) + " select * from (select *, row_number() over (partition by symbol order by abs(score) desc, channel, item_id) as driver from sc where score <> 0) where driver <= 4"),
)
def sentiment_drivers(spark, sf):
    return text.drivers(scored_items(spark, sf), ["symbol"])


STOP_LIST = ", ".join(f"'{w}'" for w in lex.NAME_STOP)
# A company per benchmark item, named by every word of its text; documents quote some of them.
NAMES = f"""mst as materialized (select concat('BNCH', cast(item_id as varchar)) as symbol, text as company from benchmark),
trm as materialized (select symbol, lower(symbol) as ticker, list_filter(list_distinct(string_split_regex(lower(company), '[^a-z0-9]+')), lambda w: length(w) >= 4 and w not in ({STOP_LIST}) and w <> lower(symbol)) as terms from mst),
itx as materialized (select doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) as words from documents)"""


def name_master(spark, sf):
    return table(spark, sf, "benchmark").select(F.concat(F.lit("BNCH"), F.col("item_id").cast("string")).alias("symbol"), F.col("text").alias("company"))


def named_documents(spark, sf):
    return text.mentions(table(spark, sf, "documents"), name_master(spark, sf), "doc_id", "text")


@query(
    "company_mentions", "J6", "doc_id:i symbol:s",
    o.sql("", "with recursive " + NAMES + """ select doc_id, symbol from itx, trm where list_contains(words, ticker) or (len(terms) > 0 and len(list_intersect(words, terms)) >= least(2, len(terms)))"""),
)
def company_mentions(spark, sf):
    return named_documents(spark, sf)


@query("registered_names", "J9", "symbol:s company:s",
       o.sql("", "with recursive " + NAMES + " select distinct concat('BNCH', cast(doc_id % 60 as varchar)) as symbol, coalesce(company, '') as company from documents left join mst on mst.symbol = concat('BNCH', cast(doc_id % 60 as varchar))"))
def registered_names(spark, sf):
    asked = table(spark, sf, "documents").select(F.concat(F.lit("bnch"), (F.col("doc_id") % 60).cast("string")).alias("symbol")).distinct()
    return text.registered_name(asked, name_master(spark, sf))


@query("whole_name_mentions", "J6", "doc_id:i symbol:s",
       o.sql("", "with recursive " + NAMES + " select doc_id, symbol from itx, trm where list_contains(words, ticker) or (len(terms) > 0 and len(list_intersect(words, terms)) >= least(2, len(terms)))"))
def whole_name_mentions(spark, sf):
    return text.mentions(table(spark, sf, "documents"), name_master(spark, sf), "doc_id", "text")


@query("registered_whole_names", "J9", "symbol:s company:s",
       o.sql("", "with recursive " + NAMES + " select distinct concat('BNCH', cast(doc_id % 60 as varchar)) as symbol, coalesce(company, '') as company from documents left join mst on mst.symbol = concat('BNCH', cast(doc_id % 60 as varchar))"))
def registered_name_master(spark, sf):
    asked = table(spark, sf, "documents").select(F.concat(F.lit("bnch"), (F.col("doc_id") % 60).cast("string")).alias("symbol")).distinct()
    return text.registered_name(asked, name_master(spark, sf))


# News items: every document is captured at its place in the event calendar.
def news_items(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", "source", F.col("text").alias("title"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("captured_day"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("BNCH"), (F.col("doc_id") % 40).cast("string"))).alias("tag"),
    )


NEWS = """nws as materialized (select doc_id, date '2000-01-01' + cast(doc_id % 40 as int) as captured_day, case when doc_id % 3 = 0 then concat('BNCH', cast(doc_id % 40 as varchar)) end as tag from documents),
mnt as materialized (select doc_id, symbol from itx, trm where list_contains(words, ticker) or (len(terms) > 0 and len(list_intersect(words, terms)) >= least(2, len(terms)))),
evd as materialized (select doc_id, tag as symbol, captured_day from nws where tag is not null and tag in (select symbol from mst)
  union all select n.doc_id, m.symbol, n.captured_day from nws n join mnt m using (doc_id) where n.tag is null)"""


@query("news_evidence", "H8", "symbol:s doc_id:i captured_day:d",
       o.sql("", "with recursive " + NAMES + ", " + NEWS + " select * from evd where captured_day between date '2000-01-24' and date '2000-01-31'"))
def news_evidence(spark, sf):
    return text.news_evidence(news_items(spark, sf), name_master(spark, sf), F.lit("2000-01-31").cast("date"))


@query(
    "evidence_bundle", "H9", "symbol:s news_count:i announcement_count:i archive_starts:d",
    o.sql("", "with recursive " + NAMES + ", " + NEWS + """ select m.symbol, coalesce(n.k, 0) as news_count, coalesce(a.k, 0) as announcement_count, (select min(captured_day) from nws) as archive_starts from mst m
      left join (select symbol, count(*) as k from evd where captured_day between date '2000-01-24' and date '2000-01-31' group by 1) n using (symbol)
      left join (select concat('BNCH', cast(user_id % 40 as varchar)) as symbol, count(*) as k from events where cast(ts - interval '24' year as date) between date '2000-01-01' and date '2000-01-31' group by 1) a using (symbol)"""),
)
def evidence_bundle(spark, sf):
    news, master = news_items(spark, sf), name_master(spark, sf)
    day = F.lit("2000-01-31").cast("date")
    return text.evidence_bundle(master, text.news_evidence(news, master, day), visible_events(spark, sf), day, news)


def visible_events(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("BNCH"), (F.col("user_id") % 40).cast("string")).alias("symbol"), F.to_date(F.col("ts") - F.expr("interval 24 years")).alias("visible_from")
    )


# Whole names and every day: windows end on each day of the calendar in turn.
VISIBLE = """ann as materialized (select concat('BNCH', cast(user_id % 40 as varchar)) as symbol, cast(ts - interval '24' year as date) as visible_from from events),
cal as materialized (select cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as date) as day from (
  select least((select min(captured_day) from nws), (select min(visible_from) from ann)) as lo, greatest((select max(captured_day) + 7 from nws), (select max(visible_from) + 30 from ann)) as hi))"""


@query("news_evidence_days", "H8", "symbol:s day:d doc_id:i captured_day:d",
       o.sql("", "with recursive " + ", ".join((NAMES, NEWS, VISIBLE)) + " select symbol, day, doc_id, captured_day from evd join cal on captured_day between day - 7 and day"))
def news_evidence_days(spark, sf):
    """The evidence of every (symbol, day)."""
    return text.news_evidence_days(news_items(spark, sf), name_master(spark, sf))


@query(
    "evidence_bundle_days", "H9", "symbol:s day:d news_count:i announcement_count:i archive_starts:d",
    o.sql("", "with recursive " + ", ".join((NAMES, NEWS, VISIBLE)) + """ select m.symbol, c.day, coalesce(n.k, 0) as news_count, coalesce(a.k, 0) as announcement_count, (select min(captured_day) from nws) as archive_starts from mst m cross join cal c
      left join (select symbol, day, count(*) as k from evd join cal on captured_day between day - 7 and day group by all) n on n.symbol = m.symbol and n.day = c.day
      left join (select symbol, day, count(*) as k from ann join cal on visible_from between day - 30 and day group by all) a on a.symbol = m.symbol and a.day = c.day"""),
)
def evidence_bundle_days(spark, sf):
    return text.evidence_bundle_days(name_master(spark, sf), news_items(spark, sf), visible_events(spark, sf))


PUBLISHER_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lex.PUBLISHERS.items()) + "}"
PUBLISHER_SQL = f"""with a as (select page_id, url as link, case when page_id % 7 = 0 then 'Mint on MSN' when page_id % 7 = 1 then 'www.moneycontrol.com' end as raw, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) as host from pages),
  b as (select *, trim(coalesce(url_decode(raw), raw, '')) as name from a),
  c as (select * replace (regexp_replace(regexp_replace(case when name = '' then host else name end, '^www\\.', ''), '(?i)\\.(com|in|co\\.in|net|org)$', '') as name) from b),
  d as (select * replace (trim(regexp_replace(name, '(?i)\\s+on\\s+MSN$', '')) as name) from c),
  e as (select * replace (case when name = '' then host else name end as name) from d),
  f as (select *, lower(name) as flat, list_filter(list_transform(list_sort(list_transform(string_split(lower(name), '.'), lambda p: {{'n': -length(p), 'p': p}})), lambda s: {PUBLISHER_MAP}[s.p]), lambda x: x is not null) as parts from e)
  select page_id, link, coalesce({PUBLISHER_MAP}[flat], parts[1], case {" ".join(f"when starts_with(flat, '{k}') then '{v}'" for k, v in lex.FEED_PREFIXES.items())} end, name) as publisher from f"""


@query("publishers", "J8", "page_id:i link:s publisher:s", PUBLISHER_SQL)
def publishers(spark, sf):
    p = table(spark, sf, "pages")
    wrapped = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode("url"))).otherwise(F.col("url"))
    link = text.unwrapped(wrapped)
    raw = F.when(F.col("page_id") % 7 == 0, F.lit("Mint on MSN")).when(F.col("page_id") % 7 == 1, F.lit("www.moneycontrol.com"))
    return p.select("page_id", link.alias("link")).withColumn("publisher", text.publisher(raw, F.try_parse_url("link", F.lit("HOST"))))


STORY_SQL = """select page_id, url as link from pages where not regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '(?i)/(tags?|topic|topics|quotes?|stocks?pricequote|share-price|company)/')
          and not regexp_matches(coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), '(?i)\\b(share|stock)\\s+price\\b|\\blive\\s+today\\b|\\bquarterly\\s+earnings\\b|\\bannual\\s+report\\s+analysis\\b|\\bprice\\s+live\\b|\\bstock\\s+quote\\b|\\bcompany\\s+profile\\b|\\bstock\\s+research\\s+report\\b|\\bltd\\.?\\s+[A-Z0-9]{3,}\\s*$')"""


@query("story_pages", "B6", "page_id:i link:s", STORY_SQL)
def story_pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("link"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    return text.stories(p)


@query(
    "fresh_items", "B7", "doc_id:i source:s symbol:s age:i",
    o.sql(
        "",
        """with recursive itm as materialized (select doc_id, source, case when doc_id % 3 = 0 then 'own' end as symbol, case when doc_id % 11 <> 0 then (doc_id * 7 + ascii(right(source, 1)) * 3) % 60 + (ascii(right(source, 1)) - 48) * 2 end as age from documents)
           select * from itm where symbol is not null and (age is null or age <= 30)
           union all select * from itm where symbol is null and source not in (select source from itm where symbol is null and age is not null group by source having min(age) > 7)""",
    ),
)
def fresh_items(spark, sf):
    s = F.ascii(F.substring("source", -1, 1))
    age = (F.col("doc_id") * 7 + s * 3) % 60 + (s - 48) * 2
    now = F.lit("2000-03-01").cast("date")
    d = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "own").alias("symbol"), F.when(F.col("doc_id") % 11 != 0, F.date_sub(now, age.cast("int"))).alias("published")
    )
    return text.fresh(d, now)
