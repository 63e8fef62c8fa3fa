"""URL filter by a weighted vocabulary and host rules.

Strict terms reject a URL by one hit; soft terms by soft_limit distinct ones. An Aho-Corasick
automaton finds all terms in one pass; a hit counts where neither neighbour is a letter or
digit. Host rules come first: a rule (host, path) fits its host and all subdomains if the
URL's path starts with the rule's, the longest one decides, and the vocabulary judges the rest.

A null URL, or one without "://", has empty host and path; no rule fits it. A null or empty URL
is allowed. Each row is judged by itself, so repeated rows get equal verdicts; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary of this engine. Strict terms stand for one subject only; soft ones need company.
STRICT = ("porn", "xxx", "xnxx", "hentai", "adult", "escort", "casino", "viagra", "warez", "phishing")
SOFT = ("sex", "nude", "hot", "girls", "cam", "bet", "betting", "poker", "slots", "pills", "cheap", "free", "crack", "keygen", "torrent", "loan", "win", "bonus")
SOFT_LIMIT = 2

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as an index, or null. Longest: host first, then path."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][0]), len(rules[i][1]))):
        h, p, _ = rules[i]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(out)
    return out


def automaton(strict, soft):
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("strict", strict), ("soft", soft)):
        for w in words:
            a.add_word(w, (kind, w))
    if len(a):
        a.make_automaton()
    return a


def hits(a, url: str | None) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the URL between boundaries."""
    if not url or not len(a):
        return 0, 0
    low = url.lower()
    found = set()
    for end, (kind, word) in a.iter(low):
        lo = end - len(word)
        if not (lo >= 0 and low[lo].isalnum()) and not (end + 1 < len(low) and low[end + 1].isalnum()):
            found.add((kind, word))
    n = sum(k == "strict" for k, _ in found)
    return n, len(found) - n


def term_counts(pages: DataFrame, strict=STRICT, soft=SOFT) -> DataFrame:
    """page_id, url, strict_hits, soft_hits."""

    def run(stream):
        a = automaton(strict, soft)
        for batch in stream:
            pairs = [hits(a, u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32())], names=["page_id", "url", "strict_hits", "soft_hits"])

    return pages.mapInArrow(run, "page_id long, url string, strict_hits int, soft_hits int")


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: page_id, host, path, rule, verdict, strict_hits, soft_hits."""
    d = term_counts(pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")), strict, soft)
    host, path = host_and_path(F.col("url"))
    d = d.select("*", host.alias("host"), path.alias("path")).withColumn("fits", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("strict_hits") >= 1) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    names = F.array(*(F.lit(h + p) for h, p, _ in rules)) if rules else F.array().cast("array<string>")
    verdicts = F.array(*(F.lit(v) for *_, v in rules)) if rules else F.array().cast("array<string>")
    at = F.col("fits") + 1
    return d.select("page_id", "host", "path", F.try_element_at(names, at).alias("rule"), F.coalesce(F.try_element_at(verdicts, at), own).alias("verdict"), "strict_hits", "soft_hits")


def oracle() -> str:
    """The same rows in DuckDB SQL for the page table."""
    terms = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    count = lambda words: f"len(list_filter({terms(words)}, lambda w: regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}])' || w || '($|[^\\p{{L}}\\p{{N}}])')))::int"
    order = sorted(RULES, key=lambda r: (-len(r[0]), -len(r[1])))
    fit = lambda r: f"(host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}')"
    return f"""
with cut as (
  select page_id, url, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
parts as (
  select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, {count(STRICT)} strict_hits, {count(SOFT)} soft_hits from cut)
select page_id, host, path, case {" ".join(f"when {fit(r)} then '{r[0]}{r[1]}'" for r in order)} end as rule,
  case {" ".join(f"when {fit(r)} then '{r[2]}'" for r in order)} when strict_hits >= 1 or soft_hits >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict,
  strict_hits, soft_hits
from parts"""
