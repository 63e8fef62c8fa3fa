"""Line dedup by a log-template tree, in DataFrame functions only.

Digits are masked, then a tree of fixed depth sorts lines: by token count, then by the leading
DEPTH tokens. Each leaf's seed is its most frequent masked line. Lines that agree with the seed
in `similarity` of their positions belong to the leaf's template, whose other positions are variable
fields; any other line is its own template. A template that at least min_docs documents hold is
recurring: the first of these documents (least doc_id) keeps its lines, all others lose them.

Lines of fewer than min_tokens tokens are left alone, as are blank lines. A document that loses
nothing keeps its text as it is; null stays null. Rows with the same doc_id and text are one
document; a null doc_id comes first. Extra columns are kept by drop_recurring and ignored by
the rest. An empty table gives no rows.

Only leaves with min_docs lines or more are looked at after the first count. Recurring leaves and
templates are broadcast up to SMALL of them, so a common one deals no rows to a task of its own; beyond
that, and on lines, these are plain shuffle joins, whose hot keys Spark splits. Counts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import keep, text_key

DEPTH, MIN_TOKENS, MIN_DOCS, SIMILARITY = 3, 1, 10, 0.7
NO_ID = -(2**63)
#: Leaves (8 bytes each) or templates (32 bytes each) up to which the recurring ones are broadcast; beyond it they are joined by a shuffle.
SMALL = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def masked(text: Column) -> Column:
    """All lines at once: blanks run together and cut off at both ends of a line, digits as <*>. Done
    before the lines are taken apart, so that no filter on a line evaluates it again."""
    one = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]{2,}|[\t\r]", " "), "[0-9]+", "<*>")
    return F.trim(F.replace(F.replace(one, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def tree_lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """_id, _key, no (line number from 0), line (masked), leaf of all lines that are long enough."""
    d = docs.select("_id", "_key", F.posexplode(_lines(masked(F.col("_text")))).alias("no", "line"))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" ")))
    head = F.substring_index("line", " ", depth)
    return d.filter((F.octet_length("line") > 0) & (blanks + 1 >= min_tokens)).withColumn("leaf", F.xxhash64(blanks, head))


def recurring(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Lines of recurring templates (_id, _key, no, line, template) that are not their first document's, and the
    seeds (leaf, seed). docs: _id, _key, _text."""
    lines = tree_lines(docs, depth, min_tokens)
    full = keep(lines.select("leaf").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    near = keep(lines.join(F.broadcast(full) if full.count() <= SMALL else full, "leaf"), "tree-lines")
    distinct = near.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    seeds = distinct.groupBy("leaf").agg(F.min(F.struct((-F.col("n")).alias("m"), "line")).alias("s")).select("leaf", F.col("s.line").alias("seed"))
    own, first = F.split("line", " "), F.split("seed", " ")
    same = F.aggregate(F.zip_with(own, first, lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    placed = distinct.join(seeds, "leaf").select("leaf", "line", F.when(same >= F.size(own) * F.lit(similarity), F.concat(F.lit("leaf "), F.col("leaf").cast("string"))).otherwise(F.concat(F.lit("line "), "line")).alias("template"))
    # Names of fixed size for the joins that follow.
    placed = placed.select("leaf", F.xxhash64("line").alias("line_key"), F.xxhash64("template").alias("template"))
    held = near.withColumn("line_key", F.xxhash64("line")).join(placed, ["leaf", "line_key"]).select("_id", "_key", "no", "leaf", "line", "template")
    held = keep(held, "held-lines")
    docs_of = held.select("template", "_id", "_key").distinct()
    often = docs_of.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("_id", "_key")).alias("first")).filter(F.col("docs") >= min_docs)
    often = keep(often, "often")
    lost = held.join(F.broadcast(often) if often.count() <= SMALL else often, "template").filter((F.col("_id") != F.col("first._id")) | (F.col("_key") != F.col("first._key")))
    return lost.select("_id", "_key", "no", "leaf", "line", "template", "docs"), seeds


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """template, docs, text: recurring templates, variable fields as <*>."""
    lost, seeds = recurring(_named(docs, id_col, text_col), **params)
    lost = lost.select("template", "docs", "leaf", "line").distinct().join(seeds, "leaf")
    own, first = F.split("line", " "), F.split("seed", " ")
    alike = F.xxhash64(F.concat(F.lit("leaf "), F.col("leaf").cast("string"))) == F.col("template")
    base = F.when(alike, F.col("seed")).otherwise(F.col("line"))
    fields = lost.select("template", "docs", base.alias("base"), F.explode_outer(F.filter(F.zip_with(F.sequence(F.lit(0), F.size(own) - 1), F.arrays_zip(own.alias("a"), F.when(alike, first).otherwise(own).alias("b")), lambda i, t: F.when(t["a"] != t["b"], i)), lambda i: i.isNotNull())).alias("at"))
    vary = fields.groupBy("template", "docs", "base").agg(F.collect_set("at").alias("vary"))
    return vary.select("template", "docs", F.array_join(F.transform(F.split("base", " "), lambda t, i: F.when(F.array_contains("vary", i), "<*>").otherwise(t)), " ").alias("text"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("_id"), text_key(text).alias("_key"), text.alias("_text"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers (ascending) are given: the stretches between them, joined."""
    every = _lines(text)
    bounds = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(every))), lambda a, b: F.struct((a + 2).alias("lo"), (b - a - 1).alias("n")))
    kept = F.flatten(F.transform(F.filter(bounds, lambda s: s["n"] > 0), lambda s: F.slice(every, s["lo"], s["n"])))
    return F.array_join(kept, "\n")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "_dropped", **params) -> DataFrame:
    """docs, all columns, with the recurring lines gone from the text; and dropped_col (how many)."""
    lost, _ = recurring(_named(docs, id_col, text_col), **params)
    numbers = lost.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("no")).alias("_gone"))
    text = docs[text_col].cast("string")
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("_id"), text_key(text).alias("_key"))
    joined = keyed.join(numbers, ["_id", "_key"], "left")
    own = F.col("_row")[text_col]
    left = F.when(F.col("_gone").isNull(), own).otherwise(_without(own, F.col("_gone")))
    return joined.select(*((left if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns), F.coalesce(F.size("_gone"), F.lit(0)).alias(dropped_col))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per row: doc_id, n_lines, n_dropped, kept_sha256 of the text that is left (null: of the empty text)."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("n_lines", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)))
    d = d.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    cut = drop_recurring(d, "doc_id", "text", **params)
    return cut.select("doc_id", F.col("n_lines").cast("long"), F.col("_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def lines_sql(source: str, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> str:
    """DuckDB: common table expressions up to `gone` (doc_id, gone: line numbers from 1) over a source with doc_id, text."""
    return f"""
split_lines as (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as no from {source} where text is not null),
masked as (
  select doc_id, no, regexp_replace(trim(regexp_replace(raw, '[ \\t\\r]+', ' ', 'g'), ' '), '[0-9]+', '<*>', 'g') as line from split_lines),
tree as (
  select doc_id, no, line, string_split(line, ' ') as own, len(string_split(line, ' ')) as n_tokens, array_to_string(string_split(line, ' ')[:{depth}], ' ') as head
  from masked where line <> '' and len(string_split(line, ' ')) >= {min_tokens}),
leaves as (select n_tokens, head from tree group by all having count(*) >= {min_docs}),
near as (select t.* from tree t semi join leaves l on t.n_tokens = l.n_tokens and t.head = l.head),
counted as (select n_tokens, head, line, any_value(own) as own, count(*) as n from near group by n_tokens, head, line),
seeds as (select n_tokens, head, own as seed from counted qualify row_number() over (partition by n_tokens, head order by n desc, line) = 1),
placed as (
  select c.n_tokens, c.head, c.line,
    case when list_sum(list_transform(list_zip(c.own, s.seed), lambda p: (p[1] = p[2])::int)) >= c.n_tokens * {similarity}
      then 'leaf ' || c.n_tokens || ' ' || c.head else 'line ' || c.line end as template
  from counted c join seeds s on c.n_tokens = s.n_tokens and c.head = s.head),
held as (select n.doc_id, n.no, p.template from near n join placed p on n.n_tokens = p.n_tokens and n.head = p.head and n.line = p.line),
often as (select template, min(doc_id) as first_id from held group by template having count(distinct doc_id) >= {min_docs}),
gone as (select h.doc_id, list(distinct h.no) as gone from held h join often o on h.template = o.template and h.doc_id <> o.first_id group by h.doc_id)"""


#: The text without its recurring lines, in terms of d (documents) and g (gone).
KEPT_SQL = "case when g.gone is null then d.text else array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: not list_contains(g.gone, i)), chr(10)) end"

ORACLE = f"""
with {lines_sql("documents")}
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end::bigint as n_lines, coalesce(len(g.gone), 0)::bigint as n_dropped,
  sha256(coalesce({KEPT_SQL}, '')) as kept_sha256
from documents d left join gone g on d.doc_id = g.doc_id"""
