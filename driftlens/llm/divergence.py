"""Source divergence audit (op 12): how far each source's use of words is from the other sources of its language.

Plain relational: the terms of all texts are exploded and counted by language and
source; each language keeps the terms that ten of its documents hold; every
source gets every kept term, with a count of zero where it has none; sources are
held against each other in a self-join on language and term. All arithmetic is on
integers, with decimals where a long could overflow.

Languages are few and hot, so nothing is joined on the language alone: terms are
dealt to parts of their language by hash, and the sources are repeated for each
part. Pairs of sources are summed once and then told from either side.

Edge cases: null text, lang and source are read as ''; a row is a document, so
repeated rows count as often as they are there; texts without a term still make
their group occur; a language without kept terms has pairs of value 0 and no
terms; ties in value go by the item's bytes; an empty table gives no rows; extra
columns are not read. The words of one text are held by one task at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, kept_columns, table, written

#: What lies between terms: ASCII but for its letters. A split leaves an empty string before the first and after the last term.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that must hold a term; ranks of terms that are listed.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Parts of a language's terms, times the session's shuffle partitions.
PARTS = 8


def ascii_lower(text: Column) -> Column:
    """Only A to Z lower-cased; the plain function does that where all characters are of one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term; counted before the exchange."""
    found = docs.select("lang", "source", F.split(ascii_lower(F.col("text")), BETWEEN).alias("all"))
    # a text's terms go out twice: all of them, and each once
    both = found.select("lang", "source", F.explode(F.array(F.struct(F.col("all").alias("terms"), F.lit(1).alias("n"), F.lit(0).alias("docs")), F.struct(F.array_distinct("all").alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("docs")))).alias("x"))
    each = both.select("lang", "source", F.explode("x.terms").alias("term"), F.col("x.n").alias("n"), F.col("x.docs").alias("docs")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * kept))."""
    return F.expr(f"1L + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * {kept} as decimal(20,0))")


_GAP = "(p - q) * (p - q) div (p + q)"


def dense_shares(docs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, p, q): every source's share of every kept term of its language, and the language's own; written."""
    spark = docs.sparkSession
    counts = written(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least).drop("docs")
    kept = written(kept)
    own = written(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    dropped(counts)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    terms = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    zeros = terms.join(named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["lang", "part"])
    zeros = zeros.select("lang", "term", "source", F.lit(0).cast("long").alias("n"), "total", "v", "all_n", "lang_total")
    told = own.select("lang", "term", "source", "n", *(F.lit(None).cast("long").alias(c) for c in ("total", "v", "all_n", "lang_total")))
    each = zeros.unionByName(told).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("total", "v", "all_n", "lang_total")))
    out = written(each.select("lang", "source", "term", "n", _share("n", "total", "v").alias("p"), _share("all_n", "lang_total", "v").alias("q")))
    dropped(kept, own)
    return out


def pair_gaps(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each other source of the language and the sum of their gaps over all kept terms."""
    one = dense.select("lang", "term", "source", "p")
    two = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    once = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.expr(_GAP)).alias("value"))
    either = once.select("lang", "source", "item", "value").unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return pairs.join(either, ["lang", "source", "item"], "left").na.fill(0, ["value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources by distance, and the terms that a source uses more than its language."""
    kept_columns(docs, ("text", "lang", "source"))
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = written(docs.select("lang", "source").distinct())
    dense = dense_shares(docs, groups, least_docs)
    pairs = pair_gaps(dense, groups)
    order = "partition by lang, source order by value desc, item"
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.expr(f"row_number() over ({order})").alias("rank"))
    more = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_GAP).alias("value"))
    more = more.withColumn("rank", F.expr(f"row_number() over ({order})")).where(F.col("rank") <= top)
    return pairs.unionByName(more)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), groups as (select distinct lang, source from d),
held as (select lang, term from (select lang, unnest(list_distinct(terms)) as term from d) group by all having count(*) >= 10),
own as (
  select lang, source, term, count(*) as n
  from (select lang, source, unnest(terms) as term from d) join held using (lang, term) group by all
), kept as (select lang, term, sum(n) as all_n from own group by all),
langs as (select lang, count(*) as v, sum(all_n) as lang_total from kept group by all),
totals as (select lang, source, sum(n) as total from own group by all),
dense as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) as p,
    1 + (1000000000::hugeint * (k.all_n + 2)) // (l.lang_total + 2 * l.v) as q
  from groups g join kept k using (lang) join langs l using (lang)
  left join totals t on t.lang = g.lang and t.source = g.source
  left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), found as (
  select * from pairs union all
  select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from dense where n > 0 and p > q
), ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
