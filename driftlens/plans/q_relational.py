"""Queries of joins, picks, set operations and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import lenient_number
from ..operators import ordered as O
from ..operators import relational as R
from ..operators.report import cached_or
from ..sources import io as IO
from ..sources import standins as X
from ..streaming.resume import append_once, write_once


def interval_join(s, d):
    facts = X.read(s, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", F.date_add(F.to_date("o_orderdate"), 10).alias("date"))
    return R.interval_join(facts, X.history(s, d), "entity", "date", "namedt", "nameendt").select("o_orderkey", "entity", "label", "namedt")


def overlap_links(s, d):
    h = R.overlapping(X.history(s, d), "namedt", "nameendt", F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-06-30")))
    c = X.read(s, d, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return h.join(c, "entity").select("entity", "label", "c_mktsegment").distinct()


def universe(s, d):
    m = X.firm_months(s, d)
    a = m.groupBy("company").agg(F.round(F.avg("mktcap"), 6).alias("avg_mcap"), F.count(F.lit(1)).alias("n_months"), F.max_by("mktcap", "date").alias("last_mcap")).where("n_months >= 36")
    return R.top_n(a, 50, F.col("avg_mcap").desc(), F.col("company"))


def left_chain(s, d):
    o = X.read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = X.read(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    n = X.read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return o.join(c, "c_custkey", "left").join(n, "c_nationkey", "left").select("o_orderkey", "c_custkey", "n_name")


def tuple_filter(s, d):
    pairs = X.read(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.substring("c_mktsegment", 1, 1).alias("k")).distinct()
    n = X.read(s, d, "nation").select("n_nationkey", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("Z"))).alias("k"))
    return n.join(pairs, ["n_nationkey", "k"], "left_semi")


def nearest_day(s, d):
    days = X.read(s, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("company"), F.to_date("ts").alias("date")).distinct()
    return R.nearest_date(X.announcements(s, d), days, "company", "event_date", "date", 3)


def source_priority(s, d):
    a = X.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    b = X.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("v"))
    return R.by_priority([a, b], "id")


def cache_aside(s, d):
    live = X.read(s, d, "nation").where("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("v"))
    cache = X.read(s, d, "nation").where("n_nationkey >= 15").select("n_nationkey", F.concat(F.lit("cached "), "n_name").alias("v"))
    return cached_or(live, cache, ["n_nationkey"], "v")


def token_sets(s, d):
    p = X.read(s, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("a"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")).alias("b"))
    return p.select("p_partkey", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"), F.size(F.array_except("b", "a")).cast("long").alias("n_more"))


def first_appearance(s, d):
    li = X.read(s, d, "lineitem")
    return li.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"))


def missing_keys(s, d):
    urgent = X.read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return X.read(s, d, "customer").select("c_custkey").exceptAll(urgent)


def member_components(s, d):
    """Components of the conversations that somebody but an assistant speaks last in, whose ids go to the scan."""
    c = X.read(s, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("l")).where("l.role <> 'assistant'")
    found = IO.of_members(c, last, "conv_id")
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def replayed_events(s, d):
    """Events that arrive as a stream, run twice from the beginning, with a batch that is sent once more: each once."""
    path = f"{d}/events.parquet"
    out = IO.scratch(s, "events")
    events = s.read.parquet(path)
    stream = s.readStream.schema(events.schema).parquet(f"{path[:-1]}[t]")  # as a pattern, a single file can be a source too
    for run in ("first", "second"):
        append_once(stream, f"{out}/rows", f"{out}/{run}", "event_id", "ts").awaitTermination()
    write_once(f"{out}/rows", "event_id", "ts")(events.where("event_type = 'purchase'"), 1_000)
    rows = s.read.parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.round(F.sum("value"), 4).alias("total"))


def batch_union(s, d):
    o = X.read(s, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("done").alias("batch")).unionByName(o.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("open").alias("batch")))


def coverage(s, d):
    c = X.components(s, d).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ctype").alias("k"))
    q = O.exact_quantiles(c, F.col("n"), [0.25, 0.5, 0.75])
    told = c.agg(F.count(F.lit(1)).alias("n_transcripts"), F.sum("n").alias("n_components"), F.max("k").alias("max_kinds"), F.round(F.avg("n"), 6).alias("mean_n"))
    return told.crossJoin(F.broadcast(q)).select("n_transcripts", "n_components", "max_kinds", "mean_n", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def extraction_summary(s, d):
    docs = X.read(s, d, "labels").select("doc_id", "quality", "toxic")
    t = X.read(s, d, "documents").select("doc_id", "lang").join(docs, "doc_id", "left")
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled"), F.sum(F.coalesce("toxic", F.lit(0)).cast("long")).alias("n_toxic"))


def lenient_cast(s, d):
    o = X.read(s, d, "orders")
    x = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", lenient_number(x).alias("value"))


def non_empty(s, d):
    return X.components(s, d).where(F.length(F.trim("text")) > 0).groupBy("ctype").agg(F.count(F.lit(1)).alias("n")).select(F.col("ctype").cast("long").alias("ctype"), "n")


QUERIES = {
    "interval_join": (interval_join, f"WITH {X.HISTORY} SELECT o_orderkey, o_custkey AS entity, label, namedt FROM orders JOIN hist ON o_custkey = entity AND o_orderdate::DATE + 10 BETWEEN namedt AND nameendt"),
    "overlap_links": (overlap_links, f"WITH {X.HISTORY} SELECT DISTINCT entity, label, c_mktsegment FROM hist JOIN customer ON c_custkey = entity WHERE namedt <= DATE '1996-06-30' AND nameendt >= DATE '1996-01-01'"),
    "universe": (universe, f"WITH {X.MONTHS} SELECT company, round(avg(mktcap), 6) AS avg_mcap, count(*) AS n_months, max_by(mktcap, date) AS last_mcap FROM fm GROUP BY ALL HAVING count(*) >= 36 ORDER BY avg_mcap DESC, company LIMIT 50"),
    "left_chain": (left_chain, "SELECT o_orderkey, o_custkey AS c_custkey, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "tuple_filter": (tuple_filter, "SELECT n_nationkey, k FROM nation, (VALUES ('A'), ('B'), ('Z')) t(k) WHERE (n_nationkey, k) IN (SELECT (c_nationkey, left(c_mktsegment, 1)) FROM customer)"),
    "nearest_day": (nearest_day, f"WITH days AS (SELECT DISTINCT user_id AS company, ts::DATE AS date FROM events WHERE event_type = 'signup'), {X.ANNOUNCED} SELECT ev.company, event_date, arg_min(date, abs(date - event_date) * 10 + (date > event_date)::INT) AS matched_day FROM ev JOIN days d ON d.company = ev.company AND abs(date - event_date) <= 3 GROUP BY ALL"),
    "source_priority": (source_priority, "SELECT c_custkey AS id, coalesce(s_name, c_mktsegment) AS v FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)"),
    "cache_aside": (cache_aside, "SELECT n_nationkey, CASE WHEN n_nationkey >= 15 THEN 'cached ' || n_name ELSE n_name END AS v FROM nation"),
    "token_sets": (token_sets, """WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS b FROM part)
      SELECT p_partkey, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_more FROM p"""),
    "first_appearance": (first_appearance, "SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL"),
    "missing_keys": (missing_keys, "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "batch_union": (batch_union, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS batch FROM orders"),
    "coverage": (coverage, f"WITH {X.COMPONENTS}, c AS (SELECT transcript_id, count(*) AS n, count(DISTINCT ctype) AS k FROM comp GROUP BY ALL) SELECT count(*) AS n_transcripts, sum(n)::BIGINT AS n_components, max(k) AS max_kinds, round(avg(n), 6) AS mean_n, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75 FROM c"),
    "extraction_summary": (extraction_summary, "SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, sum(coalesce(toxic, 0))::BIGINT AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "member_components": (member_components, """WITH l AS (SELECT conv_id FROM conversations GROUP BY ALL HAVING arg_max(role, turn) <> 'assistant')
      SELECT conv_id, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM conversations WHERE conv_id IN (SELECT conv_id FROM l) GROUP BY ALL"""),
    "replayed_events": (replayed_events, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "lenient_cast": (lenient_cast, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::DOUBLE END AS value FROM orders"),
    "non_empty_text": (non_empty, f"WITH {X.COMPONENTS} SELECT ctype::BIGINT AS ctype, count(*) AS n FROM comp WHERE length(trim(text)) > 0 GROUP BY ALL"),
}
