"""Queries on target sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import moving_targets as M
from ..operators import report as R
from ..operators.relational import latest
from ..sources import standins as X

_W = f"WITH {X.TARGETS}"
_CMP = """, spine AS (SELECT c.* FROM calls c JOIN calls p ON c.company = p.company AND p.q_int = c.q_int - 4),
now AS (SELECT s.* FROM sets s JOIN spine USING (company, q_int)),
past AS (SELECT company, q_int + 4 AS q_int, norm, is_financial FROM sets),
cmp AS (SELECT company, q_int, norm, n.norm IS NOT NULL AS in_now, p.norm IS NOT NULL AS in_past, p.is_financial AS fin
  FROM now n FULL JOIN (SELECT past.* FROM past JOIN spine USING (company, q_int)) p USING (company, q_int, norm))"""


def _mt(s, d):
    t = X.targets(s, d)
    return M.exact_mt(M.target_sets(t), t.select("company", "q_int").distinct())


def exact_mt(s, d):
    return _mt(s, d).select("company", "q_int", "n_targets", "n_targets_tm4", "n_dropped", "n_new", F.round("mt_score", 6).alias("mt_score"))


def mt_drop_ratios(s, d):
    return _mt(s, d).select("company", "q_int", F.round("financial_drop_ratio", 6).alias("financial_drop_ratio"), F.round("nonfinancial_drop_ratio", 6).alias("nonfinancial_drop_ratio"))


def dropped_targets(s, d):
    return _mt(s, d).select("company", "q_int", F.explode("dropped_targets").alias("norm"))


def mt_summary(s, d):
    r = M.mt_summary(_mt(s, d))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("mean_mt", "median_mt", "share_positive")])


def persistence(s, d):
    p = M.persistence(M.target_sets(X.targets(s, d)), 12)
    return p.groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_window"), F.sum(F.col("persistent").cast("long")).alias("n_persistent"))


def window_retrieval(s, d):
    u = M.window_union(M.target_sets(X.targets(s, d)), 4)
    return u.groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_union"))


def substring_persistence(s, d):
    sets = M.target_sets(X.targets(s, d))
    dropped = _mt(s, d).select("company", "q_int", F.explode("dropped_targets").alias("norm"))
    p = M.substring_persistence(dropped, sets, 12)
    return p.groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_dropped"), F.sum(F.col("persistent").cast("long")).alias("n_persistent"))


def risk_flags(s, d):
    t = X.targets(s, d)
    sets = M.target_sets(t)
    c = M.compared(sets, t.select("company", "q_int").distinct()).where("in_past = 1").join(M.lasting(sets, 12), ["company", "q_int", "norm"], "left")
    drop = F.col("in_now") == 0
    n = lambda x: F.sum(F.coalesce(x.cast("long"), F.lit(0)))
    g = c.groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_total"), n(drop).alias("n_dropped"), n(drop & F.col("persistent")).alias("n_persistent"), n(drop & ~F.col("past_financial")).alias("n_other"))
    score = S.risk_score(*[F.col(x) for x in ("n_total", "n_dropped", "n_persistent", "n_other")])
    g = g.withColumn("risk_score", F.round(score, 9))
    return g.select("*", S.report_flag(F.col("risk_score")).alias("risk_flag"), S.screen_flag(F.col("risk_score")).alias("screen_flag"))


def watchlist(s, d):
    m = _mt(s, d).select("company", "q_int", F.round("mt_score", 4).alias("mt_score")).where("mt_score is not null")
    return R.watchlist(m, "q_int", "mt_score", "company", 20).withColumn("rank", F.col("rank").cast("long"))


def unique_labels(s, d):
    t = X.targets(s, d).groupBy("company", "q_int", "norm", "pos").agg(F.count(F.lit(1)).alias("n"))
    return M.unique_labels(t, ("company", "q_int"), "norm", ("pos",)).groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("label").alias("n_distinct"), F.max("label").alias("last_label"))


def canonical_dedup(s, d):
    o = X.read(s, d, "orders")
    t = o.select((F.col("o_custkey") % 50).alias("company"), T.canonical_metric(F.col("o_orderpriority")).alias("canonical_name"), F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").otherwise("medium").alias("confidence"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("numerical_value"), F.col("o_orderkey").alias("pos"))
    return M.best_by_canonical(t, ("company",)).select("company", "canonical_name", "confidence", "numerical_value", "pos", "first_pos")


def first_calls(s, d):
    c = X.components(s, d).withColumn("pos", F.col("transcript_id") * 100 + F.col("ord"))
    return M.first_transcripts(c, 10).select("transcript_id", "ord", "ctype")


def vector_upsert(s, d):
    from ..operators.vectors import upserted

    base = X.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.lit(0).cast("long").alias("pos"))
    new = X.read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("seg"), F.col("o_orderkey").alias("pos"))
    return upserted(base, new)


def resume_pending(s, d):
    done = X.read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return X.read(s, d, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


def latest_order(s, d):
    o = X.read(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return latest(o, ("o_custkey", "o_orderpriority"), ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


QUERIES = {
    "exact_mt": (exact_mt, _W + _CMP + """ SELECT company, q_int, count(*) FILTER (in_now) AS n_targets, count(*) FILTER (in_past) AS n_targets_tm4,
      count(*) FILTER (in_past AND NOT in_now) AS n_dropped, count(*) FILTER (in_now AND NOT in_past) AS n_new,
      round(count(*) FILTER (in_past AND NOT in_now) / nullif(count(*) FILTER (in_past), 0), 6) AS mt_score FROM cmp GROUP BY company, q_int"""),
    "mt_drop_ratios": (mt_drop_ratios, _W + _CMP + """ SELECT company, q_int, round(avg(fin::INT) FILTER (in_past AND NOT in_now), 6) AS financial_drop_ratio,
      round(avg(1 - fin::INT) FILTER (in_past AND NOT in_now), 6) AS nonfinancial_drop_ratio FROM cmp GROUP BY company, q_int"""),
    "dropped_targets": (dropped_targets, _W + _CMP + " SELECT company, q_int, norm FROM cmp WHERE in_past AND NOT in_now"),
    "mt_summary": (mt_summary, _W + _CMP + """, s AS (SELECT count(*) FILTER (in_past AND NOT in_now) / nullif(count(*) FILTER (in_past), 0) AS mt FROM cmp GROUP BY company, q_int)
      SELECT count(*) AS n, round(avg(mt), 6) AS mean_mt, round(quantile_cont(mt, 0.5), 6) AS median_mt, round(avg(coalesce((mt > 0)::INT, 0)), 6) AS share_positive FROM s"""),
    "persistence": (persistence, _W + """, p AS (SELECT c.company, c.q_int, s.norm, count(*) = 12 AS persistent FROM calls c JOIN sets s ON s.company = c.company AND s.q_int BETWEEN c.q_int - 12 AND c.q_int - 1 GROUP BY ALL)
      SELECT company, q_int, count(*) AS n_window, sum(persistent::INT)::BIGINT AS n_persistent FROM p GROUP BY ALL"""),
    "window_retrieval": (window_retrieval, _W + " SELECT c.company, c.q_int, count(DISTINCT s.norm) AS n_union FROM calls c JOIN sets s ON s.company = c.company AND s.q_int BETWEEN c.q_int - 4 AND c.q_int - 1 GROUP BY ALL"),
    "substring_persistence": (substring_persistence, _W + _CMP + """, dr AS (SELECT company, q_int, norm FROM cmp WHERE in_past AND NOT in_now),
      seen AS (SELECT d.company, d.q_int, d.norm, count(DISTINCT s.q_int) AS n FROM dr d JOIN sets s ON s.company = d.company AND s.q_int BETWEEN d.q_int - 12 AND d.q_int - 1 AND (contains(s.norm, d.norm) OR contains(d.norm, s.norm)) GROUP BY ALL)
      SELECT company, q_int, count(*) AS n_dropped, count(*) FILTER (n = 12) AS n_persistent FROM dr LEFT JOIN seen USING (company, q_int, norm) GROUP BY ALL"""),
    "risk_flags": (risk_flags, _W + _CMP + """, p AS (SELECT c.company, c.q_int, s.norm, count(*) = 12 AS persistent FROM calls c JOIN sets s ON s.company = c.company AND s.q_int BETWEEN c.q_int - 12 AND c.q_int - 1 GROUP BY ALL),
      g AS (SELECT company, q_int, count(*) AS n_total, count(*) FILTER (NOT in_now) AS n_dropped, count(*) FILTER (NOT in_now AND persistent) AS n_persistent, count(*) FILTER (NOT in_now AND NOT fin) AS n_other FROM cmp LEFT JOIN p USING (company, q_int, norm) WHERE in_past GROUP BY ALL),
      r AS (SELECT *, CASE WHEN n_dropped > 0 THEN round(least(greatest(0.5::DOUBLE * (n_dropped / n_total) + 0.3::DOUBLE * (n_persistent / n_dropped) + 0.2::DOUBLE * (n_other / n_dropped), 0), 1), 9) ELSE 0.0 END AS risk_score FROM g)
      SELECT *, CASE WHEN risk_score > 0.6 THEN 'HIGH' WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_flag, CASE WHEN risk_score >= 0.15 THEN 'HIGH' WHEN risk_score >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS screen_flag FROM r"""),
    "watchlist": (watchlist, _W + _CMP + """, s AS (SELECT company, q_int, round(count(*) FILTER (in_past AND NOT in_now) / nullif(count(*) FILTER (in_past), 0), 4) AS mt_score FROM cmp GROUP BY company, q_int)
      SELECT *, row_number() OVER (PARTITION BY q_int ORDER BY mt_score DESC, company) AS rank FROM s WHERE mt_score IS NOT NULL QUALIFY rank <= 20"""),
    "unique_labels": (unique_labels, _W + """, t AS (SELECT DISTINCT company, q_int, norm, pos FROM raw), l AS (SELECT *, row_number() OVER (PARTITION BY company, q_int, norm ORDER BY pos) AS rn FROM t),
      x AS (SELECT company, q_int, CASE WHEN rn > 1 THEN norm || ' (#' || rn || ')' ELSE norm END AS label FROM l)
      SELECT company, q_int, count(*) AS n_labels, count(DISTINCT label) AS n_distinct, max(label) AS last_label FROM x GROUP BY ALL"""),
    "canonical_dedup": (canonical_dedup, """WITH t AS (SELECT o_custkey % 50 AS company, trim(regexp_replace(regexp_replace(regexp_replace(lower(o_orderpriority), '-', ' ', 'g'), '[0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS canonical_name,
        CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS numerical_value, o_orderkey AS pos FROM orders)
      SELECT company, canonical_name, confidence, numerical_value, pos, min(pos) OVER (PARTITION BY company, canonical_name) AS first_pos FROM t
      QUALIFY row_number() OVER (PARTITION BY company, canonical_name ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, numerical_value IS NOT NULL DESC, pos) = 1"""),
    "first_transcripts": (first_calls, f"WITH {X.COMPONENTS}, f AS (SELECT transcript_id, min(transcript_id * 100 + ord) AS p FROM comp GROUP BY ALL ORDER BY p, transcript_id LIMIT 10) SELECT transcript_id, ord, ctype FROM comp SEMI JOIN f USING (transcript_id)"),
    "vector_upsert": (vector_upsert, """WITH n AS (SELECT o_custkey AS id, max(o_orderkey) AS pos FROM orders GROUP BY ALL), m AS (SELECT id, max(o_orderpriority) AS seg, pos FROM n JOIN orders ON o_custkey = id AND o_orderkey = pos GROUP BY ALL)
      SELECT id, seg, pos FROM m UNION ALL SELECT c_custkey, c_mktsegment, 0 FROM customer WHERE c_custkey NOT IN (SELECT id FROM m)"""),
    "resume_pending": (resume_pending, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "latest_per_group": (latest_order, "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1"),
}
