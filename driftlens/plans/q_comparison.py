"""Queries that hold two extractors side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison as C
from ..operators import extraction as E
from ..operators import panel as P
from ..operators import report as R
from ..operators import stats as S
from ..operators import vectors as V
from ..sources import standins as X
from .q_market import _BY_VARIABLE

_TEMPLATE = "Text: {text} Targets: {targets}"


def alpha_comparison(s, d):
    """Strict against lenient scores as predictors of the next month's return."""
    m = X.firm_months(s, d)
    p = m.select("company", "date", "mt_strict", "mt_lenient").join(P.forward_dated(m.select("company", "date", F.col("ret").alias("ret_fwd"))), ["company", "date"])
    side = lambda c: S.fama_macbeth(p.withColumnRenamed(c, "mt"), "ret_fwd", ["mt"])
    a = C.alpha_comparison(side("mt_strict"), side("mt_lenient"), ["variable"])
    v = C.verdict(F.lit(0.0), *[F.col(c) for c in ("base_alpha", "other_alpha", "base_significant", "other_significant")])
    rounded = [F.round(c, n).alias(c) for c, n in (("base_alpha", 5), ("other_alpha", 5), ("base_tstat", 3), ("other_tstat", 3), ("base_p_value", 4), ("other_p_value", 4), ("alpha_improvement", 5), ("tstat_improvement", 3))]
    return a.select("variable", *rounded, "base_significant", "other_significant", v.alias("verdict"))


def verdicts(s, d):
    o = X.read(s, d, "orders")
    x, y, k = F.col("o_totalprice") / 1000, F.col("o_custkey").cast("double"), F.col("o_orderkey")
    delta = ((k % 21) - 10) / 100.0
    return o.select("o_orderkey", C.verdict(delta, x, y, k % 3 == 0, k % 5 == 0).alias("verdict"))


def training_rows(s, d):
    part = X.read(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" sales to grow "), F.col("p_size").cast("string"), F.lit("%.")).alias("text"))
    t = E.rule_targets(part).select("p_partkey", F.lit(1).alias("pos"), "entity_label", "value_text")
    r = C.training_rows(part, t, "p_partkey", _TEMPLATE)
    return r.select("p_partkey", "answer", "prompt")


def vector_delete(s, d):
    return C.without_company(X.read(s, d, "customer").select("c_custkey", "c_mktsegment"), "BUILDING", "c_mktsegment")


def table_lines(s, d):
    c = X.read(s, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("a"), (F.count(F.lit(1)) / 8).alias("b"))
    return C.latex_table(c, "name", ["a", "b"]).select("name", "line")


def call_reports(s, d):
    """The whole flow, from similarities to flags; bounds are lower than the default, which would call all of these vectors dropped."""
    v = X.vectors(s, d)
    named = v.select("company", "q_int", "idx", F.concat(F.lit("metric "), (F.col("idx") % 97).cast("string")).alias("norm"), (F.col("idx") % 2 == 0).alias("is_financial"))
    sets = named.select("company", "q_int", "norm", "is_financial").distinct()
    r = R.run_reports(v, named, sets, 0.30, 0.15)
    return r.select("company", "q_int", "n_total", "n_dropped", "n_persistent", "n_nonfinancial", F.round("risk_score", 6).alias("risk_score"), "risk_flag")


def continuity_shares(s, d):
    c = V.continuity(V.best_matches(X.vectors(s, d)), 0.30, 0.15)
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean_sim"))


QUERIES = {
    "alpha_comparison": (alpha_comparison, f"""WITH {X.MONTHS}, f AS (SELECT company, last_day(date - INTERVAL 1 MONTH) AS date, ret AS y FROM fm), p AS (SELECT company, date, mt_strict, mt_lenient, y FROM fm JOIN f USING (company, date)),
      c AS (SELECT date, regr_slope(y, mt_strict) AS b, regr_intercept(y, mt_strict) AS a FROM p GROUP BY ALL HAVING regr_count(y, mt_strict) >= 20), e AS (SELECT date, regr_slope(y, mt_lenient) AS b, regr_intercept(y, mt_lenient) AS a FROM p GROUP BY ALL HAVING regr_count(y, mt_lenient) >= 20),
      base AS (SELECT 'base|mt' AS variable, date AS o, b AS x FROM c UNION ALL SELECT 'base|intercept', date, a FROM c UNION ALL SELECT 'other|mt', date, b FROM e UNION ALL SELECT 'other|intercept', date, a FROM e){_BY_VARIABLE},
      t AS (SELECT *, m / sqrt(greatest(var, 1e-12) / n) AS t FROM v), r AS (SELECT split_part(variable, '|', 1) AS side, split_part(variable, '|', 2) AS name, m, t, {X.p_sql("t", "(n - 1)")} AS p FROM t),
      j AS (SELECT o.name AS variable, b.m AS ba, o.m AS oa, b.t AS bt, o.t AS ot, b.p AS bp, o.p AS op, coalesce(b.p < 0.05, false) AS bs, coalesce(o.p < 0.05, false) AS os FROM r b JOIN r o ON b.name = o.name WHERE b.side = 'base' AND o.side = 'other')
      SELECT variable, round(ba, 5) AS base_alpha, round(oa, 5) AS other_alpha, round(bt, 3) AS base_tstat, round(ot, 3) AS other_tstat, round(bp, 4) AS base_p_value, round(op, 4) AS other_p_value, round(oa - ba, 5) AS alpha_improvement,
        round(ot - bt, 3) AS tstat_improvement, bs AS base_significant, os AS other_significant, CASE WHEN oa > ba AND os AND NOT bs THEN 'OTHER_BETTER' WHEN ba > oa AND bs AND NOT os THEN 'BASE_BETTER' ELSE 'SIMILAR' END AS verdict FROM j"""),
    "verdicts": (verdicts, """WITH x AS (SELECT o_orderkey, o_totalprice / 1000 AS b, o_custkey::DOUBLE AS o, o_orderkey % 3 = 0 AS bs, o_orderkey % 5 = 0 AS os, (o_orderkey % 21 - 10)::INT AS f FROM orders)
      SELECT o_orderkey, CASE WHEN o > b AND os AND NOT bs THEN 'OTHER_BETTER' WHEN b > o AND bs AND NOT os THEN 'BASE_BETTER' WHEN f > 5 THEN 'OTHER_BETTER' WHEN f < -5 THEN 'BASE_BETTER' ELSE 'SIMILAR' END AS verdict FROM x"""),
    "training_rows": (training_rows, """WITH t AS (SELECT p_partkey, p_name || ' sales to grow ' || p_size || '%.' AS text, '[{"entity_label":"PERCENT","value_text":"' || p_size || '%"}]' AS answer FROM part)
      SELECT p_partkey, answer, 'Text: ' || text || ' Targets: ' || answer AS prompt FROM t"""),
    "vector_delete": (vector_delete, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "table_lines": (table_lines, r"""SELECT o_orderpriority AS name, o_orderpriority || ' & ' || printf('%.3f', avg((o_orderstatus = 'F')::INT)) || ' & ' || printf('%.3f', count(*) / 8) || ' \\' AS line FROM orders GROUP BY o_orderpriority"""),
    "call_reports": (call_reports, f"""WITH {X.VECTORS}, named AS (SELECT company, q_int, idx, 'metric ' || idx % 97 AS norm, idx % 2 = 0 AS fin FROM v),
      calls AS (SELECT DISTINCT company, q_int FROM v), nset AS (SELECT DISTINCT company, q_int, norm, fin FROM named),
      p AS (SELECT c.company, c.q_int, s.norm, count(*) = 12 AS persistent FROM calls c JOIN nset s ON s.company = c.company AND s.q_int BETWEEN c.q_int - 12 AND c.q_int - 1 GROUP BY ALL),
      g AS (SELECT l.company, l.q_int, count(*) AS n_total, count(*) FILTER (label = 'dropped') AS n_dropped, count(*) FILTER (label = 'dropped' AND persistent) AS n_persistent, count(*) FILTER (label = 'dropped' AND NOT fin) AS n_nonfinancial
        FROM labels l JOIN named n ON n.company = l.company AND n.idx = l.hist_idx LEFT JOIN p ON p.company = l.company AND p.q_int = l.q_int AND p.norm = n.norm GROUP BY ALL),
      r AS (SELECT *, CASE WHEN n_dropped > 0 THEN least(greatest(0.5::DOUBLE * (n_dropped / n_total) + 0.3::DOUBLE * (n_persistent / n_dropped) + 0.2::DOUBLE * (n_nonfinancial / n_dropped), 0), 1) ELSE 0.0 END AS score FROM g)
      SELECT company, q_int, n_total, n_dropped, n_persistent, n_nonfinancial, round(score, 6) AS risk_score, CASE WHEN score > 0.6 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_flag FROM r"""),
    "continuity_shares": (continuity_shares, f"WITH {X.VECTORS} SELECT label, count(*) AS n, round(avg(sim), 6) AS mean_sim FROM labels GROUP BY ALL"),
}
