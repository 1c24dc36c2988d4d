"""Queries of panels, portfolios and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import stats as S
from ..sources import standins as X

_M = f"WITH {X.MONTHS}"


def momentum(s, d):
    return P.momentum(X.firm_months(s, d)).select("company", "date", F.round("ret_1_0", 6).alias("ret_1_0"), F.round("ret_12_2", 5).alias("ret_12_2"))


def forward_returns(s, d):
    return P.forward_dated(X.firm_months(s, d)).select("company", "date", F.round("ret", 6).alias("ret_fwd"))


def _panel(s, d):
    """Scores with the next month's return, size and momentum, winsorised by month."""
    m = X.firm_months(s, d)
    fwd = P.forward_dated(m.select("company", "date", F.col("ret").alias("ret_fwd")))
    base = P.momentum(m.select("company", "date", "ret", "mt_strict", "mt_lenient", "mktcap_lag"))
    out = base.join(fwd, ["company", "date"]).withColumn("size", F.when(F.col("mktcap_lag").isNotNull(), F.ln(F.greatest("mktcap_lag", F.lit(1.0)))))
    return P.winsorised(out, ["ret_fwd", "size"])


def panel(s, d):
    return _panel(s, d).select("company", "date", F.round("ret_fwd", 6).alias("ret_fwd"), F.round("size", 6).alias("size"), F.round("ret_1_0", 6).alias("ret_1_0"), F.round("mt_strict", 6).alias("mt_strict"))


def _quintiles(s, d):
    return P.quantiles(X.firm_months(s, d), "mt_strict")


def quintiles(s, d):
    return _quintiles(s, d).select("company", "date", F.col("quintile").cast("long").alias("quintile"))


def sample_quintiles(s, d):
    return P.quantiles(X.firm_months(s, d), "mt_strict", by=None).groupBy(F.col("quintile").cast("long").alias("quintile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mt_strict"), 6).alias("mean_x"))


def portfolio_returns(s, d):
    p = P.portfolio_returns(_quintiles(s, d))
    return p.select("date", *[F.round(f"Q{i}", 5).alias(f"Q{i}") for i in range(1, 6)])


def equal_weighted(s, d):
    p = P.portfolio_returns(_quintiles(s, d), weight=None)
    return p.select("date", *[F.round(f"Q{i}", 5).alias(f"Q{i}") for i in range(1, 6)])


def long_short(s, d):
    x = P.long_short(P.portfolio_returns(_quintiles(s, d)).orderBy("date"))
    return x.select("date", F.round("LS", 5).alias("LS"), F.round(F.ln(F.abs(1 + F.col("LS_cum"))), 4).alias("log_path"), (F.col("LS_cum") < -1).alias("below"))


def portfolio_stats(s, d):
    p = P.portfolio_returns(_quintiles(s, d))
    return P.portfolio_stats(p, [f"Q{i}" for i in range(1, 6)]).select("portfolio", *[F.round(c, 4).alias(c) for c in ("mean_return", "std", "sharpe", "min_return", "max_return")], "n_obs")


def signal_agreement(s, d):
    a = S.signal_agreement(X.firm_months(s, d), "mt_strict", "mt_lenient")
    return a.select("n", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "mean_a", "mean_b", "sd_a", "sd_b")])


def cross_sections(s, d):
    c = S.cross_sectional(_panel(s, d), "ret_fwd", ["mt_strict"])
    return c.select("date", "variable", F.round("coef", 5).alias("coef"), "n")


def newey_west(s, d):
    m = X.firm_months(s, d).groupBy("date").agg(F.round(F.avg("ret"), 9).alias("r"))
    return S.newey_west(m, "r", "date", 6).select(F.round("mean_coef", 6).alias("mean_coef"), F.round("nw_se", 6).alias("nw_se"), "n_periods", F.round("nw_tstat", 5).alias("nw_tstat"))


def fama_macbeth(s, d):
    f = S.fama_macbeth(_panel(s, d), "ret_fwd", ["mt_strict"])
    return f.select("variable", F.round("mean_coef", 5).alias("mean_coef"), F.round("nw_se", 5).alias("nw_se"), F.round("nw_tstat", 4).alias("nw_tstat"), "n_periods", F.round("p_value", 5).alias("p_value"))


def full_analysis(s, d):
    """Univariate, with controls, and lenient with controls."""
    a = S.full_analysis(_panel(s, d), "ret_fwd", "mt_strict", "mt_lenient", ["size", "ret_1_0"])
    return a.select("spec", "variable", F.round("mean_coef", 5).alias("mean_coef"), F.round("nw_se", 5).alias("nw_se"), F.round("nw_tstat", 3).alias("nw_tstat"), "n_periods", F.round("p_value", 4).alias("p_value"))


_PANEL = _M + """, b AS (SELECT company, date, mt_strict, mt_lenient, lag(ret) OVER w AS ret_1_0, CASE WHEN mktcap_lag IS NOT NULL THEN ln(greatest(mktcap_lag, 1.0)) END AS size FROM fm WINDOW w AS (PARTITION BY company ORDER BY date)),
f AS (SELECT company, last_day(date - INTERVAL 1 MONTH) AS date, ret AS ret_fwd FROM fm), j AS (SELECT * FROM b JOIN f USING (company, date)),
qs AS (SELECT date, quantile_cont(ret_fwd, 0.01) AS rl, quantile_cont(ret_fwd, 0.99) AS rh, quantile_cont(size, 0.01) AS sl, quantile_cont(size, 0.99) AS sh FROM j GROUP BY ALL),
panel AS (SELECT company, date, CASE WHEN ret_fwd IS NOT NULL THEN least(greatest(ret_fwd, rl), rh) END AS ret_fwd, CASE WHEN size IS NOT NULL THEN least(greatest(size, sl), sh) END AS size, ret_1_0, mt_strict, mt_lenient FROM j JOIN qs USING (date))"""
_Q = _M + """, ed AS (SELECT date, list_distinct([quantile_cont(mt_strict, 0.0), quantile_cont(mt_strict, 0.2), quantile_cont(mt_strict, 0.4), quantile_cont(mt_strict, 0.6000000000000001::DOUBLE), quantile_cont(mt_strict, 0.8), quantile_cont(mt_strict, 1.0)]) AS e, count(mt_strict) AS n FROM fm GROUP BY ALL),
qt AS (SELECT fm.*, CASE WHEN n >= 5 AND len(e) >= 2 THEN len(list_filter(list_sort(e)[2:len(e) - 1], lambda v: v < mt_strict)) + 1 END AS quintile FROM fm JOIN ed USING (date))"""
_PF = _Q + """, pf AS (SELECT date, quintile, CASE WHEN count(ret) >= 5 THEN CASE WHEN sum(greatest(mktcap, 0)) > 0 THEN sum(ret * greatest(mktcap, 0)) / sum(greatest(mktcap, 0)) ELSE avg(ret) END END AS r, CASE WHEN count(ret) >= 5 THEN avg(ret) END AS ew FROM qt WHERE quintile IS NOT NULL AND ret IS NOT NULL GROUP BY ALL)"""
_PIVOT = ", ".join(f"max(round({{}}, 5)) FILTER (quintile = {i}) AS Q{i}" for i in range(1, 6))
_NW = """, d AS (SELECT {k}x, x - avg(x) OVER ({p}) AS dev, row_number() OVER ({p} ORDER BY o) AS i FROM base),
g AS (SELECT {k}avg(x) AS m, count(*) AS n, sum(dev * dev) / count(*) AS g0 FROM d {g}),
l AS (SELECT {a}k, sum(a.dev * b.dev) AS s FROM d a JOIN range(1, 7) t(k) ON true JOIN d b ON b.i = a.i - k {j} GROUP BY ALL),
v AS (SELECT {gk}m, n, g0 + coalesce(sum(2 * (1 - k / 7) * s / n), 0) AS var FROM g LEFT JOIN l ON {lj} GROUP BY {gk}m, n, g0)"""

_BY_VARIABLE = _NW.format(k="variable, ", p="PARTITION BY variable", g="GROUP BY variable", a="a.variable, ", j="AND b.variable = a.variable", gk="g.variable, ", lj="l.variable = g.variable")


def _three(name: str, score: str) -> str:
    """Least squares of ret_fwd on a score, size and ret_1_0 of each month, by Cramer's rule on covariances."""
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    rows = [["s11", "s12", "s13"], ["s12", "s22", "s23"], ["s13", "s23", "s33"]]
    swapped = lambda k: [[f"y{i + 1}" if j == k else r[j] for j in range(3)] for i, r in enumerate(rows)]
    x = {1: score, 2: "size", 3: "ret_1_0"}
    sums = ", ".join([*(f"covar_pop({x[i]}, {x[j]}) AS s{i}{j}" for i in x for j in x if i <= j), *(f"covar_pop(ret_fwd, {x[i]}) AS y{i}, avg({x[i]}) AS m{i}" for i in x)])
    return f"""{name}_s AS (SELECT date, avg(ret_fwd) AS my, {sums} FROM panel WHERE ret_fwd IS NOT NULL AND {score} IS NOT NULL AND size IS NOT NULL AND ret_1_0 IS NOT NULL GROUP BY ALL HAVING count(*) >= 20),
      {name} AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (SELECT *, {", ".join(f"{det(*swapped(k))} / {det(*rows)} AS b{k + 1}" for k in range(3))} FROM {name}_s))"""


def _told(name: str, spec: str, score: str) -> str:
    return " UNION ALL ".join(f"SELECT '{spec}|{v}', date, b{k} FROM {name}" for k, v in enumerate(("intercept", score, "size", "ret_1_0")))


QUERIES = {
    "momentum": (momentum, _M + """ SELECT company, date, round(lag(ret) OVER w, 6) AS ret_1_0, round(CASE WHEN count(ret) OVER b = 11 THEN product(1 + ret) OVER b - 1 END, 5) AS ret_12_2 FROM fm
      WINDOW w AS (PARTITION BY company ORDER BY date), b AS (PARTITION BY company ORDER BY date ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)"""),
    "forward_returns": (forward_returns, _M + " SELECT company, last_day(date - INTERVAL 1 MONTH) AS date, round(ret, 6) AS ret_fwd FROM fm"),
    "panel": (panel, _PANEL + " SELECT company, date, round(ret_fwd, 6) AS ret_fwd, round(size, 6) AS size, round(ret_1_0, 6) AS ret_1_0, round(mt_strict, 6) AS mt_strict FROM panel"),
    "quintiles": (quintiles, _Q + " SELECT company, date, quintile FROM qt"),
    "sample_quintiles": (sample_quintiles, _M + """, ed AS (SELECT list_sort(list_distinct([quantile_cont(mt_strict, 0.0), quantile_cont(mt_strict, 0.2), quantile_cont(mt_strict, 0.4), quantile_cont(mt_strict, 0.6000000000000001::DOUBLE), quantile_cont(mt_strict, 0.8), quantile_cont(mt_strict, 1.0)])) AS e FROM fm)
      SELECT len(list_filter(e[2:len(e) - 1], lambda v: v < mt_strict)) + 1 AS quintile, count(*) AS n, round(avg(mt_strict), 6) AS mean_x FROM fm, ed GROUP BY ALL"""),
    "portfolio_returns": (portfolio_returns, _PF + " SELECT date, " + _PIVOT.replace("{}", "r") + " FROM pf GROUP BY date"),
    "portfolio_equal_weighted": (equal_weighted, _PF + " SELECT date, " + _PIVOT.replace("{}", "ew") + " FROM pf GROUP BY date"),
    "long_short": (long_short, _PF + ", ls AS (SELECT date, max(r) FILTER (quintile = 1) - max(r) FILTER (quintile = 5) AS LS FROM pf GROUP BY date), c AS (SELECT date, LS, product(1 + coalesce(LS, 0)) OVER (ORDER BY date) AS p FROM ls) SELECT date, round(LS, 5) AS LS, round(ln(abs(p)), 4) AS log_path, p < 0 AS below FROM c"),
    "portfolio_stats": (portfolio_stats, _PF + " SELECT 'Q' || quintile AS portfolio, round(avg(r) * 12, 4) AS mean_return, round(stddev_samp(r) * sqrt(12), 4) AS std, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12), 4) AS sharpe, round(min(r), 4) AS min_return, round(max(r), 4) AS max_return, count(r) AS n_obs FROM pf GROUP BY quintile"),
    "signal_agreement": (signal_agreement, _M + """, r AS (SELECT mt_strict AS a, mt_lenient AS b, rank() OVER (ORDER BY mt_strict) + (count(*) OVER (PARTITION BY mt_strict) - 1) / 2 AS ra, rank() OVER (ORDER BY mt_lenient) + (count(*) OVER (PARTITION BY mt_lenient) - 1) / 2 AS rb FROM fm)
      SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(stddev_samp(a), 6) AS sd_a, round(stddev_samp(b), 6) AS sd_b FROM r"""),
    "cross_sections": (cross_sections, _PANEL + """, c AS (SELECT date, regr_slope(ret_fwd, mt_strict) AS b, regr_intercept(ret_fwd, mt_strict) AS a, regr_count(ret_fwd, mt_strict)::BIGINT AS n FROM panel GROUP BY ALL HAVING regr_count(ret_fwd, mt_strict) >= 20)
      SELECT date, 'mt_strict' AS variable, round(b, 5) AS coef, n FROM c UNION ALL SELECT date, 'intercept', round(a, 5), n FROM c"""),
    "newey_west": (newey_west, _M + ", base AS (SELECT date AS o, round(avg(ret), 9) AS x FROM fm GROUP BY ALL HAVING avg(ret) IS NOT NULL)" + _NW.format(k="", p="", g="", a="", j="", gk="", lj="true") + " SELECT round(m, 6) AS mean_coef, round(sqrt(greatest(var, 1e-12) / n), 6) AS nw_se, n AS n_periods, round(m / sqrt(greatest(var, 1e-12) / n), 5) AS nw_tstat FROM v"),
    "fama_macbeth": (fama_macbeth, _PANEL + """, c AS (SELECT date, regr_slope(ret_fwd, mt_strict) AS b, regr_intercept(ret_fwd, mt_strict) AS a FROM panel GROUP BY ALL HAVING regr_count(ret_fwd, mt_strict) >= 20),
      base AS (SELECT 'mt_strict' AS variable, date AS o, b AS x FROM c UNION ALL SELECT 'intercept', date, a FROM c)""" + _NW.format(k="variable, ", p="PARTITION BY variable", g="GROUP BY variable", a="a.variable, ", j="AND b.variable = a.variable", gk="g.variable, ", lj="l.variable = g.variable") + " SELECT variable, round(m, 5) AS mean_coef, round(sqrt(greatest(var, 1e-12) / n), 5) AS nw_se, round(m / sqrt(greatest(var, 1e-12) / n), 4) AS nw_tstat, n AS n_periods, round(" + X.p_sql("(m / sqrt(greatest(var, 1e-12) / n))", "(n - 1)") + ", 5) AS p_value FROM v"),
    "full_analysis": (full_analysis, _PANEL + f""", uni AS (SELECT date, regr_slope(ret_fwd, mt_strict) AS b, regr_intercept(ret_fwd, mt_strict) AS a FROM panel GROUP BY ALL HAVING regr_count(ret_fwd, mt_strict) >= 20),
      {_three("mul", "mt_strict")}, {_three("len", "mt_lenient")},
      base AS (SELECT 'univariate|mt_strict' AS variable, date AS o, b AS x FROM uni UNION ALL SELECT 'univariate|intercept', date, a FROM uni
        UNION ALL {_told("mul", "multivariate", "mt_strict")} UNION ALL {_told("len", "lenient", "mt_lenient")})""" + _BY_VARIABLE + " SELECT split_part(variable, '|', 1) AS spec, split_part(variable, '|', 2) AS variable, round(m, 5) AS mean_coef, round(sqrt(greatest(var, 1e-12) / n), 5) AS nw_se, round(m / sqrt(greatest(var, 1e-12) / n), 3) AS nw_tstat, n AS n_periods, round(" + X.p_sql("(m / sqrt(greatest(var, 1e-12) / n))", "(n - 1)") + ", 4) AS p_value FROM v"),
}
