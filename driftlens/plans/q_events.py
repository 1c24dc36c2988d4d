"""Queries of event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import panel as P
from ..operators import relational as R
from ..operators import stats as S
from ..sources import standins as X

_EST, _MIN = (-15, -3), 5


def _cars(s, d):
    return E.abnormal_returns(X.daily(s, d), X.announcements(s, d), est=_EST, min_est=_MIN)


def event_cars(s, d):
    c = _cars(s, d)
    return c.select("company", "event_date", "matched_day", F.round("alpha_hat", 6).alias("alpha_hat"), F.round("beta_hat", 4).alias("beta_hat"), "n_est_obs", F.round("car", 5).alias("car"), "n_event_days")


def event_windows(s, d):
    rows = R.row_positions(X.daily(s, d), "company", "date").withColumn("pos", F.col("pos").cast("long"))
    e = rows.select("company", F.col("pos").alias("event_pos"))
    b = R.band_rows(e, rows.select("company", "pos", "ret"), "company", -2, 2)
    return b.groupBy("company", "event_pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ret"), 9).alias("total"))


def car_groups(s, d):
    c = _cars(s, d).withColumn("day", F.dayofmonth("event_date"))
    return S.group_t(c, "day", "car").select(F.col("day").cast("long").alias("day"), F.round("mean_x", 5).alias("mean_x"), F.round("sd_x", 5).alias("sd_x"), "n", F.round("t", 3).alias("t"), F.round("p_value", 5).alias("p_value"))


def car_on_score(s, d):
    """CARs joined to scores by firm alone, as many-to-many."""
    r = S.paired_regression(_cars(s, d), X.firm_months(s, d), "company", "car", "mt_strict")
    return r.select("n", *[F.round(c, 4).alias(c) for c in ("alpha", "beta", "r2", "t_beta")], F.round("p_beta", 5).alias("p_beta"))


def high_low(s, d):
    w = S.welch_high_low(X.firm_months(s, d), "mt_lenient", "mt_strict")
    return w.select("n_high", "n_low", F.round("mean_high", 6).alias("mean_high"), F.round("mean_low", 6).alias("mean_low"), F.round("welch_t", 4).alias("welch_t"))


def annual_sharpe(s, d):
    m = X.firm_months(s, d)
    a = P.annual_stats(m.groupBy("company"), F.col("ret"))
    return a.select("company", F.round("sharpe", 4).alias("sharpe"), "n_obs")


_C = f"""WITH {X.DAILY}, {X.ANNOUNCED}, mt AS (SELECT ev.company, event_date, arg_min(date, abs(date - event_date) * 10 + (date > event_date)::INT) AS matched_day FROM ev JOIN daily d ON d.company = ev.company AND abs(date - event_date) <= 3 GROUP BY ALL),
evt AS (SELECT mt.*, pos AS p0 FROM mt JOIN daily d ON d.company = mt.company AND d.date = matched_day),
md AS (SELECT evt.company, event_date, matched_day, p0, count(*) AS n_est_obs, CASE WHEN count(*) >= 10 THEN regr_intercept(ret, mkt_ret) ELSE 0 END AS alpha_hat, CASE WHEN count(*) >= 10 THEN regr_slope(ret, mkt_ret) ELSE 1 END AS beta_hat
  FROM evt JOIN daily d ON d.company = evt.company AND d.pos BETWEEN p0 - 15 AND p0 - 3 GROUP BY ALL HAVING count(*) >= 5),
cars AS (SELECT md.company, event_date, matched_day, n_est_obs, alpha_hat, beta_hat, sum(ret - (alpha_hat + beta_hat * mkt_ret)) AS car, count(*) AS n_event_days FROM md JOIN daily d ON d.company = md.company AND d.pos BETWEEN p0 - 1 AND p0 + 1 GROUP BY ALL)"""
_M = X.MONTHS

QUERIES = {
    "event_cars": (event_cars, _C + " SELECT company, event_date, matched_day, round(alpha_hat, 6) AS alpha_hat, round(beta_hat, 4) AS beta_hat, n_est_obs, round(car, 5) AS car, n_event_days FROM cars"),
    "event_windows": (event_windows, f"WITH {X.DAILY} SELECT e.company, e.pos AS event_pos, count(*) AS n, round(sum(r.ret), 9) AS total FROM daily e JOIN daily r ON r.company = e.company AND r.pos BETWEEN e.pos - 2 AND e.pos + 2 GROUP BY ALL"),
    "car_groups": (car_groups, _C + f""", g AS (SELECT day(event_date) AS day, avg(car) AS m, stddev_samp(car) AS sd, count(car) AS n FROM cars GROUP BY ALL), t AS (SELECT *, m / nullif(sd / sqrt(n), 0) AS t FROM g)
      SELECT day, round(m, 5) AS mean_x, round(sd, 5) AS sd_x, n, round(t, 3) AS t, round({X.p_sql("t", "(n - 1)")}, 5) AS p_value FROM t"""),
    "car_on_score": (car_on_score, _C + f""", {_M}, j AS (SELECT car AS y, mt_strict AS x FROM cars JOIN fm USING (company)),
      r AS (SELECT regr_count(y, x)::BIGINT AS n, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2,
        regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS t FROM j)
      SELECT n, round(alpha, 4) AS alpha, round(beta, 4) AS beta, round(r2, 4) AS r2, round(t, 4) AS t_beta, round({X.p_sql("t", "(n - 2)")}, 5) AS p_beta FROM r"""),
    "high_low_test": (high_low, f"""WITH {_M}, q AS (SELECT quantile_cont(mt_strict, 0.2) AS a, quantile_cont(mt_strict, 0.8) AS b FROM fm), x AS (SELECT CASE WHEN mt_strict >= b THEN mt_lenient END AS h, CASE WHEN mt_strict <= a THEN mt_lenient END AS l FROM fm, q)
      SELECT count(h) AS n_high, count(l) AS n_low, round(avg(h), 6) AS mean_high, round(avg(l), 6) AS mean_low, round((avg(h) - avg(l)) / sqrt(var_samp(h) / count(h) + var_samp(l) / count(l)), 4) AS welch_t FROM x"""),
    "annual_sharpe": (annual_sharpe, f"WITH {_M} SELECT company, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 4) AS sharpe, count(ret) AS n_obs FROM fm GROUP BY ALL"),
}
