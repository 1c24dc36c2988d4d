"""Regressions and tests over panels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import average_ranks, exact_quantiles


def cross_sectional(panel: DataFrame, y: str, x: list[str], by: str = "date", least: int | None = None) -> DataFrame:
    """Per period OLS coefficients (period, variable, coef, n) on complete rows; periods of fewer than max(20, k + 5) go.

    Each period is reduced to its moment matrix before anything is shuffled, so
    a task solves (k + 1) x (k + 1) systems however many firms there are.
    """
    k = len(x)
    need = least or max(20, k + 5)
    names = ["intercept", *x]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    ok = F.lit(True)
    for c in [y, *x]:
        ok = ok & F.col(c).isNotNull()
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k + 2) for j in range(i, k + 2)]
    moments = panel.where(ok).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= need)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                m = np.zeros((k + 2, k + 2))
                for i in range(k + 2):
                    for j in range(i, k + 2):
                        m[i, j] = m[j, i] = getattr(row, f"s{i}_{j}")
                coef = np.linalg.lstsq(m[: k + 1, : k + 1], m[: k + 1, k + 1], rcond=None)[0]
                out += [(row[0], v, float(c), int(row.n)) for v, c in zip(names, coef)]
            yield pd.DataFrame(out, columns=[by, "variable", "coef", "n"])

    kind = dict(panel.dtypes)[by]
    return moments.mapInPandas(solve, f"{by} {kind}, variable string, coef double, n long")


def newey_west(series: DataFrame, value: str, order: str, lags: int = 6, by: str | None = None) -> DataFrame:
    """Mean, Bartlett-weighted standard error and t of a series (of each ``by``); autocovariances divide by n, the variance is at least 1e-12.

    A series has a row for each period, so positions come from one window per group.
    """
    from pyspark.sql import Window

    g = [by] if by else []
    base = series.where(F.col(value).isNotNull()).select(*g, F.col(order).alias("__o"), F.col(value).cast("double").alias("x"))
    keyed = base.withColumn("__g", F.col(by) if by else F.lit(0))
    w = Window.partitionBy("__g")
    d = keyed.withColumns({"dev": F.col("x") - F.avg("x").over(w), "__n": F.row_number().over(w.orderBy("__o"))})
    back = w.orderBy("__n")
    for k in range(1, lags + 1):
        d = d.withColumn(f"p{k}", F.col("dev") * F.lag("dev", k).over(back))
    n = F.count(F.lit(1))
    var = F.sum(F.col("dev") * F.col("dev")) / n
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) / n
    out = d.groupBy("__g", *g).agg(F.avg("x").alias("mean_coef"), F.sqrt(F.greatest(var, F.lit(1e-12)) / n).alias("nw_se"), n.alias("n_periods"))
    return out.drop("__g").where("n_periods >= 2").withColumn("nw_tstat", F.try_divide("mean_coef", "nw_se"))


# Lanczos' series of the gamma function, with 7 as its shift.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _log_gamma(z: Column) -> Column:
    """For z of 0.5 or more."""
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        total = total + F.lit(c) / (z + float(i))
    t = z + 6.5
    return math.log(2 * math.pi) / 2 + (z - 0.5) * F.ln(t) - t + F.ln(total)


def _log_half_step(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a); for large a by its series, as a difference would lose its digits."""
    return F.when(a > 100, F.ln(a) / 2 - 1 / (8 * a) + 1 / (192 * a * a * a)).otherwise(_log_gamma(a + 0.5) - _log_gamma(a))


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz, as a fold over its terms."""
    whole = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        num = F.when(k % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        # each value is bound once, as an element of an array
        both = F.transform(F.array(F.struct((1 / whole(1 + num * acc["d"])).alias("d"), whole(1 + num / acc["c"]).alias("c"))), lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (acc["h"] * v["c"] * v["d"]).alias("h")))
        return F.get(both, F.lit(0))

    first = 1 / whole(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), steps), start, step, lambda v: v["h"])


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t, by built-in expressions; null where t is null or no number, or without degrees of freedom."""
    t, dof = t.cast("double"), dof.cast("double")
    x, a, b = dof / (dof + t * t), dof / 2, F.lit(0.5)
    steps = F.least(F.lit(40_000), 100 + 8 * F.sqrt(dof)).cast("int")  # the fraction needs about as many terms as the root of its larger side
    front = F.exp(_log_half_step(a) - math.log(math.pi) / 2 + a * F.ln(x) + F.ln(t * t / (dof + t * t)) / 2)
    near, far = front * _beta_fraction(a, b, x, steps) / a, 1 - front * _beta_fraction(b, a, 1 - x, steps) / b
    p = F.when(t == 0, 1.0).when(x <= 0, 0.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)
    return F.when(t.isNotNull() & ~F.isnan(t) & (dof > 0), p)


def with_p_value(df: DataFrame, t: str, dof: Column, name: str = "p_value") -> DataFrame:
    return df.withColumn(name, t_p_value(F.col(t), dof))


def fama_macbeth(panel: DataFrame, y: str, x: list[str], by: str = "date", lags: int = 6, least: int | None = None) -> DataFrame:
    """(variable, mean_coef, nw_se, nw_tstat, p_value, n_periods) over the periods' regressions."""
    coefs = cross_sectional(panel, y, x, by, least)
    out = newey_west(coefs, "coef", by, lags, "variable")
    return with_p_value(out, "nw_tstat", F.col("n_periods") - 1)


def full_analysis(panel: DataFrame, y: str, strict: str, lenient: str, controls: list[str], by: str = "date", lags: int = 6) -> DataFrame:
    """Univariate, with controls, and lenient with controls."""
    specs = {"univariate": [strict], "multivariate": [strict, *controls], "lenient": [lenient, *controls]}
    out = None
    for name, x in specs.items():
        part = fama_macbeth(panel, y, x, by, lags).withColumn("spec", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def signal_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman (on average ranks), means and deviations of two signals; null below 3 rows.

    Average ranks come from counts of each value, cumulated over distinct values.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in "ab":
        d = d.join(average_ranks(d, c).withColumnRenamed("rank", f"r{c}"), c)
    n = F.count(F.lit(1))
    only = lambda x: F.when(n >= 3, x)
    return d.agg(n.alias("n"), only(F.corr("a", "b")).alias("pearson"), only(F.corr("ra", "rb")).alias("spearman"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.stddev_samp("a").alias("sd_a"), F.stddev_samp("b").alias("sd_b"))


def group_t(df: DataFrame, by: str, x: str) -> DataFrame:
    """Mean, deviation, count, t against zero and its p of each group."""
    mean, sd, n = F.avg(x), F.stddev_samp(x), F.count(x)
    out = df.groupBy(by).agg(mean.alias("mean_x"), sd.alias("sd_x"), n.alias("n"), F.try_divide(mean, sd / F.sqrt(n)).alias("t"))
    return with_p_value(out, "t", F.col("n") - 1)


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Intercept, slope, R2 and the slope's t of y on x."""
    n = F.regr_count(y, x)
    sse = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.try_divide(F.regr_sxy(y, x), F.regr_sxx(y, x))
    se = F.sqrt(F.try_divide(F.try_divide(sse, (n - 2).cast("double")), F.regr_sxx(y, x)))
    return df.agg(n.alias("n"), F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), F.try_divide(F.regr_slope(y, x), se).alias("t_beta"))


def paired_regression(left: DataFrame, right: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """The regression of y on x over all pairs of rows with equal keys, with the slope's t and p, from the sums of each key: no pair is made."""
    v, w = F.col(y).cast("double"), F.col(x).cast("double")
    a = left.where(v.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("ny"), F.sum(v).alias("sy"), F.sum(v * v).alias("qy"))
    b = right.where(w.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("nx"), F.sum(w).alias("sx"), F.sum(w * w).alias("qx"))
    s = a.join(b, key).agg(
        F.sum(F.expr("ny * nx")).alias("n"), F.sum(F.expr("sy * nx")).alias("ty"), F.sum(F.expr("sx * ny")).alias("tx"),
        F.sum(F.expr("qy * nx")).alias("uy"), F.sum(F.expr("qx * ny")).alias("ux"), F.sum(F.expr("sy * sx")).alias("uxy"),
    )
    s = s.selectExpr("coalesce(n, 0) AS n", "try_divide(ty, n) AS my", "try_divide(tx, n) AS mx", "uy - try_divide(ty * ty, n) AS syy", "ux - try_divide(tx * tx, n) AS sxx", "uxy - try_divide(tx * ty, n) AS sxy")
    s = s.withColumn("beta", F.expr("try_divide(sxy, sxx)"))
    se = "sqrt(try_divide(try_divide(syy - sxy * beta, n - 2), sxx))"
    out = s.selectExpr("CAST(n AS LONG) AS n", "my - beta * mx AS alpha", "beta", "try_divide(sxy * sxy, sxx * syy) AS r2", f"try_divide(beta, {se}) AS t_beta")
    return with_p_value(out, "t_beta", F.col("n") - 2, "p_beta")


def welch_high_low(df: DataFrame, x: str, by: str, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """Welch's t of x between rows with ``by`` at or above its hi quantile and at or below its lo one; null where a side has fewer than 3."""
    q = exact_quantiles(df, F.col(by), [lo, hi])
    d = df.crossJoin(F.broadcast(q))  # one row of two numbers
    high, low = F.when(F.col(by) >= F.col("q")[1], F.col(x)), F.when(F.col(by) <= F.col("q")[0], F.col(x))
    v1, v0 = F.var_samp(high) / F.count(high), F.var_samp(low) / F.count(low)
    ok = (F.count(high) >= 3) & (F.count(low) >= 3)
    return d.agg(F.count(high).alias("n_high"), F.count(low).alias("n_low"), F.avg(high).alias("mean_high"), F.avg(low).alias("mean_low"), F.when(ok, F.try_divide(F.avg(high) - F.avg(low), F.sqrt(v1 + v0))).alias("welch_t"))


def announcement_effect(cars: DataFrame, scores: DataFrame, key: str = "company", car: str = "car", mt: str = "mt") -> DataFrame:
    """One row: the regression of abnormal returns on scores over pairs of equal keys, its p-value, the returns of high and low scores, and what follows.

    Without a pair the counts are 0 and the conclusion says so.
    """
    reg = paired_regression(cars.select(key, car), scores.select(key, mt), key, car, mt)
    reg = reg.withColumnRenamed("p_beta", "p_mt")
    pairs = cars.select(key, F.col(car).alias("__y")).where("__y is not null").join(scores.select(key, F.col(mt).alias("__x")).where("__x is not null"), key)
    test = welch_high_low(pairs, "__y", "__x")
    # a p-value above a tenth fails to tell the slope from zero
    told = F.when(F.col("n") == 0, "insufficient data").when(F.col("p_mt") > 0.10, "not related").otherwise("related")
    return reg.crossJoin(F.broadcast(test)).withColumn("conclusion", told)


def return_groups(cars: DataFrame, scores: DataFrame, n: int = 5, key: str = "company", car: str = "car", mt: str = "mt") -> DataFrame:
    """Mean, deviation, count and t of abnormal returns by quantile of the score, over pairs of equal keys."""
    from .panel import quantiles

    pairs = cars.select(key, car).where(F.col(car).isNotNull()).join(scores.select(key, mt).where(F.col(mt).isNotNull()), key)
    return group_t(quantiles(pairs, mt, by=None, n=n).withColumnRenamed("quintile", "mt_group"), "mt_group", car)
