"""Monthly firm panels and quantile portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clipped
from .ordered import exact_quantiles


def momentum(panel: DataFrame, firm: str = "company", date: str = "date", ret: str = "ret") -> DataFrame:
    """ret_1_0, the row before, and ret_12_2, the product of rows 12 to 2 before (null unless all 11 have a return)."""
    w = Window.partitionBy(firm).orderBy(date)
    back = w.rowsBetween(-12, -2)
    total = F.product(1 + F.col(ret)).over(back) - 1
    return panel.withColumns({"ret_1_0": F.lag(ret).over(w), "ret_12_2": F.when(F.count(ret).over(back) == 11, total)})


def forward_dated(returns: DataFrame, date: str = "date") -> DataFrame:
    """Each return dated to the month-end before, where it is the next month's."""
    return returns.withColumn(date, F.last_day(F.add_months(F.col(date), -1)))


def winsorised(panel: DataFrame, cols: list[str], by: str = "date", lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Columns clipped to their quantiles of each period; nulls stay."""
    q = panel.groupBy(by).agg(*[F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(f"__{c}") for c in cols])
    out = panel.join(q, by, "left")
    return out.withColumns({c: clipped(F.col(c), F.col(f"__{c}")[0], F.col(f"__{c}")[1]) for c in cols}).drop(*[f"__{c}" for c in cols])


def quantile_edges(x: Column, n: int) -> Column:
    """Edges at i times 1/n, not i/n: pandas spaces them so, which tells where ties merge."""
    return F.percentile(x, F.array(*[F.lit(min(1.0, i * (1 / n))) for i in range(n + 1)]))


def bucket_of(x: Column, edges: Column) -> Column:
    """1-based, right-closed bucket; equal edges merge; null where one edge is left."""
    e = F.array_distinct(edges)
    inner = F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0)))
    return F.when(x.isNotNull() & (F.size(e) >= 2), F.size(F.filter(inner, lambda v: v < x)) + 1)


def quantiles(panel: DataFrame, x: str, by: str | None = "date", n: int = 5, least: int | None = None) -> DataFrame:
    """A ``quintile`` column by linear-interpolated quantiles of each period; null in periods of fewer than ``least`` values."""
    least = least or n
    if by:
        edges = panel.groupBy(by).agg(quantile_edges(F.col(x), n).alias("__e"), F.count(x).alias("__n"))
        out = panel.join(edges, by, "left")
    else:  # one row of edges, found without one task that sorts all values
        edges = exact_quantiles(panel, F.col(x), [min(1.0, i * (1 / n)) for i in range(n + 1)], "__e").crossJoin(panel.agg(F.count(x).alias("__n")))
        out = panel.crossJoin(F.broadcast(edges))
    return out.withColumn("quintile", F.when(F.col("__n") >= least, bucket_of(F.col(x), F.col("__e")))).drop("__e", "__n")


def weighted_mean(r: Column, w: Column) -> Column:
    """By weights clipped at 0; the plain mean where they add to 0."""
    pos = F.when(w.isNotNull() & r.isNotNull(), F.greatest(w, F.lit(0.0)))
    total = F.sum(pos)
    return F.when(total > 0, F.sum(r * pos) / total).otherwise(F.avg(r))


def portfolio_returns(panel: DataFrame, n: int = 5, weight: str | None = "mktcap", min_firms: int = 5) -> DataFrame:
    """Q1..Qn by date; null for buckets of fewer than ``min_firms``."""
    mean = weighted_mean(F.col("ret"), F.col(weight)) if weight else F.avg("ret")
    value = F.when(F.count("ret") >= min_firms, mean)
    out = panel.where("quintile is not null and ret is not null").groupBy("date").pivot("quintile", list(range(1, n + 1))).agg(value)
    return out.select("date", *[F.col(str(i)).alias(f"Q{i}") for i in range(1, n + 1)])


def long_short(returns: DataFrame, long: str = "Q1", short: str = "Q5") -> DataFrame:
    """The spread and its compounded path; null spreads count as 0 in the path. Periods are few, firms are already gone."""
    out = returns.select("date", F.col(long).alias("Q_long"), F.col(short).alias("Q_short"), (F.col(long) - F.col(short)).alias("LS"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("LS_cum", F.product(1 + F.coalesce("LS", F.lit(0.0))).over(w) - 1)


def portfolio_stats(returns: DataFrame, cols: list[str], periods: int = 12) -> DataFrame:
    r = returns.unpivot([], cols, "portfolio", "r")
    return annual_stats(r.groupBy("portfolio"), F.col("r"), periods)


def annual_stats(grouped, r: Column, periods: int = 12) -> DataFrame:
    mean, sd = F.avg(r), F.stddev_samp(r)
    return grouped.agg(
        (mean * periods).alias("mean_return"),
        (sd * F.sqrt(F.lit(periods))).alias("std"),
        (F.try_divide(mean, sd) * F.sqrt(F.lit(periods))).alias("sharpe"),
        F.min(r).alias("min_return"),
        F.max(r).alias("max_return"),
        F.count(r).alias("n_obs"),
    )
