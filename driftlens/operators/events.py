"""Abnormal returns around events, by trading-day position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums that tell a regression and a window's abnormal return.
_SUMS = ("n", "n_full", "r", "m", "mm", "mr")


def moments_upto(daily: DataFrame, key: str = "company", more: list[str] | None = None) -> DataFrame:
    """Each day with its place (``pos``, from 1), its key's number of days, and running sums of what a regression of ret on mkt_ret needs.

    Returns are taken from their key's means (``r0``, ``m0``) first, so that
    differences of the sums keep their digits. A day without both returns
    counts as a row only. Columns ``more`` come along.
    """
    more = more or []
    full = F.col("ret").isNotNull() & F.col("mkt_ret").isNotNull()
    whole = Window.partitionBy(key)
    mean = lambda c: F.coalesce(F.avg(F.when(full, F.col(c))).over(whole), F.lit(0.0))
    order = whole.orderBy("date")
    d = daily.select(key, "date", "ret", "mkt_ret", *more, F.row_number().over(order).cast("long").alias("pos"), F.count(F.lit(1)).over(whole).alias("days"), mean("ret").alias("r0"), mean("mkt_ret").alias("m0"))
    r, m = F.when(full, F.col("ret") - F.col("r0")).otherwise(0.0), F.when(full, F.col("mkt_ret") - F.col("m0")).otherwise(0.0)
    parts = {"n": F.lit(1), "n_full": full.cast("long"), "r": r, "m": m, "mm": m * m, "mr": m * r}
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return d.select(key, "date", "pos", "days", "r0", "m0", *more, *[F.sum(c).over(upto).alias(f"upto_{k}") for k, c in parts.items()])


def abnormal_returns(daily: DataFrame, events: DataFrame, key: str = "company", est: tuple[int, int] = (-250, -30), window: tuple[int, int] = (-1, 1), min_est: int = 30, within: int = 3) -> DataFrame:
    """Per event: matched day, alpha and beta (0 and 1 below 10 estimation rows), rows used, CAR (null if any return in the window is).

    Events are dealt to the 2 * within + 1 dates that can serve them and wait
    there for a day of their key, so days go out once, to their key, however
    long the windows are: what the running sums are at a window's end and
    before its beginning is looked up by place within the key. A market that
    does not move in the estimation window has no beta, and no alpha.
    """
    near = events.select(key, "event_date", F.explode(F.array(*[F.lit(i) for i in range(-within, within + 1)])).alias("off"))
    near = near.groupBy(key, F.date_add(F.to_date("event_date"), F.col("off")).alias("__d")).agg(F.collect_list(F.struct(F.abs("off").alias("off"), "event_date")).alias("__waiting"))
    days = daily.select(key, "date", "ret", "mkt_ret", F.to_date("date").alias("__d")).join(near, [key, "__d"], "left")
    sums = moments_upto(days, key, ["__waiting"])
    order = Window.partitionBy(key).orderBy("date")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = {k: F.last(f"upto_{k}").over(whole) for k in _SUMS}

    def upto(k: str, to: int) -> Column:
        """The running sum ``to`` places on: nothing before the first day, all from the last on."""
        c = f"upto_{k}"
        return F.coalesce(F.lag(c, -to).over(order), F.lit(0)) if to < 0 else F.coalesce(F.lead(c, to).over(order), last[k])

    ends = {"e": est, "w": window}
    seen = sums.select(key, "date", "pos", "r0", "m0", "__waiting", upto("mm", est[1]).alias("scale"), *[(upto(k, hi) - upto(k, lo - 1)).alias(f"{of}_{k}") for of, (lo, hi) in ends.items() for k in _SUMS])
    stats = ["r0", "m0", "scale", *[f"{of}_{k}" for of in ends for k in _SUMS]]
    seen = seen.where("__waiting is not null").select(key, "date", "pos", *stats, F.inline("__waiting"))
    best = F.min(F.struct("off", F.col("date").alias("matched_day"), F.col("pos").alias("event_pos"), *stats)).alias("best")
    keys = [key, "event_date", "matched_day", "event_pos"]
    g = seen.groupBy(key, "event_date").agg(best).select(key, "event_date", "best.*")
    g = g.where((F.col("e_n") >= min_est) & (F.col("w_n") > 0))
    sxx, sxy = F.expr("e_mm - e_m * e_m / e_n_full"), F.expr("e_mr - e_m * e_r / e_n_full")
    # what is left of equal returns after the sums' rounding is nothing
    slope = F.when(sxx > 1e-12 * F.col("scale"), sxy / sxx)
    enough = F.col("e_n_full") >= 10
    g = g.withColumn("beta_hat", F.when(enough, slope).otherwise(1.0))
    g = g.withColumn("alpha_hat", F.when(enough, F.expr("r0 + e_r / e_n_full - beta_hat * (m0 + e_m / e_n_full)")).otherwise(0.0))
    car = F.expr("w_r + w_n * r0 - alpha_hat * w_n - beta_hat * (w_m + w_n * m0)")
    return g.select(*keys, "alpha_hat", "beta_hat", F.col("e_n_full").alias("n_est_obs"), F.when(F.col("w_n_full") == F.col("w_n"), car).alias("car"), F.col("w_n").alias("n_event_days"))
