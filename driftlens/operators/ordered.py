"""Running sums, ranks and exact quantiles over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that are summed up before anything is cumulated, in COARSE groups of as many each.
RANGES, COARSE = 1024, 32


def split_points(df: DataFrame, x: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges`` - 1 values, in order, between which the rows of ``df`` lie in about equal numbers.

    One pass with a sketch of bounded size, which tasks fill before anything is
    exchanged; only the points come to the driver, so that all that is computed
    with them agrees.
    """
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.agg(F.percentile_approx(F.col(x).cast("double"), probs, F.lit(20 * ranges)).alias("q")).first()["q"]
    return sorted({v for v in found or [] if v is not None})


def range_of(v: Column, points: list[float]) -> Column:
    """How many of the points are at or below ``v``: first among every COARSE-th, then among those between two of them."""
    if not points:
        return F.lit(0)
    array = lambda some: F.array(*map(F.lit, some)) if some else F.array().cast("array<double>")
    cut = [points[i : i + COARSE] for i in range(0, len(points), COARSE)]
    below = lambda some: F.size(F.filter(some, lambda p: p <= v))
    group = F.greatest(below(array([c[0] for c in cut])) - 1, F.lit(0))
    return group * COARSE + below(F.get(F.array(*map(array, cut)), group))


def running(df: DataFrame, x: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """``df``, one row for each value of ``x``, with the sums ``<name>_upto`` over all rows up to each.

    Values are cut into ranges of about as many rows each, however they are
    spread. Only the ranges' totals, of which there are ``ranges`` at most, are
    cumulated in one task; within a range rows are sorted by a task of its own.
    """
    cut = df.withColumn("__r", range_of(F.col(x).cast("double"), split_points(df, x, ranges)))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__r").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    totals = totals.select("__r", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])
    own = Window.partitionBy("__r").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(totals), "__r")
    return out.withColumns({f"{c}_upto": F.sum(c).over(own) + F.col(f"__b_{c}") for c in sums}).drop("__r", *[f"__b_{c}" for c in sums])


def average_ranks(df: DataFrame, x: str) -> DataFrame:
    """(x, rank) for each value: the mean of the places that its rows take."""
    n = running(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n")), x, ["n"])
    return n.select(x, (F.col("n_upto") - (F.col("n") - 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, x: Column, probs: list[float], name: str = "q") -> DataFrame:
    """One row with the array of linearly interpolated quantiles; null without values."""
    n = running(df.select(x.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", ["n"])
    total = n.agg(F.sum("n").alias("__n"))
    place = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    value = lambda k: F.min(F.when(F.col("n_upto") > k, F.col("x")))
    found = n.crossJoin(F.broadcast(total)).groupBy("__n").agg(*[value(f(place(p))).alias(f"{e}{i}") for i, p in enumerate(probs) for e, f in (("l", F.floor), ("h", F.ceil))])
    # between equal values the quantile is that value to the last bit, and never below the lower one: what is cut at it would lose its ties
    low, high, mixed = lambda i: F.col(f"l{i}"), lambda i: F.col(f"h{i}"), lambda p, i: (F.ceil(place(p)) - place(p)) * F.col(f"l{i}") + (place(p) - F.floor(place(p))) * F.col(f"h{i}")
    between = lambda p, i: F.when(low(i) == high(i), low(i)).otherwise(F.greatest(low(i), mixed(p, i)))
    row = found.select(F.array(*[between(p, i) for i, p in enumerate(probs)]).alias(name))
    # a table without values still gives its one row
    return row.agg(F.max(name).alias(name))
