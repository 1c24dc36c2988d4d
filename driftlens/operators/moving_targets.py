"""Which targets of a company's earlier quarter it no longer states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exact_quantiles

KEY = ("company", "q_int")


def target_sets(targets: DataFrame) -> DataFrame:
    """Distinct (company, q_int, norm) with the flag of the last duplicate by ``pos``."""
    last = F.max(F.struct(F.col("pos"), F.col("is_financial"))).getField("is_financial")
    return targets.where(F.col("norm") != "").groupBy(*KEY, "norm").agg(last.alias("is_financial"))


def compared(sets: DataFrame, calls: DataFrame, lag: int = 4) -> DataFrame:
    """(company, q_int, norm, in_now, in_past, past_financial) for each call with a call ``lag`` quarters before.

    Past sets are moved forward to the quarter that they are held against, so
    one shuffle on (company, q_int, norm) serves both differences.
    """
    spine = calls.select(*KEY).distinct()
    spine = spine.join(spine.select("company", (F.col("q_int") + lag).alias("q_int")), list(KEY), "left_semi")
    now = sets.select(*KEY, "norm", F.lit(1).alias("now"), F.lit(0).alias("past"), F.lit(None).cast("boolean").alias("fin"))
    past = sets.select("company", (F.col("q_int") + lag).alias("q_int"), "norm", F.lit(0).alias("now"), F.lit(1).alias("past"), F.col("is_financial").alias("fin"))
    both = now.unionByName(past).groupBy(*KEY, "norm").agg(F.max("now").alias("in_now"), F.max("past").alias("in_past"), F.max("fin").alias("past_financial"))
    return spine.join(both, list(KEY), "left")


def exact_mt(sets: DataFrame, calls: DataFrame, lag: int = 4) -> DataFrame:
    """Counts, score (null without past targets), dropped targets in order and the drop shares of both kinds."""
    c = compared(sets, calls, lag)
    count = lambda cond: F.sum(F.coalesce(cond.cast("long"), F.lit(0)))
    dropped = (F.col("in_past") == 1) & (F.col("in_now") == 0)
    out = c.groupBy(*KEY).agg(
        count(F.col("in_now") == 1).alias("n_targets"),
        count(F.col("in_past") == 1).alias("n_targets_tm4"),
        count(dropped).alias("n_dropped"),
        count((F.col("in_now") == 1) & (F.col("in_past") == 0)).alias("n_new"),
        F.array_sort(F.collect_list(F.when(dropped, F.col("norm")))).alias("dropped_targets"),
        F.avg(F.when(dropped, F.col("past_financial").cast("double"))).alias("financial_drop_ratio"),
        F.avg(F.when(dropped, 1 - F.col("past_financial").cast("double"))).alias("nonfinancial_drop_ratio"),
    )
    return out.withColumn("mt_score", F.try_divide(F.col("n_dropped").cast("double"), F.col("n_targets_tm4").cast("double")))


def persistence(sets: DataFrame, window: int = 12) -> DataFrame:
    """For each call and target of the ``window`` quarters before it, whether all of them state it."""
    moved = sets.select("company", "norm", F.explode(F.sequence(F.col("q_int") + 1, F.col("q_int") + window)).alias("q_int"))
    calls = sets.select(*KEY).distinct()
    return moved.join(calls, list(KEY), "left_semi").groupBy(*KEY, "norm").agg((F.count(F.lit(1)) == window).alias("persistent"))


def lasting(sets: DataFrame, window: int = 12) -> DataFrame:
    """(company, q_int, norm) of targets that all of the ``window`` quarters before the call state, by runs of quarters: one sort, no copies."""
    by = Window.partitionBy("company", "norm").orderBy("q_int")
    runs = sets.select(*KEY, "norm").withColumn("__run", F.col("q_int") - F.row_number().over(by))
    at = F.row_number().over(Window.partitionBy("company", "norm", "__run").orderBy("q_int"))
    long = runs.withColumn("__n", at).where(F.col("__n") >= window)
    return long.select("company", (F.col("q_int") + 1).alias("q_int"), "norm", F.lit(True).alias("persistent"))


def window_union(sets: DataFrame, n: int = 4) -> DataFrame:
    """The union of the n quarters before each call."""
    moved = sets.select("company", "norm", F.explode(F.sequence(F.col("q_int") + 1, F.col("q_int") + n)).alias("q_int"))
    return moved.join(sets.select(*KEY).distinct(), list(KEY), "left_semi").distinct()


def substring_persistence(dropped: DataFrame, sets: DataFrame, window: int) -> DataFrame:
    """Dropped metrics found, by substring either way, in each of the ``window`` quarters before.

    A text that lies within another has its beginning among the other's pieces
    of that length, so distinct names of a company are joined on (company, piece)
    and then verified; pieces have 8, 4, 2 or 1 characters, as long as the inner
    text has. Quarters come in after that, and runs of them tell what lasts.
    """
    d = dropped.where("norm <> ''").select("company", F.col("norm").alias("metric")).distinct()
    h = sets.where("norm <> ''").select("company", "norm").distinct()

    def start(c: str):
        n = F.length(c)
        return F.col(c).substr(F.lit(1), F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1))

    def pieces(c: str):
        cut = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.col(c).substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.explode(F.array_distinct(F.concat(*[cut(k) for k in (1, 2, 4, 8)])))

    on = ["company", "piece"]
    inside = d.withColumn("piece", start("metric")).join(h.withColumn("piece", pieces("norm")), on).where(F.contains("norm", "metric"))
    around = d.withColumn("piece", pieces("metric")).join(h.withColumn("piece", start("norm")), on).where(F.contains("metric", "norm"))
    alike = inside.select("company", "metric", "norm").unionByName(around.select("company", "metric", "norm")).distinct()
    stated = alike.join(sets.select(*KEY, "norm"), ["company", "norm"]).select(*KEY, F.col("metric").alias("norm")).distinct()
    out = dropped.select(*KEY, "norm").join(lasting(stated, window), [*KEY, "norm"], "left")
    return out.select(*KEY, F.col("norm").alias("metric"), F.coalesce("persistent", F.lit(False)).alias("persistent"))


def unique_labels(targets: DataFrame, keys: tuple[str, ...], name: str, order: tuple[str, ...]) -> DataFrame:
    """Second and later rows of a name within ``keys`` become "name (#k)"."""
    rn = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    return targets.withColumn("label", F.when(rn > 1, F.concat(F.col(name), F.lit(" (#"), rn.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def best_by_canonical(targets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each canonical name: highest confidence, then with a number, then first; ``first_pos`` gives the order."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    g = Window.partitionBy(*keys, "canonical_name")
    best = F.row_number().over(g.orderBy(rank.desc(), F.col("numerical_value").isNotNull().desc(), "pos"))
    return targets.withColumns({"__best": best, "first_pos": F.min("pos").over(g)}).where("__best = 1").drop("__best")


def first_transcripts(components: DataFrame, n: int, key: str = "transcript_id", order: str = "pos") -> DataFrame:
    """Rows of the first n transcripts by first appearance."""
    first = components.groupBy(key).agg(F.min(order).alias("__first")).orderBy("__first", key).limit(n)
    return components.join(first.select(key), key, "left_semi")


def mt_summary(scores: DataFrame, score: str = "mt_score") -> DataFrame:
    """One row: how many scores, their mean and exact median, and the share that is positive; the median is found in ranges of values, not in one buffer."""
    s = F.col(score)
    told = scores.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_mt"), F.avg(F.coalesce((s > 0).cast("double"), F.lit(0.0))).alias("share_positive"))
    median = exact_quantiles(scores, s, [0.5])
    return told.crossJoin(F.broadcast(median)).select("n", "mean_mt", F.get("q", F.lit(0)).alias("median_mt"), "share_positive")
