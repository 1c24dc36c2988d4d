"""From targets to reports: the workflow's nodes as transforms of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .moving_targets import KEY, lasting
from .vectors import best_matches, continuity


def classified(labels: DataFrame, targets: DataFrame, sets: DataFrame, window: int = 12) -> DataFrame:
    """Per call: counts of dropped, financial and persistent targets, and the risk score.

    ``labels`` are of :func:`vectors.continuity`; ``targets`` gives a name and a flag for (company, idx) by key.
    """
    named = labels.join(targets.select("company", F.col("idx").alias("hist_idx"), "norm", "is_financial"), ["company", "hist_idx"], "left")
    d = named.join(lasting(sets, window), [*KEY, "norm"], "left")
    dropped = F.col("label") == "dropped"
    fin = T.is_financial(F.col("is_financial"), F.col("norm"))
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    out = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_total"), n(dropped).alias("n_dropped"), n(dropped & F.col("persistent")).alias("n_persistent"), n(dropped & ~fin).alias("n_nonfinancial"))
    return out.withColumn("risk_score", S.risk_score(F.col("n_total"), F.col("n_dropped"), F.col("n_persistent"), F.col("n_nonfinancial")))


def reported(scores: DataFrame) -> DataFrame:
    """Flags and texts for each call."""
    flag = S.report_flag(F.col("risk_score"))
    company, quarter = F.col("company").cast("string"), F.concat(F.floor(F.col("q_int") / 4).cast("string"), F.lit("Q"), (F.pmod("q_int", F.lit(4)) + 1).cast("string"))
    return scores.withColumns({
        "risk_flag": flag,
        "summary": S.summary_text(company, quarter, F.col("n_total"), F.col("n_dropped"), F.col("n_persistent"), F.col("risk_score"), flag),
        "recommendation": S.recommendation_text(flag),
    })


def run_reports(vectors: DataFrame, targets: DataFrame, sets: DataFrame, maintained: float = 0.50, rephrased: float = 0.45, lag: int = 4, done: DataFrame | None = None) -> DataFrame:
    """All nodes over all calls; calls in ``done`` are left out, so a stopped run resumes."""
    labels = continuity(best_matches(vectors, lag), maintained, rephrased)
    if done is not None:
        labels = labels.join(done.select(*KEY), list(KEY), "left_anti")
    return reported(classified(labels, targets, sets))


def watchlist(scores: DataFrame, by: str, score: str, name: str, n: int = 20) -> DataFrame:
    """The n highest of each ``by``, ranked from 1, ties by name."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(name)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def initial_state(calls: DataFrame) -> DataFrame:
    """Calls with the workflow's empty state: what every later node finds where an earlier one added nothing."""
    texts, none = F.array().cast("array<string>"), F.lit(0.0)
    return calls.withColumns({
        "extracted_targets": texts,
        "historical_targets": texts,
        "maintained": texts,
        "rephrased": texts,
        "dropped": texts,
        "risk_score": none,
        "financial_drop_ratio": none,
        "nonfinancial_drop_ratio": none,
        "persistent_drop_ratio": none,
        "risk_flag": F.lit("LOW"),
        "summary": F.lit(""),
        "recommendation": F.lit(""),
        "errors": texts,
    })


def kpis(scores: DataFrame, ticker: str = "company", flag: str = "risk_flag") -> DataFrame:
    """One row: companies, calls, and calls with a high flag."""
    return scores.agg(F.countDistinct(ticker).alias("n_companies"), F.count(F.lit(1)).alias("n_calls"), F.sum((F.col(flag) == "HIGH").cast("long")).alias("n_high"))


def cached_or(live: DataFrame, cache: DataFrame, keys: list[str], value: str, missing: str = "unavailable") -> DataFrame:
    """The cached value, else the live one, else a mark that neither is there."""
    c = cache.select(*keys, F.col(value).alias("__c"))
    return live.join(c, keys, "full_outer").withColumn(value, F.coalesce("__c", value, F.lit(missing))).drop("__c")
