"""Cosine thresholds from labelled pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running

# Labels, weights of confidence, seed of the draws.
LABELS = ("MAINTAINED", "REPHRASED", "DROPPED", "UNCLEAR")
WEIGHTS = {"H": 1.0, "M": 0.7, "L": 0.3}
SEED = 20260509


def weighted_labels(pairs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Pairs with a weight by confidence; UNCLEAR goes. Reading the result raises on labels or confidences that are not known."""
    weights = weights or WEIGHTS
    known = F.col("label").isin(*LABELS) & F.col("confidence").isin(*weights)
    wrong = F.raise_error(F.concat(F.lit("unknown label or confidence: "), F.coalesce(F.col("label").cast("string"), F.lit("null")), F.lit(", "), F.coalesce(F.col("confidence").cast("string"), F.lit("null"))))
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return pairs.where(F.when(F.coalesce(known, F.lit(False)), F.col("label") != "UNCLEAR").otherwise(wrong.cast("boolean"))).withColumn("weight", F.element_at(m, F.col("confidence")))


def boundary_sweep(pairs: DataFrame, x: str = "similarity", y: str = "y", w: str = "weight", steps: int = 100) -> DataFrame:
    """Weighted F1 and balanced accuracy at each of steps + 1 thresholds (x >= t is positive).

    Rows are first summed by threshold bin, so the cumulated table has a row for each threshold.
    """
    bin_ = F.floor(F.round(F.col(x) * steps, 6)).cast("int")
    by = pairs.select(F.greatest(F.lit(-1), F.least(bin_, F.lit(steps))).alias("k"), F.col(y).alias("y"), F.col(w).alias("w"))
    sums = by.groupBy("k").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("q"))
    grid = pairs.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("k"))
    up = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    t = grid.join(sums, "k", "left").fillna(0.0, ["p", "q"])
    t = t.select("k", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(all_).alias("pos"), F.sum("q").over(all_).alias("neg")).where("k >= 0")
    f1 = F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    ba = (F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("neg") - F.col("fp"), F.col("neg")), F.lit(0.0))) / 2
    return t.select((F.col("k") / steps).alias("threshold"), F.coalesce(f1, F.lit(0.0)).alias("f1"), ba.alias("balanced_accuracy"))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest F1, and the one with the highest balanced accuracy."""
    top = lambda c: F.max(F.struct(F.round(c, 9).alias("v"), (-F.col("threshold")).alias("t")))
    a = sweep.agg(top("f1").alias("a"), top("balanced_accuracy").alias("b"))
    return a.select((-F.col("a.t")).alias("calibrated_f1"), F.col("a.v").alias("f1_best"), (-F.col("b.t")).alias("calibrated_ba"), F.col("b.v").alias("ba_best"))


def weighted_auc(pairs: DataFrame, x: str = "similarity", y: str = "y", w: str = "weight") -> DataFrame:
    """The weighted chance that a positive has a higher x than a negative, ties by half; by sums over distinct values."""
    by = pairs.groupBy(x).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0.0)).alias("q"))
    c = running(by, x, ["q"])
    return c.agg(F.try_divide(F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def f1_threshold(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 100) -> float:
    k = np.clip(np.floor(np.round(x * steps, 6)), -1, steps).astype(int) + 1
    p, q = np.bincount(k, w * (y == 1), steps + 2), np.bincount(k, w * (y == 0), steps + 2)
    tp, fp = p[::-1].cumsum()[::-1][1:], q[::-1].cumsum()[::-1][1:]
    f1 = 2 * tp / np.maximum(tp + fp + p.sum(), 1e-300)
    return float(np.round(f1, 9).argmax() / steps)


def logistic(d: DataFrame, penalty: float = 1e-6, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit over a table of any size: a Newton step is one aggregate of five sums.

    The table is read once, for the weights of each (similarity, y); the steps run over those, which executors keep
    while it lasts.
    """
    b = np.zeros(2)
    x, y, w = (F.col(c).cast("double") for c in ("similarity", "y", "weight"))
    cells = d.groupBy(x.alias("similarity"), y.alias("y")).agg(F.sum(w).alias("weight")).persist()
    try:
        for _ in range(rounds):
            z = F.least(F.greatest(F.lit(float(b[0])) * x + F.lit(float(b[1])), F.lit(-35.0)), F.lit(35.0))
            p = 1 / (1 + F.exp(-z))
            g, h = w * (p - y), w * p * (1 - p)
            s = [v or 0.0 for v in cells.agg(F.sum(g * x), F.sum(g), F.sum(h * x * x), F.sum(h * x), F.sum(h)).first()]
            step = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + penalty * np.eye(2), np.array(s[:2]) + penalty * b)
            b = b - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-10:
                break
    finally:
        cells.unpersist()
    return float(b[0]), float(b[1])


def bootstrap(d: DataFrame, draws: int = 1000, steps: int = 100, rng: np.random.Generator | None = None) -> tuple[float, float]:
    """The 95 % interval of the F1 threshold.

    The threshold depends on (step, y, weight) alone, so what is drawn are the
    counts of these cells, some hundreds however many pairs there are; the same
    draws at every size.
    """
    k = F.greatest(F.least(F.floor(F.round(F.col("similarity") * steps, 6)), F.lit(steps)), F.lit(-1)).cast("int")
    rows = d.groupBy(k.alias("k"), "y", "weight").agg(F.count(F.lit(1)).alias("n")).orderBy("k", "y", "weight").collect()
    if not rows:
        return float("nan"), float("nan")
    x, y, w, n = (np.array([float(r[c]) for r in rows]) for c in ("k", "y", "weight", "n"))
    rng, got = rng or np.random.default_rng(SEED), []
    for c in rng.multinomial(int(n.sum()), n / n.sum(), draws):
        if 0 < c[y == 1].sum() < c.sum():
            got.append(f1_threshold(x / steps, y, w * c))
    return tuple(float(v) for v in np.percentile(got, [2.5, 97.5])) if got else (float("nan"), float("nan"))


def calibrate(pairs: DataFrame, draws: int = 1000) -> dict:
    """Both boundaries (MAINTAINED against DROPPED; either kind of kept against DROPPED): thresholds, AUC, logistic fit, interval.

    One stream of random numbers serves both; pairs stay in Spark.
    """
    d = weighted_labels(pairs)
    out, rng = {}, np.random.default_rng(SEED)
    for name, kept in (("maintained", ["MAINTAINED"]), ("rephrased", ["MAINTAINED", "REPHRASED"])):
        sub = d.where(F.col("label").isin(*kept, "DROPPED")).withColumn("y", (F.col("label") != "DROPPED").cast("int"))
        best, auc = best_thresholds(boundary_sweep(sub)).first(), weighted_auc(sub).first()["auc"]
        n, (beta, alpha) = sub.count(), logistic(sub)
        out[name] = {**best.asDict(), "auc": auc, "logistic": {"beta": beta, "intercept": alpha}, "p50_threshold": -alpha / beta if beta else None, "n": n, "bootstrap_ci_95": bootstrap(sub, draws, rng=rng)}
    return out


def resolve_thresholds(stored: dict | None = None, maintained: float | None = None, rephrased: float | None = None) -> tuple[float, float, bool]:
    """Overrides, else stored thresholds, else 0.65 and 0.40; raises unless 0 < r < m < 1. The flag tells whether stored ones were used."""
    from .vectors import MAINTAINED, REPHRASED

    stored = stored or {}
    m = maintained if maintained is not None else stored.get("maintained", MAINTAINED)
    r = rephrased if rephrased is not None else stored.get("rephrased", REPHRASED)
    if not 0 < r < m < 1:
        raise ValueError(f"thresholds {m} and {r} are not in order")
    return m, r, bool(stored) and maintained is None and rephrased is None
