"""Queries on embeddings and labelled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import vectors as V
from ..sources import io as IO
from ..sources import standins as X
from ..sources.index import VectorIndex

_W = f"WITH {X.VECTORS}"
_P = f"WITH {X.PAIRS}"


def unit_vectors(s, d):
    v = X.vectors(s, d)
    return v.select("idx", F.round(V.norm(F.col("v")), 6).alias("length"), F.round(V.norm(V.unit(F.col("v"))), 6).alias("unit_length"))


def pair_similarities(s, d):
    p = V.pair_similarities(X.vectors(s, d))
    return p.select("company", "q_int", "cur_idx", "hist_idx", F.round("sim", 6).alias("sim"))


def continuity(s, d):
    c = V.continuity(V.best_matches(X.vectors(s, d)), 0.30, 0.15)
    return c.select("company", "q_int", "hist_idx", "cur_idx", F.round("sim", 6).alias("sim"), "label")


def pair_log(s, d):
    v = X.vectors(s, d).withColumn("name", F.concat(F.lit("target "), (F.col("idx") % 7).cast("string")))
    p = V.pair_log(v, 0.30, 0.15)
    return p.select("company", "q_int", "cur_idx", "hist_idx", "current_label", "historical_label", F.round("similarity", 6).alias("similarity"), "label", "is_best")


def vector_index(s, d):
    """An index of all vectors: a third of them replaced, a company and ids without a vector deleted, compacted, read back."""
    v = X.vectors(s, d)
    index = VectorIndex(s, IO.scratch(s, "index"), v.schema, "idx")
    index.upsert(v)
    index.upsert(v.where("idx % 3 = 0").withColumn("q_int", F.col("q_int") + 100))
    index.delete_where("company = 5")
    index.delete(v.where("idx % 7 = 1").select("idx"))
    index.upsert(v.where("company = 5 and idx % 7 = 1"))
    n = index.count()
    index.compact()
    index.clean()
    return index.read().select("idx", "company", F.col("q_int").cast("long").alias("q_int"), F.round(V.norm(F.col("v")), 6).alias("length"), F.lit(n).cast("long").alias("n_rows"))


def semantic_mt(s, d):
    v = X.vectors(s, d)
    m = V.semantic_mt(v, v.select("company", "q_int"), 0.30, 0.15)
    return m.select("company", "q_int", "n_current", "n_historical", "n_maintained", "n_rephrased", "n_dropped", F.round("mt_score_strict", 6).alias("mt_score_strict"), F.round("mt_score_lenient", 6).alias("mt_score_lenient"))


def window_pairs(s, d):
    p = V.pair_similarities(X.vectors(s, d), window=2)
    return p.groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.max("sim"), 6).alias("max_sim"))


def threshold_grid(s, d):
    c = V.continuity(V.best_matches(X.vectors(s, d)), 0.30, 0.15).withColumn("kept", F.col("cur_idx") % 3 != 0)
    g = V.threshold_grid(c, [0.2, 0.25, 0.3, 0.35, 0.4], [0.05, 0.1, 0.15, 0.2, 0.25])
    return g.select("m", "r", "n_false", "n_maintained", "n_kept", F.round("fp_rate", 6).alias("fp_rate"))


def f1_sweep(s, d):
    p = C.weighted_labels(X.labelled_pairs(s, d))
    w = C.boundary_sweep(p)
    return w.select("threshold", F.round("f1", 6).alias("f1"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def best_thresholds(s, d):
    b = C.best_thresholds(C.boundary_sweep(C.weighted_labels(X.labelled_pairs(s, d))))
    return b.select("calibrated_f1", F.round("f1_best", 6).alias("f1_best"), "calibrated_ba", F.round("ba_best", 6).alias("ba_best"))


def weighted_auc(s, d):
    return C.weighted_auc(C.weighted_labels(X.labelled_pairs(s, d))).select(F.round("auc", 6).alias("auc"))


def calibrate(s, d):
    """Both boundaries with logistic fit and bootstrap interval; no SQL for draws."""
    r = C.calibrate(X.labelled_pairs(s, d))
    rows = [(k, float(v["calibrated_f1"]), float(v["auc"] or 0), float(v["p50_threshold"] or 0), *map(float, v["bootstrap_ci_95"]), v["n"]) for k, v in r.items()]
    return s.createDataFrame(rows, "boundary string, threshold double, auc double, p50 double, ci_low double, ci_high double, n long")


_SWEEP = _P + """, g AS (SELECT k, k / 100 AS threshold FROM range(0, 101) t(k)),
a AS (SELECT k, threshold, sum(weight) FILTER (y = 1 AND floor(round(similarity * 100, 6)) >= k) AS tp, sum(weight) FILTER (y = 0 AND floor(round(similarity * 100, 6)) >= k) AS fp,
  sum(weight) FILTER (y = 1) AS pos, sum(weight) FILTER (y = 0) AS neg FROM g, lp GROUP BY ALL),
sw AS (SELECT threshold, coalesce(2 * coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fp, 0) + pos, 0), 0) AS f1, (coalesce(coalesce(tp, 0) / nullif(pos, 0), 0) + coalesce((neg - coalesce(fp, 0)) / nullif(neg, 0), 0)) / 2 AS ba FROM a)"""

QUERIES = {
    "unit_vectors": (unit_vectors, "SELECT vec_id AS idx, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, 1.0::DOUBLE AS unit_length FROM embeddings"),
    "pair_similarities": (pair_similarities, _W + " SELECT company, q_int, cur_idx, hist_idx, round(sim, 6) AS sim FROM pairs"),
    "continuity_labels": (continuity, _W + " SELECT company, q_int, hist_idx, cur_idx, round(sim, 6) AS sim, label FROM labels"),
    "vector_index": (vector_index, _W + """, x AS (SELECT idx, company, CASE WHEN company = 5 AND idx % 7 = 1 THEN q_int WHEN idx % 3 = 0 THEN q_int + 100 ELSE q_int END AS q_int, round(sqrt(list_inner_product(v, v)), 6) AS length
      FROM v WHERE (company <> 5 AND idx % 7 <> 1) OR (company = 5 AND idx % 7 = 1))
      SELECT idx, company, q_int::BIGINT AS q_int, length, count(*) OVER () AS n_rows FROM x"""),
    "pair_log": (pair_log, _W + """ SELECT p.company, p.q_int, p.cur_idx, p.hist_idx, 'target ' || (p.cur_idx % 7) || ' [' || p.cur_idx || ']' AS current_label,
      'target ' || (p.hist_idx % 7) || ' (' || ((p.q_int - 4) // 4) || 'Q' || ((p.q_int - 4) % 4 + 1) || ') [' || p.hist_idx || ']' AS historical_label, round(p.sim, 6) AS similarity, label, p.cur_idx = l.cur_idx AS is_best
      FROM pairs p JOIN labels l USING (company, q_int, hist_idx)"""),
    "semantic_mt": (semantic_mt, _W + """, n AS (SELECT company, q_int, count(*) AS n_historical, count(*) FILTER (label = 'maintained') AS n_maintained, count(*) FILTER (label = 'rephrased') AS n_rephrased, count(*) FILTER (label = 'dropped') AS n_dropped FROM labels GROUP BY ALL),
      c AS (SELECT company, q_int, count(*) AS n_current FROM v GROUP BY ALL)
      SELECT company, q_int, n_current, coalesce(n_historical, 0) AS n_historical, coalesce(n_maintained, 0) AS n_maintained, coalesce(n_rephrased, 0) AS n_rephrased, coalesce(n_dropped, 0) AS n_dropped,
        coalesce(round(n_dropped / n_historical, 6), 0) AS mt_score_strict, coalesce(round((n_dropped + n_rephrased) / n_historical, 6), 0) AS mt_score_lenient FROM c LEFT JOIN n USING (company, q_int)"""),
    "window_pairs": (window_pairs, _W + " SELECT c.company, c.q_int, count(*) AS n_pairs, round(max(list_cosine_similarity(c.v, h.v)), 6) AS max_sim FROM v c JOIN v h ON c.company = h.company AND h.q_int BETWEEN c.q_int - 2 AND c.q_int - 1 GROUP BY ALL"),
    "threshold_grid": (threshold_grid, _W + """, g AS (SELECT m::DOUBLE AS m, r::DOUBLE AS r FROM (VALUES (0.2), (0.25), (0.3), (0.35), (0.4)) a(m), (VALUES (0.05), (0.1), (0.15), (0.2), (0.25)) b(r) WHERE r < m)
      SELECT m, r, count(*) FILTER (cur_idx % 3 <> 0 AND sim <= r) AS n_false, count(*) FILTER (cur_idx % 3 <> 0 AND sim > m) AS n_maintained, count(*) FILTER (cur_idx % 3 <> 0) AS n_kept,
        coalesce(round(count(*) FILTER (cur_idx % 3 <> 0 AND sim <= r) / nullif(count(*) FILTER (cur_idx % 3 <> 0), 0), 6), 1) AS fp_rate FROM labels, g GROUP BY m, r"""),
    "f1_sweep": (f1_sweep, _SWEEP + " SELECT threshold, round(f1, 6) AS f1, round(ba, 6) AS balanced_accuracy FROM sw"),
    "best_thresholds": (best_thresholds, _SWEEP + """ SELECT min(threshold) FILTER (round(f1, 9) = (SELECT max(round(f1, 9)) FROM sw)) AS calibrated_f1, round(max(f1), 6) AS f1_best,
      min(threshold) FILTER (round(ba, 9) = (SELECT max(round(ba, 9)) FROM sw)) AS calibrated_ba, round(max(ba), 6) AS ba_best FROM sw"""),
    "weighted_auc": (weighted_auc, _P + """ SELECT round(sum(p.weight * n.weight * CASE WHEN p.similarity > n.similarity THEN 1.0 WHEN p.similarity = n.similarity THEN 0.5 ELSE 0.0 END::DOUBLE) / sum(p.weight * n.weight), 6) AS auc
      FROM lp p, lp n WHERE p.y = 1 AND n.y = 0"""),
    "calibrate": (calibrate, None),
}
