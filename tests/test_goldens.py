"""Hand-derived results of single operators."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens import cli
from driftlens.functions import quarters as Q
from driftlens.functions import scoring as S
from driftlens.functions import text as T
from driftlens.operators import calibration, embedding, extraction, moving_targets, ordered, panel, stats, vectors
from driftlens.sources import io
from driftlens.streaming.resume import append_stream


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_exact_mt(spark):
    a = [("AAPL", 8088, x, f) for x, f in (("2 billion free cash flow", True), ("new iphone product launch", False), ("services revenue", True))]
    a += [("AAPL", 8092, "services revenue", True), ("AAPL", 8092, "vision pro", False)]
    a += [("MSFT", 8089, "cloud", True), ("MSFT", 8089, "ai", False), ("MSFT", 8093, "cloud", True), ("MSFT", 8093, "ai", False), ("MSFT", 8093, "more", True)]
    t = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "company string, q_int int, norm string, is_financial boolean, pos long")
    calls = spark.createDataFrame([("X", 8000), ("X", 8004), ("Y", 8000), ("Y", 8004)], "company string, q_int int").union(t.select("company", "q_int"))
    t = t.union(spark.createDataFrame([("Y", 8000, "gone", True, 99)], t.schema))
    got = {(r.company, r.q_int): r for r in moving_targets.exact_mt(moving_targets.target_sets(t), calls).collect()}
    r = got["AAPL", 8092]
    assert (r.n_targets, r.n_targets_tm4, r.n_dropped, r.n_new) == (2, 3, 2, 1) and abs(r.mt_score - 2 / 3) < 1e-12
    assert r.dropped_targets == ["2 billion free cash flow", "new iphone product launch"] and r.financial_drop_ratio == r.nonfinancial_drop_ratio == 0.5
    r = got["MSFT", 8093]
    assert (r.n_targets, r.n_dropped, r.n_new, r.mt_score, r.financial_drop_ratio) == (3, 0, 1, 0.0, None)
    assert got["X", 8004].mt_score is None and got["Y", 8004].mt_score == 1.0 and len(got) == 4


def test_quarters(spark):
    r = one(spark, i=Q.to_int(F.lit("2023Q1")), lag=Q.lagged(F.lit("2016Q3"), 4), p=Q.prior(F.lit("2023Q2"), 4), z=Q.lagged(F.lit("2023Q1"), 0), bad=Q.to_int(F.lit("bad")), none=Q.prior(F.lit("bad"), 2))
    assert (r.i, r.lag, r.z, r.bad, r.none) == (8092, "2015Q3", None, None, []) and r.p == ["2022Q2", "2022Q3", "2022Q4", "2023Q1"]


NAMES = {
    "Gross Margins": "gross margin", "gross-margin": "gross margin", "comparable-store sales": "comp revenue", "Same-Store Sales growth": "comp revenue growth", "Top-line growth": "revenue growth",
    "Monthly Active Users": "mau", "active users": "user", "Operating Cash Flow": "cash flow operation", "15% revenue growth in FY24": "revenue growth", "Earnings per share (EPS)": "eps eps",
    "$2.5 billion free cash flows": "free cash flow", "our R&D expenses": "r d expense", "basis points": "", "inventories": "inventory", "2,000 stores": "store",
}


def test_canonical_metric(spark):
    rows = spark.createDataFrame([(k, v) for k, v in NAMES.items()] + [(None, "")], "a string, b string").select("a", "b", T.canonical_metric(F.col("a")).alias("c")).collect()
    assert [(r.a, r.c) for r in rows] == [(r.a, r.b) for r in rows]


def test_ids(spark):
    for raw, want in {"18711.0_2023Q4": ("18711", 2023, 4, "2023Q4"), "112350_2020Q1": ("112350", 2020, 1, "2020Q1"), "free-form-id": ("free-form-id", None, None, ""), "": ("", None, None, "")}.items():
        assert tuple(one(spark, p=T.transcript_parts(F.lit(raw))).p) == want
    r = one(spark, a=T.company_id(F.lit(112350.0)), b=T.company_id(F.lit("18711.0")), c=T.company_id(F.lit(None)), d=T.token_estimate(F.lit("")), e=T.token_estimate(F.lit("abc")), f=T.token_estimate(F.lit("abcdefgh")))
    assert tuple(r) == ("112350", "18711", "", 0, 1, 2)


def test_chunks(spark):
    s = [c * n * 4 for c, n in zip("abcde", (300, 500, 400, 900, 100))]
    got = one(spark, c=T.packed_chunks(F.array(*map(F.lit, s)), 1000)).c
    assert got == [s[0] + " " + s[1], s[2], s[3] + " " + s[4]]
    assert [len(x) for x in one(spark, c=T.packed_chunks(F.array(F.lit("a"), F.lit("x" * 9000), F.lit("b")), 1000)).c] == [1, 4000, 4000, 1000, 1]


def test_risk(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    r = one(spark, s=S.risk_score(*lit(4, 2, 1, 1)), z=S.risk_score(*lit(4, 0, 0, 0)), a=S.report_flag(F.lit(0.6)), b=S.report_flag(F.lit(0.3)), c=S.report_flag(F.lit(0.2999)), d=S.screen_flag(F.lit(0.5)))
    assert tuple(r) == (0.5, 0.0, "MEDIUM", "MEDIUM", "LOW", "HIGH")


def test_newey_west(spark):
    r = stats.newey_west(spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "t int, v double"), "v", "t", 1).first()
    assert (r.mean_coef, r.nw_se, r.nw_tstat, r.n_periods) == (2.5, 0.625, 4.0, 4)


def test_p_values(spark):
    """Against the finite series for whole degrees of freedom, and values that tables have."""
    from math import atan, cos, isclose, pi, sin, sqrt

    def series(t, n):
        a, total, c = atan(abs(t) / sqrt(n)), 0.0, 1.0
        for k in range(n // 2 if n % 2 == 0 else (n - 1) // 2):
            total += c * cos(a) ** (2 * k + n % 2)
            c *= (2 * k + 1) / (2 * k + 2) if n % 2 == 0 else (2 * k + 2) / (2 * k + 3)
        return 1 - (sin(a) * total if n % 2 == 0 else 2 / pi * (a + sin(a) * total))

    cases = [(t, n) for t in (0.0, 1e-6, 0.3, -1.0, 2.0, 6.5, 40.0) for n in (1, 2, 3, 10, 57, 200, 999, 20_000)]
    df = spark.createDataFrame([*cases, (None, 3), (1.0, 0), (1.0, None), (float("nan"), 4), (float("inf"), 4), (1.96, 10**9)], "t double, n long")
    got = [r.p for r in df.select(stats.t_p_value(F.col("t"), F.col("n")).alias("p")).collect()]
    for (t, n), p in zip(cases, got):
        assert isclose(p, series(t, n), rel_tol=1e-7, abs_tol=1e-11), (t, n, p)
    assert got[len(cases) : len(cases) + 4] == [None] * 4 and got[-2] == 0.0 and abs(got[-1] - 0.04999579) < 1e-6
    assert abs(got[cases.index((2.0, 10))] - 0.07338803) < 1e-8
    plan = df.select(stats.t_p_value(F.col("t"), F.col("n")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ranges_under_skew(spark):
    """One value far out, and many rows of one value: no range holds many distinct values, and sums, ranks and quantiles stay exact."""
    rows = [(float(i % 5000) / 7,) for i in range(8000)] + [(1e9,), (-1e9,)] + [(3.25,)] * 3000 + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    values = df.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    points = ordered.split_points(values, "x", 128)
    sizes = [r["count"] for r in values.groupBy(ordered.range_of(F.col("x"), points).alias("r")).count().collect()]
    assert len(points) > 100 and max(sizes) < 0.02 * sum(sizes)
    xs = sorted(x for (x,) in rows if x is not None)
    upto = {r.x: r.n_upto for r in ordered.running(values, "x", ["n"]).collect()}
    assert upto == {x: i + 1 for i, x in enumerate(xs)}
    q = ordered.exact_quantiles(df, F.col("x"), [0.0, 0.1, 0.5, 0.99, 1.0]).first().q
    assert np.allclose(q, np.quantile(xs, [0.0, 0.1, 0.5, 0.99, 1.0]))
    assert ordered.split_points(df.where("false"), "x") == [] and ordered.exact_quantiles(df.where("false"), F.col("x"), [0.5]).first().q is None
    m = moving_targets.mt_summary(df.withColumnRenamed("x", "mt_score")).first()
    assert (m.n, m.median_mt) == (len(rows), float(np.median(xs)))


def test_event_windows_from_running_sums(spark):
    """Against least squares on the rows of each window: gaps, events at the edges, a market that stands still, firms far from 0."""
    from datetime import date, timedelta

    from driftlens.operators.events import abnormal_returns

    rng, rows, day = np.random.default_rng(5), [], date(2020, 1, 1)
    for firm, level in (("a", 0.0), ("b", 1000.0), ("c", 0.0)):
        for i in range(90):
            m = 0.25 if firm == "c" else float(rng.normal(0, 0.01))
            rows.append((firm, day + timedelta(days=i), None if i % 17 == 3 else level + 0.5 * m + float(rng.normal(0, 0.01)), None if i % 23 == 5 else m))
    events = [(f, day + timedelta(days=i)) for f in "abc" for i in (0, 1, 12, 40, 41, 60, 88, 89)] + [("d", day)]
    daily = spark.createDataFrame(rows, "company string, date date, ret double, mkt_ret double")
    got = {(r.company, r.event_date): r for r in abnormal_returns(daily, spark.createDataFrame(events, "company string, event_date date"), est=(-30, -3), window=(-1, 2), min_est=8).collect()}
    seen = 0
    for f, when in events:
        own = [r for r in rows if r[0] == f]
        p = (when - day).days
        est = [r for k, r in enumerate(own) if p - 30 <= k <= p - 3]
        if len(est) < 8:
            assert (f, when) not in got
            continue
        r, ok = got[f, when], [(x, m) for *_, x, m in est if x is not None and m is not None]
        beta, alpha = (None, None) if f == "c" and len(ok) >= 10 else np.polyfit([m for _, m in ok], [x for x, _ in ok], 1) if len(ok) >= 10 else (1.0, 0.0)
        win = [(x, m) for k, (*_, x, m) in enumerate(own) if p - 1 <= k <= p + 2]
        assert (r.n_est_obs, r.n_event_days) == (len(ok), len(win))
        if beta is None:
            assert r.beta_hat is None and r.alpha_hat is None and r.car is None
            continue
        assert abs(r.beta_hat - beta) < 1e-6 * max(1, abs(beta)) and abs(r.alpha_hat - alpha) < 1e-6
        full = all(x is not None and m is not None for x, m in win)
        assert r.car is None if not full else abs(r.car - sum(x - alpha - beta * m for x, m in win)) < 1e-6
        seen += full
    assert seen > 5


def test_cross_sections_match_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"date": np.repeat([1, 2], 30), "a": x[:, 0], "b": x[:, 1], "y": y}))
    got = {(r.date, r.variable): r.coef for r in stats.cross_sectional(df, "y", ["a", "b"]).collect()}
    for d in (0, 1):
        want = np.linalg.lstsq(np.c_[np.ones(30), x[30 * d : 30 * d + 30]], y[30 * d : 30 * d + 30], rcond=None)[0]
        assert np.allclose([got[d + 1, v] for v in ("intercept", "a", "b")], want)


def test_best_by_canonical(spark):
    rows = [("c", "low", 5.0, 0), ("c", "high", None, 1), ("c", "high", 7.0, 2), ("c", "high", 9.0, 3)]
    df = spark.createDataFrame([(1, *r) for r in rows], "company int, canonical_name string, confidence string, numerical_value double, pos int")
    assert [(r.numerical_value, r.first_pos) for r in moving_targets.best_by_canonical(df, ("company",)).collect()] == [(7.0, 0)]


def test_greedy_matches(spark):
    p, g = F.array(F.lit("revenue growth"), F.lit("revenue growth")), F.array(F.lit("revenue growth"))
    assert one(spark, n=extraction.greedy_matches(p, g)).n == 1
    assert tuple(one(spark, f=extraction.f1(F.lit(1), F.lit(2), F.lit(1))).f) == (0.5, 1.0, pytest.approx(2 / 3))


def test_responses(spark):
    cases = {
        '```json\n{"targets":[{"metric_name":"a"}]}\n```': [{"metric_name": "a"}], "[]": [], "no json": None, None: [], "": [], "null": None, "5": None, '"x"': None, " \n": None,
        '{"x":[{"metric_name":"a"}]}': [{"metric_name": "a"}], '{"metric_name":"a"}': [{"metric_name": "a"}], 'so: {"metric_name":"a"} and {"metric_name":"b"} end': [{"metric_name": "a"}, {"metric_name": "b"}],
        '{"unit": "x"}': [{"unit": "x"}], '{"a": 1}': None, '{"a": [1, {"b": 2}]}': [{"b": 2}], 'so [{"a": 1}] and [{"b": 2}]': [{"a": 1}], 'x {"z": 1} y': [], '{"z": [{"b": 1}], "a": [{"c": 2}]}': [{"b": 1}],
        '```\n[{"a": null}]```  ': [{"a": None}], '{"targets": {}, "unit": null}': [{"targets": {}, "unit": None}], '{"targets": [], "x": [{"a": 1}]}': [], '[[{"a": 1}]]': [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, reply string")
    got = {r.i: r for r in df.select("i", F.transform(extraction.reply_objects(F.col("reply")), lambda x: F.to_json(x)).alias("o"), extraction.reply_targets(F.col("reply")).alias("t")).collect()}
    for i, (reply, want) in enumerate(cases.items()):
        assert (got[i].o and [json.loads(x) for x in got[i].o]) == want if want else got[i].o == want, reply
    one = df.limit(1).select(extraction.reply_targets(F.lit('[{"numerical_value": 2.5, "unit": 7}, {"numerical_value": "3"}, {"numerical_value": -4}, {"numerical_value": true}]')).alias("t")).first().t
    assert [(x.numerical_value, x.unit) for x in one] == [(2.5, "7"), (None, None), (-4.0, None), (None, None)]


def test_continuity_bounds(spark):
    df = spark.createDataFrame([("c", 1, i, i, s) for i, s in enumerate((0.81, 0.80, 0.55, 0.56))], "company string, q_int int, cur_idx int, hist_idx int, sim double")
    assert [r.label for r in vectors.continuity(df, 0.80, 0.55).orderBy("hist_idx").collect()] == ["maintained", "rephrased", "dropped", "rephrased"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40))
def test_quantiles_like_pandas(spark, xs):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "date int, i int, x double")
    got = [r.quintile for r in panel.quantiles(df, "x").orderBy("i").collect()]
    s = pd.Series(xs, dtype="float64")
    if s.notna().sum() < 5 or s.nunique() < 2:
        assert set(got) == {None}
        return
    want = pd.qcut(s, 5, labels=False, duplicates="drop")
    assert got == [None if pd.isna(v) else int(v) + 1 for v in want]


def test_winsorise_keeps_nulls(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(100)] + [(1, None)], "date int, x double")
    out = panel.winsorised(df, ["x"]).agg(F.min("x"), F.max("x"), F.count_if(F.col("x").isNull())).first()
    assert (round(out[0], 2), round(out[1], 2), out[2]) == (0.99, 98.01, 1)


def test_calibrate(spark):
    rows = [(0.9, "MAINTAINED", "H"), (0.8, "MAINTAINED", "M"), (0.6, "REPHRASED", "H"), (0.5, "REPHRASED", "L"), (0.3, "DROPPED", "H"), (0.2, "DROPPED", "H"), (0.1, "UNCLEAR", "H")]
    got = calibration.calibrate(spark.createDataFrame(rows, "similarity double, label string, confidence string"), draws=50)
    assert got["maintained"]["auc"] == got["rephrased"]["auc"] == 1.0 and 0.3 < got["maintained"]["calibrated_f1"] <= 0.8
    assert calibration.resolve_thresholds() == (0.65, 0.40, False) and calibration.resolve_thresholds({"maintained": 0.7, "rephrased": 0.5})[2]
    with pytest.raises(ValueError):
        calibration.resolve_thresholds(maintained=0.3)


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps({"transcript_id": "t1", "components": [{"text": "x", "component_type": 2}]}))
    (tmp_path / "j/b.json").write_text(json.dumps({"content": "y"}))
    (tmp_path / "j/c.json").write_text("{broken")
    got = {r.transcript_id: r.components[0].text for r in io.read_json_dir(spark, f"{root}/j").collect()}
    assert got == {"t1": "x", "b": "y"}
    (tmp_path / "l.jsonl").write_text('{"transcript_id":"a","n":1}\nbad\n{"n":3}\n{"transcript_id":"a","n":2}\n')
    assert [tuple(r) for r in io.read_jsonl(spark, f"{root}/l.jsonl", "transcript_id string, n int").collect()] == [("a", 2)]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    io.append_new(df, f"{root}/out", "k")
    io.append_new(df.union(spark.createDataFrame([("c", 3)], df.schema)), f"{root}/out", "k")
    assert spark.read.json(f"{root}/out").count() == 3
    io.write_json_artefact(spark, {"m": 0.65}, f"{root}/meta")
    assert io.read_json_artefact(spark, f"{root}/meta") == {"m": 0.65} and io.read_json_artefact(spark, f"{root}/none") is None
    assert io.stage_status(spark, {"x": [f"{root}/meta"], "y": [f"{root}/meta", f"{root}/no"], "z": [f"{root}/no"]}) == {"x": "ready", "y": "partial", "z": "missing"}
    assert io.first_existing(spark, root, ["no", "meta"]).endswith("/meta")


def test_transcripts(spark):
    raw = spark.createDataFrame([("18.0", "2", None, " 2023q4 ", None), ("19", "3", "b", "x", "2022-05-01"), ("20", "9", "c", "2020Q1", None)], "companyid string, component_type_id string, componenttext string, quarter string, event_date string").withColumn("event_date", F.to_date("event_date"))
    got = {r.transcript_id: r.text for r in io.transcripts(raw).collect()}
    assert got == {"18_2023Q4": "", "19_2022Q2": "b"}


def test_client_failures_are_rows(spark):
    def client(text):
        if "bad" in text:
            raise RuntimeError("no")
        return '[{"metric_name": "m", "numerical_value": 3}]'

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, chunk string")
    got = {r.id: (r.metric_name, r.numerical_value, r.error) for r in extraction.extract_with(df, client, ["id"]).collect()}
    assert got == {1: ("m", 3.0, None), 2: (None, None, "no")}


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("src", "out", "ck"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).write.mode("append").parquet(src)
        append_stream(spark.readStream.schema("id long").parquet(src), lambda d: d.where("id % 2 = 0"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_calibration_by_cells(spark):
    """The fit is that of the rows, the interval that of draws of rows, at any size; weights are those of the labels."""
    rng = np.random.default_rng(3)
    rows = [(i, float(round(x, 4)), "MAINTAINED" if x + rng.normal(0, 0.15) > 0.5 else "DROPPED", "HML"[i % 3]) for i, x in enumerate(rng.uniform(0, 1, 400))]
    pairs = spark.createDataFrame(rows, "doc_id long, similarity double, label string, confidence string")
    got = calibration.calibrate(pairs, 300)["maintained"]
    x, y, w = np.array([r[1] for r in rows]), np.array([r[2] == "MAINTAINED" for r in rows], float), np.array([{"H": 1.0, "M": 0.7, "L": 0.3}[r[3]] for r in rows])
    z = got["logistic"]["beta"] * x + got["logistic"]["intercept"]
    p = 1 / (1 + np.exp(-z))
    assert abs((w * (p - y)).sum()) < 1e-3 and abs((w * (p - y) * x).sum()) < 1e-3 and got["n"] == 400
    draws = [calibration.f1_threshold(x[i], y[i], w[i]) for i in (rng.integers(0, 400, 400) for _ in range(300))]
    assert max(abs(a - b) for a, b in zip(got["bootstrap_ci_95"], np.percentile(draws, [2.5, 97.5]))) < 0.06
    with pytest.raises(Exception, match="unknown label"):
        calibration.weighted_labels(pairs.withColumn("confidence", F.lit("Q"))).count()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_ordered(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    known = [x for x in xs if x is not None]
    got = ordered.exact_quantiles(df, F.col("x"), [0.0, 0.2, 0.5, 1.0]).first().q
    if not known:
        assert got is None
        return
    assert np.allclose(got, np.quantile(known, [0.0, 0.2, 0.5, 1.0]))
    ranks = {r.x: r["rank"] for r in ordered.average_ranks(df, "x").collect()}
    s = pd.Series(known)
    assert all(ranks[x] == r for x, r in zip(s, s.rank()))


def test_quantiles_of_ties(spark):
    """A quantile between equal values is that value to the last bit, so rows tied at an edge stay in the group up to it."""
    for x in (0.03977284, 0.04027616, 0.1):
        for n in (4, 7, 33):
            df = spark.createDataFrame([(x,)] * n, "x double").repartition(2)
            assert ordered.exact_quantiles(df, F.col("x"), [0.2, 0.4, 0.6, 0.8]).first().q == [x] * 4
    scores = spark.createDataFrame([(i, (0.03977284, 0.04027616, 0.1)[i // 8]) for i in range(24)], "company int, mt double")
    cars = spark.createDataFrame([(i, 0.01 * i) for i in range(24)], "company int, car double")
    assert {r.mt_group: r.n for r in stats.return_groups(cars, scores).collect()} == {1: 16, 2: 8}
    assert stats.welch_high_low(cars.join(scores, "company"), "car", "mt").first()["n_low"] == 8


def test_scores_do_not_depend_on_the_order_of_months(spark, monkeypatch):
    """An average that ends in a 5 at the ninth place is rounded alike however its months lie."""
    from driftlens.plans import q_universe

    rng = np.random.default_rng(3)
    months = [0.03 + round(float(x), 8) for x in rng.integers(0, 2_000_000, 82) / 1e8]
    months[0] = round(months[0] + (41 - sum(round(x * 1e8) for x in months) % 82) / 1e8, 8)
    rows = [(i, float(x)) for i in range(40) for x in rng.permutation(months)]
    df = spark.createDataFrame(rows, "company int, mt_lenient double").coalesce(1)
    monkeypatch.setattr(q_universe.X, "firm_months", lambda s, d: df)
    got = {r.mt for r in q_universe._scores(spark, "").collect()}
    assert len(got) == 1 and abs(got.pop() - sum(months) / 82) < 1e-8


def test_events_move_days_once(spark):
    """The days of a company go out to it once, not to each date that they could serve or place that is looked up."""
    from driftlens.operators.events import abnormal_returns

    days = spark.sql("select c as company, date_add(date '2020-01-01', cast(i * 2 as int)) as date, (i * 7 + c) % 11 / 100D as ret, i % 5 / 100D as mkt_ret from (select explode(sequence(0, 2)) as c), (select explode(sequence(0, 99)) as i)").localCheckpoint()
    events = spark.createDataFrame([(0, 60, "a"), (0, 60, "b"), (1, 61, "a"), (2, 199, "a"), (2, 202, "a")], "company int, d int, more string").selectExpr("company", "date_add(date '2020-01-01', d) as event_date", "more")
    out = abnormal_returns(days, events, est=(-20, -3), window=(-1, 1), min_est=10)
    rows = sorted((r.company, r.event_pos, r.n_est_obs, r.n_event_days) for r in out.collect())
    assert rows == [(0, 31, 18, 3), (1, 31, 18, 3), (2, 100, 18, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("ExistingRDD") <= 2


def test_limited_client():
    now, slept, calls = [0.0], [], []

    def sleep(t):
        slept.append(t)
        now[0] += t

    def client(text):
        calls.append(text)
        if text == "down" or len(calls) % 4 == 0:
            raise RuntimeError("busy")
        return "ok" * 10

    c = extraction.LimitedClient(client, requests=6, tokens=1000, retries=2, base=1, cap=3, sleep=sleep, clock=lambda: now[0])
    assert [c(t) for t in ("a" * 400, "b" * 400, "c" * 400, "d" * 400)] == ["ok" * 10] * 4
    assert c.counters["replies"] == 4 and c.counters["retries"] == 1 and c.counters["tokens_in"] == 400
    with pytest.raises(RuntimeError):
        c("down")
    assert c.counters["failures"] == 1 and c.counters["requests"] == 8 and now[0] >= 10 and c.counters["waited"] > 0
    big = extraction.LimitedClient(lambda t: "", tokens=10, sleep=sleep, clock=lambda: now[0])
    assert big("x" * 4000) == "" and big.counters["empty"] == 1


def test_csv_and_repair(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "l.csv").write_text("pair_id,label,similarity,more\n1,MAINTAINED,0.5,x\n2,DROPPED,bad,y\n")
    schema, allowed = "pair_id long, label string, similarity double", {"label": ("MAINTAINED", "DROPPED")}
    assert [tuple(r) for r in io.read_csv_checked(spark, f"{root}/l.csv", schema, allowed).collect()] == [(1, "MAINTAINED", 0.5), (2, "DROPPED", None)]
    with pytest.raises(Exception, match="label can't be"):
        io.read_csv_checked(spark, f"{root}/l.csv", schema, {"label": ("MAINTAINED",)}).collect()
    with pytest.raises(ValueError):
        io.read_csv_checked(spark, f"{root}/l.csv", "pair_id long, weight double", {})
    (tmp_path / "r.jsonl").write_text('{"transcript_id":"a","n":1}\nbad\n')
    assert io.repaired(spark, f"{root}/r.jsonl", f"{root}/t", "transcript_id string, n int") == 1
    (tmp_path / "r.jsonl").write_text('{"transcript_id":"a","n":1}\n{"transcript_id":"b","n":2}\n')
    assert io.repaired(spark, f"{root}/r.jsonl", f"{root}/t", "transcript_id string, n int") == 2 and spark.read.parquet(f"{root}/t.bak").count() == 1


def test_announcement_conclusion(spark):
    rng = np.random.default_rng(1)
    mt = [(i, float(x)) for i, x in enumerate(rng.uniform(0, 1, 60))]
    scores = spark.createDataFrame(mt, "company int, mt double")
    tied = spark.createDataFrame([(i, 0.5 * x + float(rng.normal(0, 0.01))) for i, x in mt], "company int, car double")
    loose = spark.createDataFrame([(i, float(rng.normal(0, 1))) for i, _ in mt], tied.schema)
    a, b, c = (stats.announcement_effect(t, scores).first() for t in (tied, loose, tied.where("false")))
    assert (a.conclusion, c.conclusion, c.n) == ("related", "insufficient data", 0) and abs(a.beta - 0.5) < 0.05 and a.n_high == a.n_low == 12
    assert b.conclusion == ("not related" if b.p_mt > 0.1 else "related")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    data, out = "/root/testdata/sf0.001", f"file://{tmp_path}/out"
    assert cli.main(["list"], spark) == 0 and "exact_mt" in capsys.readouterr().out
    assert cli.main(["run", "--data", data, "--out", out, "--stop", "matching", "--skip", "matching"], spark) == 0
    assert capsys.readouterr().out == "targets\tdone\nbaseline\tdone\n"
    assert cli.main(["status", "--out", out], spark) == 0 and capsys.readouterr().out.endswith("next\tmatching\n")
    assert cli.main(["run", "--data", data, "--out", out, "--dry-run"], spark) == 0 and "evaluation\tplanned" in capsys.readouterr().out
    monkeypatch.setitem(cli.STAGES, "baseline", lambda *a: 1 / 0)
    assert cli.main(["run", "--data", data, "--out", out, "--start", "baseline", "--stop", "matching", "--continue-on-error"], spark) == 1
    assert capsys.readouterr().out == "baseline\tfailed: division by zero\nmatching\tdone\n"
    assert cli.main(["run", "--data", data, "--out", out, "--start", "reports", "--stop", "reports"], spark) == 0
    r = spark.read.parquet(f"{out}/reports").toPandas()
    assert (r.n_nonfinancial <= r.n_dropped).all() and 0 < r.n_nonfinancial.sum() < r.n_dropped.sum()
    share = lambda a, b: (a / b.where(b > 0)).fillna(0)
    score = 0.5 * share(r.n_dropped, r.n_total) + 0.3 * share(r.n_persistent, r.n_dropped) + 0.2 * share(r.n_nonfinancial, r.n_dropped)
    assert np.allclose(r.risk_score, score.clip(0, 1)) and r.risk_score.nunique() > 3
    assert cli.main(["query", "none", "--data", data], spark) == 2 and cli.main(["query", "mt_summary", "--data", data, "--out", f"{out}/q"], spark) == 0
    assert spark.read.parquet(f"{out}/q").count() == 1
    with pytest.raises(ValueError):
        cli.chosen("nowhere", None, [])
    capsys.readouterr()
    assert cli.main(["thresholds", "--maintained", "0.7"], spark) == 0 and capsys.readouterr().out == "maintained\t0.7\nrephrased\t0.4\nstored\tFalse\n"


def test_shown_contexts(spark):
    cases = [
        (89.5e9, "USD_millions", "up", None, "FY24", "x", "$89.50B · up · FY24"), (12.5, "percent", None, "next_quarter", None, "x", "12.5 percent · next quarter"), (None, "percent", "", "", None, "the raw text", "the raw text"),
        (1234.0, "none", None, None, None, None, "1.2K"), (0.0, "", None, None, None, None, "0"), (-2.5e6, None, None, None, None, None, "-2.50M"), (None, None, None, None, None, None, ""), (None, None, None, None, None, "y" * 300, "y" * 160),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, v double, u string, t string, f string, p string, r string")
    got = [r.s for r in df.select("i", T.shown_context(*[F.col(c) for c in "vutfpr"]).alias("s")).orderBy("i").collect()]
    assert got == [c[6] for c in cases]
    numbers = [0.0, 1.0, 100.0, 999.9994, 123.4567891, 12.3456789, 1.23456789, 0.5, 0.1234567, 0.012345678, 0.00012345678, 0.000012345678, 1e-7, -3.10, -0.00001]
    some = spark.createDataFrame(list(enumerate(numbers)), "i int, v double")
    assert [r.s for r in some.select("i", T.humanised(F.col("v")).alias("s")).orderBy("i").collect()] == [f"{v:g}" for v in numbers]
    assert one(spark, a=T.component_label(F.lit(2), T.CALL_COMPONENTS), b=T.component_label(F.lit(1)), n=F.length(T.stored_context(F.repeat(F.lit("x"), 600)))) == ("Mgmt Presentation", "press release", 512)


def test_extraction_of_transcripts(spark):
    """Known targets spare the client; components, else the text, else an error; failing chunks leave theirs."""
    calls = spark.createDataFrame([("a", "ta"), ("b", None), ("c", "flat text"), ("d", " "), ("e", None), ("b", None)], "transcript_id string, text string")
    parts = spark.createDataFrame([("a", 2, 0, "x"), ("b", 4, 1, "two."), ("b", 4, 0, "one."), ("b", 2, 5, "bad"), ("d", 2, 0, " \n"), ("z", 2, 0, "other")], "transcript_id string, ctype int, ord int, text string")
    known = spark.createDataFrame([("a", 1, "m2"), ("a", 0, "m1"), ("zz", 0, "m")], "transcript_id string, pos int, metric_name string")
    for f in extraction.TARGET_FIELDS[1:]:
        known = known.withColumn(f, F.lit(None).cast("double" if f == "numerical_value" else "string"))

    def client(text):
        if "bad" in text:
            raise ValueError("no reply")
        return json.dumps([{"metric_name": w} for w in text.split()])

    got = {r.transcript_id: ([t.metric_name for t in r.targets], r.errors) for r in extraction.extracted(calls, parts, client, known).collect()}
    assert got == {"a": (["m1", "m2"], []), "b": (["one.", "two."], ["no reply"]), "c": (["flat", "text"], ["no components: the text is read as one"]), "d": ([], ["no text and no components"]), "e": ([], ["no text and no components"])}
    got = {r.transcript_id: (r.targets, r.errors) for r in extraction.extracted(calls, parts, None).collect()}
    assert got["b"] == ([], ["no client"]) and got["c"][1] == ["no client", "no components: the text is read as one"] and got["d"] == ([], ["no text and no components"])


def test_calls_at_once_and_totals(spark, tmp_path):
    """Totals are the calls that were made; no more than so many are under way; limits are shares; replies keep their chunks."""
    log = str(tmp_path / "calls")

    def client(text):
        import os
        import time as t

        began = t.time()
        t.sleep(0.02)
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {began} {t.time()} {text}\n")
        if text.startswith("bad") or text == "once" and sum(line.endswith(" once\n") for line in open(log)) < 2:
            raise ValueError("no")
        return "" if text == "none" else f'[{{"metric_name": "{text}"}}]'

    texts = [f"t{i}" for i in range(60)] + ["bad", "bad2", "none", "once"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, chunk string").coalesce(2)
    totals = extraction.Totals(spark)
    limited = extraction.LimitedClient(client, requests=6000, retries=2, base=0.001)
    got = extraction.extract_with(df, limited, ["id"], at_once=4, totals=totals).collect()
    assert {(r.id, r.metric_name) for r in got if r.error is None} == {(i, t) for i, t in enumerate(texts) if not t.startswith("bad") and t != "none"}
    assert {r.id for r in got if r.error == "no"} == {60, 61}
    calls = [line.split() for line in open(log)]
    v = totals.values()
    assert v["requests"] == len(calls) == 60 + 2 * 3 + 1 + 2 and (v["failures"], v["retries"], v["empty"], v["replies"]) == (2, 5, 1, 61)
    for pid in {c[0] for c in calls}:
        own = [(float(c[1]), float(c[2])) for c in calls if c[0] == pid]
        assert max(sum(a <= x < b for a, b in own) for x, _ in own) <= 4
    assert max(sum(a <= x < b for a, b in ((float(c[1]), float(c[2])) for c in calls)) for x in (float(c[1]) for c in calls)) > 1
    share = limited.divided(4)
    assert share.most[0] == 1500 and share.rates[0] == 25 and limited.divided(10**9).most == (1.0, 1.0)


def test_stages_know_whether_they_are_current(spark, tmp_path, monkeypatch):
    """A touched input makes its stage and the later ones run, and no other; so does changed code, and a run that was cut off."""
    import shutil

    data, out = tmp_path / "data", f"file://{tmp_path}/out"
    data.mkdir()
    for t in ("part", "supplier", "lineitem", "embeddings"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", data / f"{t}.parquet")
        (data / f"{t}.parquet").chmod(0o644)
    names = ["targets", "baseline", "matching"]
    run = lambda: list(cli.run_stages(spark, f"file://{data}", out, names).values())
    shown = lambda: [cli.status(spark, out)[0][n] for n in names]
    assert run() == ["done"] * 3 and run() == ["current"] * 3 and shown() == ["ready"] * 3
    (data / "embeddings.parquet").touch()
    assert shown() == ["ready", "ready", "stale"] and run() == ["current", "current", "done"]
    pd.read_parquet(data / "part.parquet").to_parquet(data / "part.parquet")
    assert shown() == ["stale", "stale", "ready"] and cli.status(spark, out)[1] == "targets" and run() == ["done", "done", "current"]
    with monkeypatch.context() as m:
        m.setitem(cli.STAGES, "baseline", lambda s, d, o: s.range(3))
        assert shown() == ["ready", "stale", "ready"] and run() == ["current", "done", "current"]
    with monkeypatch.context() as m:
        m.setattr(cli.io, "write_parquet", lambda *a: 1 / 0)
        assert cli.run_stages(spark, f"file://{data}", out, names, force=True)["targets"].startswith("failed")
    assert shown() == ["stale", "stale", "ready"] and run() == ["done", "done", "current"]


def test_embedding_encoder_is_replaceable(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, "ab")], "id int, t string")
    got = {r.id: r.v for r in embedding.embedded(df, "t").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12 and not any(got[2]) and not any(got[3]) and len(got[1]) == embedding.DIM
    own = embedding.embedded(df, "t", "w", lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2)
    assert {r.id: r.w for r in own.collect()} == {1: [4.0, 1.0], 2: [0.0, 1.0], 3: [2.0, 1.0]}


def test_comparison(spark):
    from driftlens.operators import comparison as C

    a = spark.createDataFrame([("x", 0.01, 1.0, 0.3), ("y", None, None, None)], "variable string, mean_coef double, nw_tstat double, p_value double")
    b = spark.createDataFrame([("x", 0.03, 3.0, 0.01), ("y", 0.1, 2.5, float("nan"))], a.schema)
    got = {r.variable: r for r in C.alpha_comparison(a, b, ["variable"]).collect()}
    assert abs(got["x"].alpha_improvement - 0.02) < 1e-12 and got["x"].other_significant and not got["x"].base_significant
    assert got["y"].alpha_improvement is None and not got["y"].other_significant
    side = [F.lit(v) for v in (0.01, 0.03, False, True)]
    assert one(spark, v=C.verdict(F.lit(-0.9), *side), w=C.verdict(F.lit(-0.9), F.lit(None).cast("double"), *side[1:])).asDict() == {"v": "OTHER_BETTER", "w": "BASE_BETTER"}
    doc = C.latex_document([r.line for r in C.latex_table(a.where("variable = 'x'"), "variable", ["mean_coef", "p_value"]).collect()], ["V", "A", "P"])
    assert doc.splitlines()[4] == r"x & 0.010 & 0.300 \\" and doc.startswith(r"\begin{tabular}{lrr}")


def test_training_rows(spark):
    from driftlens.operators import comparison as C

    c = spark.createDataFrame([(1, " grow 5% "), (2, "none"), (3, None), (4, " ")], "id long, text string")
    t = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "c"), (4, 1, "d")], "id long, pos int, name string")
    rows = C.training_rows(c, t, "id", "T {text} A {targets}").collect()
    assert [(r.id, r.answer, r.prompt) for r in rows] == [(1, '[{"name":"a"},{"name":"b"}]', 'T grow 5% A [{"name":"a"},{"name":"b"}]')]
    many = spark.range(2000).select("id", F.lit("x").alias("text"))
    n = C.training_rows(many, many.select("id", F.lit(1).alias("pos"), F.lit("m").alias("name")), "id", "{text}").groupBy("split").count().collect()
    assert {r.split for r in n} == {"train", "test"} and 140 < {r.split: r["count"] for r in n}["test"] < 260


def test_substring_persistence(spark):
    names = ["a", "ab", "revenue", "net revenue growth", "growth of net", "revenue growth in services", "net", "capex"]
    sets = [(1, q, n) for q in range(10, 16) for i, n in enumerate(names) if (q + i) % 3]
    dropped = [(1, q, n) for q in (12, 13, 15) for n in names] + [(2, 12, "ab")]
    frame = spark.createDataFrame(sets, "company int, q_int int, norm string")
    got = {(r.company, r.q_int, r.metric): r.persistent for r in moving_targets.substring_persistence(spark.createDataFrame(dropped, frame.schema), frame, 2).collect()}
    want = {(c, q, n): len({p for k, p, m in sets if k == c and q - 2 <= p < q and (m in n or n in m)}) == 2 for c, q, n in dropped}
    assert got == want and True in want.values() and False in want.values()


def test_blocks_of_vectors(spark):
    """Tiles of any size give the pairs of a plain loop; best matches and the log follow them; ties go to the smallest idx."""
    rng = np.random.default_rng(6)
    rows = [("a" if i % 9 else "b", i % 6, i, rng.integers(-2, 3, 5).astype(float).tolist(), f"n{i % 2}") for i in range(120)]
    rows += [("a", 4, 200, [0.0] * 5, "zero"), ("a", 0, 201, None, "null"), ("c", 0, 202, [1.0] * 5, "alone"), ("a", 0, 203, [0.0] * 5, "zero")]
    v = spark.createDataFrame(rows, "company string, q_int int, idx long, v array<double>, name string")

    def cosine(x, y):
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return float(np.dot(x, y) / n) if n else 0.0

    want = {(c, q, i, j): cosine(x, y) for c, q, i, x, _ in rows for d, p, j, y, _ in rows if x and y and c == d and p == q - 4}
    best = {}
    for (c, q, i, j), s in sorted(want.items()):
        if (c, q, j) not in best or round(s, 9) > best[c, q, j][0]:
            best[c, q, j] = (round(s, 9), i)
    for tile in (1, 7, 512):
        got = {tuple(r)[:4]: r.sim for r in vectors.pair_similarities(v, tile=tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        c = vectors.continuity(vectors.best_matches(v, tile=tile)).collect()
        assert {(r.company, r.q_int, r.hist_idx): (r.sim, r.cur_idx) for r in c} == best
        log = vectors.pair_log(v, tile=tile).collect()
        assert {(r.company, r.q_int, r.cur_idx, r.hist_idx) for r in log} == want.keys() and len(log) == len(want)
        assert {(r.company, r.q_int, r.hist_idx): r.cur_idx for r in log if r.is_best} == {k: i for k, (_, i) in best.items()}
        assert {r.label for r in log} == {"maintained", "rephrased", "dropped"} and any(r.historical_label == "n1 (0Q1) [6]" or r.historical_label == "n0 (0Q1) [6]" for r in log)
    assert vectors.pair_log(v.limit(0)).count() == 0 and {r.q_int for r in vectors.pair_similarities(v, window=2).collect()} == {1, 2, 3, 4, 5}
