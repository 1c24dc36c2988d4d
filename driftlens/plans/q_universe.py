"""Queries of the firm universe: scans, members, slices, panels, and what is made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quarters as Q
from ..functions import scoring as S
from ..functions import text as T
from ..operators import embedding as E
from ..operators import events as EV
from ..operators import relational as RL
from ..operators import report as R
from ..operators import stats as ST
from ..operators import universe as U
from ..operators import vectors as V
from ..sources import io
from ..sources import standins as X

# scans


def index_members(s, d):
    o = X.read(s, d, "orders").select(F.col("o_custkey").alias("gvkey"), F.to_date("o_orderdate").alias("sp_from"), F.col("o_orderpriority").alias("gvkeyx"))
    return U.flagged(o, {"gvkeyx": "1-URGENT"}).select("gvkey", "sp_from")


def fundamentals_scan(s, d):
    x = X.read(s, d, "lineitem")
    return U.flagged(x, {"l_returnflag": "N", "l_linestatus": "O", "l_linenumber": 1, "l_tax": 0.0}).select("l_orderkey", "l_partkey", "l_extendedprice")


def forecast_scan(s, d):
    o = X.read(s, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return U.within(U.flagged(o, {"o_orderpriority": "3-MEDIUM"}), "day", "1996-01-01", "1997-12-31").select("o_orderkey", "day", "o_totalprice")


def _factors(s, d):
    x = X.read(s, d, "lineitem").withColumn("date", F.last_day("l_shipdate"))
    f = x.groupBy("date").agg(F.round(F.avg("l_discount"), 8).alias("mktrf"), F.round(F.avg("l_tax"), 8).alias("smb"))
    umd = x.where("l_returnflag = 'R' AND month(date) <> 7").groupBy("date").agg(F.round(F.avg("l_quantity"), 6).alias("umd"))
    return f, umd


_FACTORS = """f AS (SELECT last_day(l_shipdate::DATE) AS date, round(avg(l_discount), 8) AS mktrf, round(avg(l_tax), 8) AS smb FROM lineitem GROUP BY ALL),
umd AS (SELECT last_day(l_shipdate::DATE) AS date, round(avg(l_quantity), 6) AS umd FROM lineitem WHERE l_returnflag = 'R' AND month(l_shipdate) <> 7 GROUP BY ALL)"""


def factor_join(s, d):
    return U.with_momentum_factor(*_factors(s, d))


def factor_fallback(s, d):
    return U.with_momentum_factor(_factors(s, d)[0], None)


def company_map(s, d):
    c = X.read(s, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("gvkey"), F.col("c_mktsegment").alias("companyid"))
    return U.id_map(c, "gvkey", "companyid")


def company_tickers(s, d):
    """The first order of each customer names it; its priority stands for a ticker where it has none of its own."""
    o = X.read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" q"), F.col("o_orderkey").cast("string"))).alias("own"))
    first = RL.first_rows(o, "o_custkey", "o_orderkey")
    ticker = T.ticker_of(F.col("own"), F.col("o_orderpriority"), ["urgent", "high", "low"], {"5-LOW": "LO"})
    return first.select(F.col("o_custkey").alias("companyid"), "o_orderkey", ticker.alias("ticker"))


def fundamentals_join(s, d):
    """Mean prices of a customer's orders by quarter beside those of its segment in that quarter."""
    o = X.read(s, d, "orders").join(X.read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    o = o.withColumn("fp", Q.of_date(F.col("o_orderdate")))
    forecasts = o.groupBy(F.col("c_mktsegment").alias("ticker"), "fp", "o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("meanest"))
    fundamentals = o.where("o_orderstatus = 'F'").groupBy(F.col("c_mktsegment").alias("ticker"), "fp").agg(F.round(F.max("o_totalprice"), 4).alias("actual"))
    return U.with_fundamentals(forecasts, fundamentals).groupBy("ticker", "fp").agg(F.count(F.lit(1)).alias("n"), F.count("actual").alias("n_actual"), F.max("meanest").alias("most"), F.max("actual").alias("actual"))


def raw_universe(s, d):
    t = X.targets(s, d).join(X.read(s, d, "nation").select(F.col("n_nationkey").alias("company"), "n_name"), "company")
    return t.select(F.upper("n_name").alias("ticker"), F.concat(F.floor(F.col("q_int") / 4).cast("string"), F.lit("Q"), (F.pmod("q_int", F.lit(4)) + 1).cast("string")).alias("quarter")).distinct()


# members


def _members(s, d):
    o = X.read(s, d, "orders")
    m = o.groupBy(F.col("o_custkey").alias("gvkey")).agg(F.to_date(F.min("o_orderdate")).alias("sp_from"), F.to_date(F.max("o_orderdate")).alias("sp_thru"))
    m = m.withColumn("sp_thru", F.when(F.col("gvkey") % 3 != 0, F.col("sp_thru")))
    at = F.to_date("o_orderdate")
    links = o.select(F.col("o_custkey").alias("gvkey"), (F.col("o_orderkey") % 100 + 1).alias("permno"), at.alias("linkdt"), F.when(F.col("o_orderstatus") != "O", F.date_add(at, 90)).alias("linkenddt"))
    return m, links


_MEMBERS = """m AS (SELECT o_custkey AS gvkey, min(o_orderdate)::DATE AS sp_from, CASE WHEN o_custkey % 3 <> 0 THEN max(o_orderdate)::DATE END AS sp_thru FROM orders GROUP BY o_custkey),
l AS (SELECT o_custkey AS gvkey, o_orderkey % 100 + 1 AS permno, o_orderdate::DATE AS linkdt, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 90 END AS linkenddt FROM orders),
p AS (SELECT DISTINCT gvkey, permno FROM m JOIN l USING (gvkey) WHERE sp_from <= DATE '1997-06-30' AND (sp_thru IS NULL OR sp_thru >= DATE '1997-01-01')
  AND linkdt <= DATE '1997-06-30' AND coalesce(linkenddt, DATE '2099-12-31') >= DATE '1997-01-01')"""
_WINDOW = ("1997-01-01", "1997-06-30")


def member_links(s, d):
    return U.member_links(*_members(s, d), "gvkey", *_WINDOW)


def _months(s, d):
    names = X.read(s, d, "supplier").select(F.col("s_suppkey").alias("permno"), "s_name")
    m = X.firm_months(s, d).select(F.col("company").alias("permno"), "date", "mktcap")
    return m.join(names, "permno").select("permno", "date", "mktcap", F.concat_ws("-", "s_name", F.date_format("date", "yyyyMM")).alias("ticker"), F.col("s_name").alias("name"))


def top_members(s, d):
    out = U.top_members(_months(s, d), U.member_links(*_members(s, d), "gvkey", *_WINDOW), 10, 12)
    return out.select("permno", F.round("avg_mcap", 6).alias("avg_mcap"), "n_months", "ticker", "name", "gvkey")


def universe_months(s, d):
    return U.only_members(X.firm_months(s, d).select(F.col("company").alias("permno"), "date", F.round("ret", 6).alias("ret")), U.member_links(*_members(s, d), "gvkey", *_WINDOW), "permno")


# targets


def _raw_targets(s, d):
    p = X.read(s, d, "part")
    return p.select(
        F.concat((F.col("p_size") % 10).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise("")).alias("company_id"),
        F.concat((F.lit(1995) + F.col("p_partkey") % 3).cast("string"), F.lit("Q"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("quarter"),
        F.when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("metric_name"),
        F.col("p_brand").alias("raw_text"),
        F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM").alias("is_financial"),
    )


_LOADED = """lt AS (SELECT (p_size % 10)::VARCHAR AS company_id, (1995 + p_partkey % 3)::VARCHAR || 'Q' || (p_partkey % 4 + 1)::VARCHAR AS quarter, p_name AS metric_name, p_brand AS context,
  p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') AS is_financial FROM part WHERE p_partkey % 11 <> 0)"""


def loaded_targets(s, d):
    return U.loaded_targets(_raw_targets(s, d))


def target_slice(s, d):
    names = X.read(s, d, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").cast("string").alias("company_id"), F.col("n_name").alias("ticker"))
    out = U.sliced(U.loaded_targets(_raw_targets(s, d)), names, ["1995Q1", "1996Q2", "1997Q4"])
    return out.select("ticker", "quarter", "n_targets", F.element_at("targets", 1)["metric_name"].alias("first_name"), F.element_at("targets", -1)["metric_name"].alias("last_name"))


def transcript_pick(s, d):
    c = X.read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("ticker"), F.concat_ws(" ", "c_name", F.lower("c_mktsegment")).alias("companyname"))
    return c.where(U.named_like(c, "Building")).select("c_custkey", "companyname")


def dropped_display(s, d):
    k = F.col("o_orderkey")
    o = X.read(s, d, "orders").select(
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("metric_name"),
        F.col("o_orderstatus").alias("metric"),
        F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.lit("1997Q1")).alias("last_seen_quarter"),
        F.when(k % 5 == 0, F.lit("1996Q4")).alias("last_seen"),
        (k % 2 == 0).alias("is_financial"),
        (k % 3).alias("persistent_count"),
    )
    return U.dropped_rows(o).groupBy("target_name", "last_seen", "type", "persistence").agg(F.count(F.lit(1)).alias("n"))


def signal_join(s, d):
    m = X.firm_months(s, d)
    a = m.where("month(date) <> 3").select("company", "date", F.when(F.col("company") % 9 != 0, F.col("mt_strict")).alias("mt"), F.lit(1).alias("own"))
    return U.common_join(a, m.select("date", "company", F.col("mt_lenient").alias("mt")), "mt", ("mt_base", "mt_other"))


def target_summary(s, d):
    t = U.loaded_targets(_raw_targets(s, d)).select(
        (F.length("metric_name") * 7 % 13).cast("long").alias("transcript"),
        "is_financial",
        F.when(F.col("context").endswith("1"), "high").when(F.col("context").endswith("2"), "medium").alias("confidence"),
        F.when(F.col("quarter").startswith("1995"), "past").when(F.col("quarter").startswith("1996"), "future").alias("temporal_framing"),
    )
    return U.target_summary(t, s.range(20).select(F.col("id").alias("transcript")), "transcript")


def transcript_ids(s, d):
    """Components with the names of another provider, their quarter from text or date."""
    raw = X.components(s, d).select(
        F.concat(F.col("transcript_id").cast("string"), F.when(F.col("transcript_id") % 2 == 0, ".0").otherwise("")).alias("companyid"),
        F.col("ctype").cast("string").alias("component_type_id"),
        F.when(F.col("ord") % 3 != 0, F.col("text")).alias("componenttext"),
        F.when(F.col("ord") % 2 == 0, F.concat(F.lit(" 201"), (F.col("transcript_id") % 10).cast("string"), F.lit("q3 "))).alias("quarter"),
        F.to_date(F.concat(F.lit("201"), (F.col("transcript_id") % 10).cast("string"), F.lit("-05-17"))).alias("event_date"),
    )
    return io.transcripts(raw).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("text") == "").cast("long")).alias("n_empty"), F.min("component_type").cast("long").alias("least_type"))


def column_find(s, d):
    labels = F.array(F.lit("Small Ring"), F.lit("red bolt"), F.lit("Blue Gear"), F.lit("hot WIDGET ring"), F.lit("nut"))
    p = X.read(s, d, "part")
    return p.select("p_partkey", U.first_containing(labels, F.element_at(F.split("p_name", " "), -1)).cast("long").alias("place"))


# vectors


def embedded_names(s, d):
    p = E.embedded(X.read(s, d, "part").select("p_partkey", "p_name"), "p_name")
    return p.select("p_partkey", F.posexplode("v").alias("place", "value")).where("value <> 0").select("p_partkey", F.col("place").cast("long").alias("place"), F.round("value", 9).alias("value"))


def best_bounds(s, d):
    pairs = V.pair_similarities(X.vectors(s, d), 4).withColumn("sim", F.round("sim", 9)).withColumn("kept", F.col("cur_idx") % 3 == F.col("hist_idx") % 3)
    grid = [0.05 * i for i in range(2, 7)], [0.02 * i for i in range(1, 6)]
    return V.best_bounds(V.threshold_grid(pairs, *grid)).select(F.round("m", 6).alias("m"), F.round("r", 6).alias("r"), F.round("fp_rate", 9).alias("fp_rate"))


# panels and events


def full_panel(s, d):
    m = X.firm_months(s, d)
    fund = m.select("company", "date", (F.col("mt_strict") * 1000 * F.when(F.col("company") % 6 != 0, 1)).alias("book_equity"), "mktcap")
    sue = m.where("month(date) % 3 = 0").select("company", "date", S.surprise(F.col("mktcap"), F.lit(100.0), F.col("rev") / 1000).alias("sue"))
    p = U.assembled_panel(m.select("company", "date", "mt_strict"), m.select("company", "date", "ret", "mktcap_lag"), fund, sue, U.with_momentum_factor(*_factors(s, d)), clip=("ret_fwd", "size"))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return p.select("company", "date", r("ret_fwd"), r("size"), r("logbm"), r("sue"), r("mktrf"), r("umd"), r("ret_1_0"))


def _daily(s, d):
    x = X.read(s, d, "lineitem")
    u = x.groupBy(F.col("l_suppkey").alias("company"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_discount") / 10, 9).alias("ret"))
    mkt = u.groupBy("date").agg(F.round(F.avg("ret"), 9).alias("mkt_ret"))
    ev = x.where("l_returnflag = 'N' AND l_linenumber = 7").select(F.col("l_suppkey").alias("company"), F.to_date("l_shipdate").alias("event_date")).distinct()
    return u.join(mkt, "date").select("company", "date", "ret", "mkt_ret"), ev


def _cars(s, d):
    return EV.abnormal_returns(*_daily(s, d), est=(-250, -30), window=(-1, 1), min_est=30)


def long_event_cars(s, d):
    return _cars(s, d).select("company", "event_date", "matched_day", "n_est_obs", F.round("alpha_hat", 6).alias("alpha_hat"), F.round("beta_hat", 5).alias("beta_hat"), F.round("car", 6).alias("car"))


def _scores(s, d):
    # added as decimals: in an average that ends in a 5 at the ninth place, the order of adding doubles would tell the eighth
    mean = F.sum(F.col("mt_lenient").cast("decimal(18,8)")).cast("double") / F.count("mt_lenient")
    return X.firm_months(s, d).groupBy("company").agg((F.round(mean * 1e8) / 1e8).alias("mt"))


def announcement_effect(s, d):
    cars = _cars(s, d).select("company", F.round("car", 7).alias("car"))
    out = ST.announcement_effect(cars, _scores(s, d))
    return out.select("n", F.round("beta", 4).alias("beta"), F.round("t_beta", 4).alias("t_beta"), "n_high", "n_low", F.round("welch_t", 4).alias("welch_t"), F.round("p_mt", 5).alias("p_mt"), "conclusion")


def announcement_groups(s, d):
    cars = _cars(s, d).select("company", F.round("car", 7).alias("car"))
    return ST.return_groups(cars, _scores(s, d)).select(F.col("mt_group").cast("long").alias("mt_group"), F.round("mean_x", 6).alias("mean_car"), "n", F.round("t", 3).alias("t"))


_CARS = """u AS (SELECT l_suppkey AS company, l_shipdate::DATE AS date, round(avg(l_discount) / 10, 9) AS ret FROM lineitem GROUP BY ALL),
mkt AS (SELECT date, round(avg(ret), 9) AS mkt_ret FROM u GROUP BY ALL),
dl AS (SELECT company, date, ret, mkt_ret, row_number() OVER (PARTITION BY company ORDER BY date) AS pos FROM u JOIN mkt USING (date)),
ev AS (SELECT DISTINCT l_suppkey AS company, l_shipdate::DATE AS event_date FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 7),
hit AS (SELECT company, event_date, event_date AS matched_day, pos AS event_pos FROM ev JOIN dl USING (company) WHERE date = event_date),
est AS (SELECT a.*, count(*) AS n_est_obs, regr_intercept(ret, mkt_ret) AS alpha_hat, regr_slope(ret, mkt_ret) AS beta_hat FROM hit a JOIN dl ON dl.company = a.company AND pos BETWEEN event_pos - 250 AND event_pos - 30 GROUP BY ALL HAVING count(*) >= 30),
cars AS (SELECT e.*, sum(ret - (alpha_hat + beta_hat * mkt_ret)) AS car FROM est e JOIN dl ON dl.company = e.company AND pos BETWEEN event_pos - 1 AND event_pos + 1 GROUP BY ALL)"""
_PAIRS = f"""WITH {X.MONTHS}, {_CARS}, sc AS (SELECT company, round(avg(mt_lenient), 8) AS mt FROM fm GROUP BY ALL), pr AS (SELECT round(car, 7) AS car, mt FROM cars JOIN sc USING (company)),
qs AS (SELECT quantile_cont(mt, 0.2) AS q20, quantile_cont(mt, 0.8) AS q80 FROM pr)"""


# reports


def _reports(s, d):
    t = X.targets(s, d)
    from ..operators import moving_targets as M

    sets = M.target_sets(t)
    c = M.compared(sets, t.select("company", "q_int").distinct()).where("in_past = 1").join(M.lasting(sets, 2), ["company", "q_int", "norm"], "left")
    n = lambda x: F.sum(F.coalesce(x.cast("long"), F.lit(0)))
    drop = F.col("in_now") == 0
    g = c.groupBy("company", "q_int").agg(F.count(F.lit(1)).alias("n_total"), n(drop).alias("n_dropped"), n(drop & F.col("persistent")).alias("n_persistent"), n(drop & ~F.col("past_financial")).alias("n_nonfinancial"))
    return R.reported(g.withColumn("risk_score", F.round(S.risk_score(*[F.col(x) for x in ("n_total", "n_dropped", "n_persistent", "n_nonfinancial")]), 9)))


_W = f"WITH {X.TARGETS}"
_REPORTS = _W + """, past AS (SELECT c.company, c.q_int, s.norm, s.is_financial AS fin FROM calls c JOIN sets s ON s.company = c.company AND s.q_int = c.q_int - 4),
h AS (SELECT p.*, n.norm IS NULL AS gone, EXISTS (SELECT 1 FROM sets a WHERE a.company = p.company AND a.norm = p.norm AND a.q_int = p.q_int - 1) AND EXISTS (SELECT 1 FROM sets a WHERE a.company = p.company AND a.norm = p.norm AND a.q_int = p.q_int - 2) AS lasting
  FROM past p LEFT JOIN sets n ON n.company = p.company AND n.q_int = p.q_int AND n.norm = p.norm),
g AS (SELECT company, q_int, count(*) AS n_total, count(*) FILTER (gone) AS n_dropped, count(*) FILTER (gone AND lasting) AS n_persistent, count(*) FILTER (gone AND NOT fin) AS n_other FROM h GROUP BY ALL),
r AS (SELECT *, CASE WHEN n_dropped > 0 THEN round(least(greatest(0.5::DOUBLE * (n_dropped / n_total) + 0.3::DOUBLE * (n_persistent / n_dropped) + 0.2::DOUBLE * (n_other / n_dropped), 0), 1), 9) ELSE 0.0 END AS risk_score FROM g),
fl AS (SELECT *, CASE WHEN risk_score > 0.6 THEN 'HIGH' WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_flag FROM r)"""


def kpis(s, d):
    return R.kpis(_reports(s, d))


def resumed_reports(s, d):
    """A run that goes on: calls that are cached are left out, the others scored."""
    done = X.targets(s, d).where("company < 10").select("company", "q_int").distinct()
    return _reports(s, d).join(done, ["company", "q_int"], "left_anti").select("company", "q_int", "n_dropped", "n_persistent", "risk_score", "risk_flag")


def initial_states(s, d):
    st = R.initial_state(X.targets(s, d).select("company", "q_int").distinct())
    return st.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("dropped")).cast("long").alias("most_dropped"), F.max("risk_flag").alias("flag"), F.max("risk_score").alias("score"))


def calendar_quarters(s, d):
    """Quarters by text where it is valid, else by date."""
    o = X.read(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" 1999q2 ")).when(F.col("o_orderkey") % 3 == 1, F.lit("1999Q5"))
    return o.select("o_orderkey", Q.clean(text, F.to_date("o_orderdate")).alias("quarter"))


QUERIES = {
    "index_members": (index_members, "SELECT o_custkey AS gvkey, o_orderdate::DATE AS sp_from FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "fundamentals_scan": (fundamentals_scan, "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 1 AND l_tax = 0.0"),
    "forecast_scan": (forecast_scan, "SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"),
    "factor_join": (factor_join, f"WITH {_FACTORS} SELECT f.date, mktrf, smb, umd FROM f LEFT JOIN umd ON umd.date = f.date"),
    "factor_fallback": (factor_fallback, f"WITH {_FACTORS} SELECT date, mktrf, smb, NULL::DOUBLE AS umd FROM f"),
    "company_map": (company_map, "SELECT DISTINCT c_nationkey AS gvkey, c_mktsegment AS companyid FROM customer WHERE c_custkey % 7 <> 0"),
    "company_tickers": (company_tickers, """WITH f AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY ALL)
      SELECT o_custkey AS companyid, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Q' || o_orderkey WHEN p = '5-LOW' THEN 'LO' WHEN contains(p, 'URGENT') THEN 'URGENT' WHEN contains(p, 'HIGH') THEN 'HIGH' WHEN contains(p, 'LOW') THEN 'LOW' ELSE '' END AS ticker FROM f"""),
    "fundamentals_join": (fundamentals_join, """WITH o AS (SELECT c_mktsegment AS ticker, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS fp, o_custkey, o_totalprice, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
      f AS (SELECT ticker, fp, o_custkey, round(avg(o_totalprice), 4) AS meanest FROM o GROUP BY ALL), a AS (SELECT ticker, fp, round(max(o_totalprice), 4) AS actual FROM o WHERE o_orderstatus = 'F' GROUP BY ALL)
      SELECT ticker, fp, count(*) AS n, count(actual) AS n_actual, max(meanest) AS most, max(actual) AS actual FROM f LEFT JOIN a USING (ticker, fp) GROUP BY ALL"""),
    "raw_universe": (raw_universe, f"{_W} SELECT DISTINCT upper(n_name) AS ticker, (q_int // 4)::VARCHAR || 'Q' || (q_int % 4 + 1)::VARCHAR AS quarter FROM calls JOIN nation ON n_nationkey = company"),
    "member_links": (member_links, f"WITH {_MEMBERS} SELECT gvkey, permno FROM p"),
    "top_members": (top_members, f"""WITH {X.MONTHS}, {_MEMBERS.replace('m AS', 'mb AS').replace('FROM m JOIN', 'FROM mb JOIN')},
      g AS (SELECT company AS permno, avg(mktcap) AS a, count(*) AS n_months, max(date) AS last FROM fm WHERE company IN (SELECT permno FROM p) GROUP BY ALL HAVING count(*) >= 12 ORDER BY a DESC, company LIMIT 10)
      SELECT g.permno, round(a, 6) AS avg_mcap, n_months, s_name || '-' || strftime(last, '%Y%m') AS ticker, s_name AS name, gvkey FROM g JOIN supplier ON s_suppkey = g.permno LEFT JOIN p ON p.permno = g.permno"""),
    "universe_months": (universe_months, f"WITH {X.MONTHS}, {_MEMBERS.replace('m AS', 'mb AS').replace('FROM m JOIN', 'FROM mb JOIN')} SELECT company AS permno, date, round(ret, 6) AS ret FROM fm WHERE company IN (SELECT permno FROM p)"),
    "loaded_targets": (loaded_targets, f"WITH {_LOADED} SELECT * FROM lt"),
    "target_slice": (target_slice, f"""WITH {_LOADED} SELECT n_name AS ticker, quarter, count(*) AS n_targets, min(metric_name) AS first_name, max(metric_name) AS last_name
      FROM lt JOIN nation ON n_nationkey::VARCHAR = company_id WHERE n_nationkey < 6 AND quarter IN ('1995Q1', '1996Q2', '1997Q4') GROUP BY ALL"""),
    "transcript_pick": (transcript_pick, "SELECT c_custkey, c_name || ' ' || lower(c_mktsegment) AS companyname FROM customer WHERE (c_custkey % 5 <> 0 AND c_mktsegment = 'BUILDING') OR contains(upper(c_name || ' ' || c_mktsegment), 'BUILDING')"),
    "dropped_display": (dropped_display, """SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE o_orderstatus END AS target_name,
      CASE WHEN o_orderkey % 3 = 0 THEN 'prior quarter' WHEN o_orderkey % 3 = 1 THEN '1997Q1' WHEN o_orderkey % 5 = 0 THEN '1996Q4' ELSE 'prior quarter' END AS last_seen,
      CASE o_orderkey % 2 WHEN 0 THEN 'financial' ELSE 'non-financial' END AS type, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE (o_orderkey % 3)::VARCHAR END AS persistence, count(*) AS n FROM orders GROUP BY ALL"""),
    "signal_join": (signal_join, f"WITH {X.MONTHS} SELECT company, date, mt_strict AS mt_base, mt_lenient AS mt_other FROM fm WHERE month(date) <> 3 AND company % 9 <> 0"),
    "target_summary": (target_summary, f"""WITH {_LOADED}, t AS (SELECT length(metric_name) * 7 % 13 AS k, is_financial AS fin, CASE WHEN context LIKE '%1' THEN 'high' WHEN context LIKE '%2' THEN 'medium' ELSE 'low' END AS conf,
        CASE WHEN quarter LIKE '1995%' THEN 'past' WHEN quarter LIKE '1996%' THEN 'future' ELSE 'unknown' END AS temp FROM lt),
      n AS (SELECT r.range AS k, count(t.k) AS n FROM range(20) r LEFT JOIN t ON t.k = r.range GROUP BY ALL)
      SELECT 'transcripts' AS measure, count(*)::DOUBLE AS value FROM n UNION ALL SELECT 'min', min(n)::DOUBLE FROM n UNION ALL SELECT 'max', max(n)::DOUBLE FROM n UNION ALL SELECT 'mean', round(avg(n), 2) FROM n
      UNION ALL SELECT 'targets', count(*)::DOUBLE FROM t UNION ALL SELECT 'financial', sum(fin::INT)::DOUBLE FROM t UNION ALL SELECT 'operational', sum(1 - fin::INT)::DOUBLE FROM t
      UNION ALL SELECT 'confidence:' || c, count(conf)::DOUBLE FROM (VALUES ('high'), ('medium'), ('low')) x(c) LEFT JOIN t ON conf = c GROUP BY c UNION ALL SELECT 'temporal_framing:' || temp, count(*)::DOUBLE FROM t GROUP BY temp"""),
    "transcript_ids": (transcript_ids, f"""WITH {X.COMPONENTS} SELECT transcript_id::VARCHAR || '_201' || (transcript_id % 10)::VARCHAR || CASE WHEN ord % 2 = 0 THEN 'Q3' ELSE 'Q2' END AS transcript_id,
      count(*) AS n, count(*) FILTER (ord % 3 = 0 OR text IS NULL OR text = '') AS n_empty, min(ctype)::BIGINT AS least_type FROM comp GROUP BY 1"""),
    "column_find": (column_find, """SELECT p_partkey, CASE string_split(p_name, ' ')[-1] WHEN 'ring' THEN 0 WHEN 'bolt' THEN 1 WHEN 'gear' THEN 2 WHEN 'widget' THEN 3 WHEN 'nut' THEN 4 END::BIGINT AS place FROM part"""),
    "embedded_names": (embedded_names, """WITH g AS (SELECT p_partkey, lower(p_name) AS t, unnest(generate_series(1, length(p_name) - 2)) AS i FROM part),
      h AS (SELECT p_partkey, (ord(substr(t, i, 1)) * 961 + ord(substr(t, i + 1, 1)) * 31 + ord(substr(t, i + 2, 1))) % 64 AS place, count(*) AS c FROM g GROUP BY ALL)
      SELECT p_partkey, place::BIGINT AS place, round(c / sqrt(sum(c * c) OVER (PARTITION BY p_partkey)), 9) AS value FROM h"""),
    "best_bounds": (best_bounds, f"""WITH {X.VECTORS}, k AS (SELECT round(sim, 9) AS sim FROM pairs WHERE cur_idx % 3 = hist_idx % 3), g AS (SELECT 0.05::DOUBLE * a.range AS m, 0.02::DOUBLE * b.range AS r FROM range(2, 7) a, range(1, 6) b WHERE 0.02::DOUBLE * b.range < 0.05::DOUBLE * a.range)
      SELECT round(m, 6) AS m, round(r, 6) AS r, round(avg((sim <= r)::INT), 9) AS fp_rate FROM g, k GROUP BY ALL ORDER BY fp_rate, m, r LIMIT 1"""),
    "full_panel": (full_panel, f"""WITH {X.MONTHS}, {_FACTORS}, nx AS (SELECT company, last_day((date_trunc('month', date) - INTERVAL 1 DAY)::DATE) AS date, ret AS ret_fwd FROM fm),
      b AS (SELECT fm.company, fm.date, ret_fwd, ret, CASE WHEN mktcap_lag IS NOT NULL THEN ln(greatest(mktcap_lag, 1.0)) END AS size,
        CASE WHEN company % 6 <> 0 THEN ln(greatest(mt_strict * 1000 / nullif(mktcap, 0), 1e-6)) END AS logbm, CASE WHEN month(fm.date) % 3 = 0 AND rev > 0 THEN (mktcap - 100) / (rev / 1000) END AS sue, mktrf, umd
        FROM fm JOIN nx USING (company, date) LEFT JOIN f USING (date) LEFT JOIN umd USING (date)),
      x AS (SELECT *, lag(ret) OVER (PARTITION BY company ORDER BY date) AS ret_1_0 FROM b),
      q AS (SELECT date, quantile_cont(ret_fwd, 0.01) AS a0, quantile_cont(ret_fwd, 0.99) AS a1, quantile_cont(size, 0.01) AS b0, quantile_cont(size, 0.99) AS b1 FROM x GROUP BY ALL)
      SELECT company, x.date, round(CASE WHEN ret_fwd IS NOT NULL THEN least(greatest(ret_fwd, a0), a1) END, 6) AS ret_fwd, round(CASE WHEN size IS NOT NULL THEN least(greatest(size, b0), b1) END, 6) AS size,
        round(logbm, 6) AS logbm, round(sue, 6) AS sue, round(mktrf, 6) AS mktrf, round(umd, 6) AS umd, round(ret_1_0, 6) AS ret_1_0 FROM x JOIN q ON q.date = x.date"""),
    "long_event_cars": (long_event_cars, f"WITH {_CARS} SELECT company, event_date, matched_day, n_est_obs, round(alpha_hat, 6) AS alpha_hat, round(beta_hat, 5) AS beta_hat, round(car, 6) AS car FROM cars"),
    "announcement_effect": (announcement_effect, f"""{_PAIRS}, r AS (SELECT count(*) AS n, regr_slope(car, mt) AS beta, regr_sxx(car, mt) AS sxx, regr_syy(car, mt) - regr_slope(car, mt) * regr_sxy(car, mt) AS sse FROM pr),
      w AS (SELECT count(*) FILTER (mt >= q80) AS n_high, count(*) FILTER (mt <= q20) AS n_low, avg(car) FILTER (mt >= q80) AS m1, avg(car) FILTER (mt <= q20) AS m0, var_samp(car) FILTER (mt >= q80) AS v1, var_samp(car) FILTER (mt <= q20) AS v0 FROM pr, qs),
      tt AS (SELECT *, beta / nullif(sqrt(sse / nullif(n - 2, 0) / nullif(sxx, 0)), 0) AS t FROM r), pv AS (SELECT *, {X.p_sql("t", "(n - 2)")} AS p FROM tt)
      SELECT n, round(beta, 4) AS beta, round(t, 4) AS t_beta, round(p, 5) AS p_mt, CASE WHEN n = 0 THEN 'insufficient data' WHEN p > 0.10 THEN 'not related' ELSE 'related' END AS conclusion, n_high, n_low, round((m1 - m0) / nullif(sqrt(v1 / nullif(n_high, 0) + v0 / nullif(n_low, 0)), 0), 4) AS welch_t FROM pv, w"""),
    "announcement_groups": (announcement_groups, f"""{_PAIRS}, e AS (SELECT quantile_cont(mt, [0.2, 0.4, 0.6, 0.8]) AS e, min(mt) AS lo, max(mt) AS hi FROM pr),
      g AS (SELECT car, len(list_filter(list_distinct(e), lambda v: v < mt AND v > lo AND v < hi)) + 1 AS mt_group FROM pr, e)
      SELECT mt_group::BIGINT AS mt_group, round(avg(car), 6) AS mean_car, count(*) AS n, round(avg(car) / nullif(stddev_samp(car) / sqrt(count(*)), 0), 3) AS t FROM g GROUP BY ALL"""),
    "kpis": (kpis, _REPORTS + " SELECT count(DISTINCT company) AS n_companies, count(*) AS n_calls, count(*) FILTER (risk_flag = 'HIGH') AS n_high FROM fl"),
    "resumed_reports": (resumed_reports, _REPORTS + " SELECT company, q_int, n_dropped, n_persistent, risk_score, risk_flag FROM fl WHERE company >= 10"),
    "initial_states": (initial_states, f"{_W} SELECT company, count(*) AS n, 0::BIGINT AS most_dropped, 'LOW' AS flag, 0.0::DOUBLE AS score FROM calls GROUP BY ALL"),
    "calendar_quarters": (calendar_quarters, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1999Q2' ELSE year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR END AS quarter FROM orders"),
}
