"""The engine's tables, made from the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quarters import of_date


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def targets(spark: SparkSession, d: str) -> DataFrame:
    """company, q_int, norm, is_financial, pos."""
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    supplier = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("company"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").join(part, "l_partkey").join(supplier, "l_suppkey")
    return rows.select("company", of_date(F.col("l_shipdate")).alias("q_int"), F.lower("p_name").alias("norm"), F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM").alias("is_financial"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


TARGETS = """raw AS (
  SELECT s_nationkey AS company, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q_int, lower(p_name) AS norm,
    p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') AS is_financial, l_orderkey * 10 + l_linenumber AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
sets AS (SELECT company, q_int, norm, max(pos * 2 + is_financial::INT) % 2 = 1 AS is_financial FROM raw GROUP BY ALL),
calls AS (SELECT DISTINCT company, q_int FROM raw)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("label").alias("company"), (F.col("vec_id") % 8).cast("int").alias("q_int"), F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))


VECTORS = """v AS (SELECT label AS company, (vec_id % 8)::INT AS q_int, vec_id AS idx, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT c.company, c.q_int, c.idx AS cur_idx, h.idx AS hist_idx, list_cosine_similarity(c.v, h.v) AS sim
  FROM v c JOIN v h ON c.company = h.company AND h.q_int = c.q_int - 4),
best AS (SELECT company, q_int, hist_idx, max(round(sim, 9)) AS sim FROM pairs GROUP BY ALL),
labels AS (SELECT b.company, b.q_int, b.hist_idx, min(p.cur_idx) AS cur_idx, b.sim,
    CASE WHEN b.sim > 0.3 THEN 'maintained' WHEN b.sim > 0.15 THEN 'rephrased' ELSE 'dropped' END AS label
  FROM best b JOIN pairs p ON b.company = p.company AND b.q_int = p.q_int AND b.hist_idx = p.hist_idx AND round(p.sim, 9) = b.sim GROUP BY ALL)"""


def firm_months(spark: SparkSession, d: str) -> DataFrame:
    """company, date (month-end), ret, mktcap, mktcap_lag: a supplier's monthly revenue as its price."""
    x = read(spark, d, "lineitem").select("l_suppkey", F.last_day("l_shipdate").alias("date"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    m = x.groupBy(F.col("l_suppkey").alias("company"), "date").agg(F.round(F.sum("l_extendedprice"), 2).alias("rev"), F.round(F.sum("l_quantity"), 2).alias("mktcap"), F.round(F.avg("l_discount"), 8).alias("mt_strict"), F.round(F.avg("l_tax"), 8).alias("mt_lenient"))
    w = Window.partitionBy("company").orderBy("date")
    return m.withColumns({"ret": F.try_divide(F.col("rev"), F.lag("rev").over(w)) - 1, "mktcap_lag": F.lag("mktcap").over(w)})


MONTHS = """m AS (SELECT l_suppkey AS company, last_day(l_shipdate::DATE) AS date, round(sum(l_extendedprice), 2) AS rev, round(sum(l_quantity), 2) AS mktcap,
    round(avg(l_discount), 8) AS mt_strict, round(avg(l_tax), 8) AS mt_lenient FROM lineitem GROUP BY ALL),
fm AS (SELECT *, rev / nullif(lag(rev) OVER w, 0) - 1 AS ret, lag(mktcap) OVER w AS mktcap_lag FROM m WINDOW w AS (PARTITION BY company ORDER BY date))"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """company, date, ret, mkt_ret from events."""
    u = read(spark, d, "events").groupBy(F.col("user_id").alias("company"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value") / 1000, 9).alias("ret"))
    mkt = u.groupBy("date").agg(F.round(F.avg("ret"), 9).alias("mkt_ret"))
    return u.join(mkt, "date").select("company", "date", "ret", "mkt_ret")


DAILY = """u AS (SELECT user_id AS company, ts::DATE AS date, round(avg(value) / 1000, 9) AS ret FROM events GROUP BY ALL),
mkt AS (SELECT date, round(avg(ret), 9) AS mkt_ret FROM u GROUP BY ALL),
daily AS (SELECT company, date, ret, mkt_ret, row_number() OVER (PARTITION BY company ORDER BY date) AS pos FROM u JOIN mkt USING (date))"""


def announcements(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("company"), F.to_date("ts").alias("event_date")).distinct()


ANNOUNCED = "ev AS (SELECT DISTINCT user_id AS company, ts::DATE AS event_date FROM events WHERE event_type = 'purchase')"


def components(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    kind = F.when(F.col("role") == "system", 2).when(F.col("role") == "user", 3).otherwise(4)
    return c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("ord"), kind.alias("ctype"), "text")


COMPONENTS = "comp AS (SELECT conv_id AS transcript_id, turn AS ord, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 3 ELSE 4 END AS ctype, text FROM conversations)"


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Components whose texts state amounts, percentages and products: a sentence for each eight words of a conversation, in one of eight forms."""
    c = components(spark, d).withColumn("w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0)))
    form = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_FORMS))
    said = f"transform(if(size(w) < 8, cast(array() as array<bigint>), sequence(0L, size(w) div 8 - 1)), i -> transform(array(named_struct('a', w[int(8 * i)], 'b', w[int(8 * i + 1)], 'c', w[int(8 * i + 2)], 'n', string((37 * i + 11 * ord + 5) % 97 + 1))), x -> CASE (i + ord) % 8 {form} END)[0])"
    return c.withColumn("text", F.array_join(F.expr(said), " ")).drop("w")


#: Sentences around words a, b, c and a number n, in both dialects.
_FORMS = [
    "'Our ' || x.a || ' ' || x.b || ' was $' || x.n || '.5 million.'",
    "'We saw a ' || x.n || '% year-over-year increase in ' || x.a || ' ' || x.b || '.'",
    "'The ' || x.a || ' ' || x.b || ' of the ' || x.c || ' totaled approximately €' || x.n || ' billion, and the iPhone ' || x.n || ' Pro ' || x.c || ' remained strong.'",
    "'We expect to deliver adjusted ' || x.a || ' of $' || x.n || ' million.'",
    "'In Q4, the ' || x.a || ' margin of ' || x.n || '% improved while ' || x.b || ' cut costs.'",
    "x.a || ' ' || x.b || ' ' || x.c || ' and $' || x.n || ' ' || x.b || ' of ' || x.c || '!'",
    "'The Vision ' || x.a || ' drove a $' || x.n || ' million investment in ' || x.b || ', our AirPods ' || x.b || ' and AIRPODS ' || x.b || '.'",
    "x.a || ' came in at $' || x.n || ' million, a ' || x.n || '% decline. ' || x.b || ' exceeded ' || x.c || ' by ' || x.n || ' basis points?'",
]
STATEMENTS = f"""{COMPONENTS}, words AS (SELECT transcript_id, ord, ctype, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+') AS w FROM comp),
st AS (SELECT transcript_id, ord, ctype, array_to_string(list_transform(range(0, len(w) // 8), lambda i: list_transform([{{'a': w[8 * i + 1], 'b': w[8 * i + 2], 'c': w[8 * i + 3], 'n': ((37 * i + 11 * ord + 5) % 97 + 1)::VARCHAR}}],
  lambda x: CASE (i + ord) % 8 {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_FORMS))} END)[1]), ' ') AS text FROM words)"""


#: Replies around the first three words a, b, c of a text and a number n: by form, whole JSON or something near it.
_T = '{"metric_name": "~a ~b", "numerical_value": ~n, "raw_text": "~a was ~n million", "unit": "million"}'
_U = '{"metric_name": "~c", "numerical_value": null, "confidence": "high", "trend_direction": "up"}'
REPLIES = [
    f"[{_T}, {_U}, 5, null]",
    "```json\n{\"targets\": [" + _T + ", \"~a\", " + _U + "], \"other\": [" + _U + "]}\n```",
    '{"zz": [1, 2], "found": [' + _U + ', 3], "also": [' + _T + "]}",
    _T,
    f"Here they are: [{_T}] and more [1].",
    f"First {_T}, then {_U}; not {{\"z\": 1}} nor {{broken}}.",
    "",
    "~a ~b found nothing.",
    '{"a": 1, "targets": "none"}',
    '```\n{"metric_name": "~a", "numerical_value": "~n", "time_horizon": ~n.5}\n```',
    '[{"metric_name": "~a", "inner": {"metric_name": "~b", "numerical_value": ~n.25}}, {"numerical_value": -~n.75}] trailing',
    "null",
]


def replies(spark: SparkSession, d: str) -> DataFrame:
    """transcript_id, ord and what a model could have replied to the component: words of its text in one of a dozen forms; null without three words."""
    c = components(spark, d).withColumn("w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0)))
    out = F.element_at(F.array(*map(F.lit, REPLIES)), ((F.col("transcript_id") + F.col("ord")) % len(REPLIES) + 1).cast("int"))
    for k, x in (("~a", F.get("w", F.lit(0))), ("~b", F.get("w", F.lit(1))), ("~c", F.get("w", F.lit(2))), ("~n", (F.col("ord") * 7 + F.col("transcript_id") % 50).cast("string"))):
        out = F.replace(out, F.lit(k), x)
    return c.select("transcript_id", "ord", out.alias("reply"))


def _reply_sql() -> str:
    out = "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in REPLIES) + f"][(transcript_id + ord) % {len(REPLIES)} + 1]"
    for k, x in (("~a", "w[1]"), ("~b", "w[2]"), ("~c", "w[3]"), ("~n", "(ord * 7 + transcript_id % 50)::VARCHAR")):
        out = f"replace({out}, '{k}', {x})"
    return out


REPLIED = f"{COMPONENTS}, words AS (SELECT transcript_id, ord, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+') AS w FROM comp), rp AS (SELECT transcript_id, ord, {_reply_sql()} AS reply FROM words)"


def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """similarity from document lengths, y from quality, confidence from toxic."""
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    sim = F.round(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 4)
    return x.select("doc_id", sim.alias("similarity"), F.when(F.col("quality") == 1, "MAINTAINED").otherwise("DROPPED").alias("label"), F.when(F.col("toxic") == 1, "L").otherwise("H").alias("confidence"), F.col("quality").alias("y"))


PAIRS = "lp AS (SELECT doc_id, round(least(n_chars / 5000.0, 1.0), 4)::DOUBLE AS similarity, quality AS y, CASE toxic WHEN 1 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight FROM labels JOIN documents USING (doc_id))"


def history(spark: SparkSession, d: str) -> DataFrame:
    """entity, namedt, nameendt, label: a customer's order status until the next order."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("namedt")).agg(F.max("o_orderstatus").alias("label"))
    w = Window.partitionBy("entity").orderBy("namedt")
    return o.withColumn("nameendt", F.coalesce(F.date_sub(F.lead("namedt").over(w), 1), F.to_date(F.lit("2099-12-31"))))


HISTORY = """o1 AS (SELECT o_custkey AS entity, o_orderdate::DATE AS namedt, max(o_orderstatus) AS label FROM orders GROUP BY ALL),
hist AS (SELECT *, coalesce((lead(namedt) OVER (PARTITION BY entity ORDER BY namedt) - INTERVAL 1 DAY)::DATE, DATE '2099-12-31') AS nameendt FROM o1)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    q = of_date(F.col("o_orderdate"))
    a = o.groupBy(F.col("o_custkey").alias("ticker"), q.alias("fp"), F.col("o_orderpriority").alias("fpi")).agg(F.round(F.avg("o_totalprice"), 4).alias("actual"))
    e = o.groupBy(q.alias("fp"), F.col("o_orderpriority").alias("fpi")).agg(F.round(F.avg("o_totalprice"), 4).alias("meanest"), F.round(F.stddev_samp("o_totalprice"), 4).alias("stdev"), F.round(F.max("o_totalprice"), 4).alias("prccq"))
    return a.join(e, ["fp", "fpi"], "left")


FORECASTS = """a AS (SELECT o_custkey AS ticker, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS fp, o_orderpriority AS fpi, round(avg(o_totalprice), 4) AS actual FROM orders GROUP BY ALL),
e AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS fp, o_orderpriority AS fpi, round(avg(o_totalprice), 4) AS meanest, round(stddev_samp(o_totalprice), 4) AS stdev, round(max(o_totalprice), 4) AS prccq FROM orders GROUP BY ALL),
fc AS (SELECT * FROM a LEFT JOIN e USING (fp, fpi))"""


def p_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom in DuckDB: a finite series, unlike the engine's fraction."""
    c, s_ = f"(1 / sqrt(1 + ({t}) * ({t}) / ({dof})))", f"(abs({t}) / sqrt({dof} + ({t}) * ({t})))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow({c}, 2 * k + 1))), 0)"
    even = f"list_sum(list_transform(range(0, ({dof}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow({c}, 2 * k)))"
    return f"CASE WHEN {dof} > 0 THEN 1 - CASE WHEN ({dof}) % 2 = 1 THEN 2 / pi() * (atan(abs({t}) / sqrt({dof})) + {s_} * {odd}) ELSE {s_} * {even} END END"
