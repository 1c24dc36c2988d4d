"""Queries of scalar functions and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quarters as Q
from ..functions import scoring as S
from ..functions import text as T
from ..operators import extraction as E
from ..operators import relational as R
from ..sources import standins as X


def quarter_functions(s, d):
    o = X.read(s, d, "orders").select(Q.of_date(F.col("o_orderdate")).alias("q_int")).distinct()
    q = Q.to_string(F.col("q_int"))
    return o.select("q_int", q.alias("quarter"), Q.to_int(q).cast("long").alias("back"), Q.lagged(q, 4).alias("lagged"), F.array_join(Q.prior(q, 3), ",").alias("prior"), Q.clean(F.lower(q), F.lit(None).cast("date")).alias("cleaned"))


def metric_names(s, d):
    p = X.read(s, d, "part").select("p_partkey", F.concat(F.lit("Our "), "p_name", F.lit(" Gross-Margins of 12.5% in FY24 ("), "p_type", F.lit(") sales")).alias("m"))
    return p.select("p_partkey", T.canonical_metric(F.col("m")).alias("canonical"), T.normalised_target(F.concat(F.lit("about $2.5 billion in "), F.col("m"))).alias("normalised"))


def ids_and_keys(s, d):
    c = X.read(s, d, "customer")
    tid = F.concat(F.col("c_custkey").cast("string"), F.lit(".0_"), (2000 + F.col("c_custkey") % 24).cast("string"), F.lit("Q"), (1 + F.col("c_custkey") % 4).cast("string"))
    p = T.transcript_parts(tid)
    return c.select("c_custkey", p["company_id"].alias("company_id"), p["fiscal_year"].cast("long").alias("fiscal_year"), p["fiscal_quarter"].cast("long").alias("fiscal_quarter"), p["quarter"].alias("quarter"), T.padded_key(F.col("c_custkey")).alias("padded"), T.vector_id(p["company_id"], p["quarter"], F.col("c_mktsegment")).alias("vector_id"), T.embed_text(F.col("c_mktsegment"), F.col("c_name")).alias("embed_text"))


def tickers(s, d):
    n = X.read(s, d, "nation")
    return n.select("n_nationkey", T.ticker_of(F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit(" t"), F.col("n_nationkey").cast("string"))), F.col("n_name"), ["1", "2", "nation"], {"NATION_3": "N3", "NATION_7": "N7"}).alias("ticker"))


def target_keys(s, d):
    p = X.read(s, d, "part")
    k = T.target_key(F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name")), F.col("p_brand"))
    return p.select("p_partkey", k.alias("key")).where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def sentence_counts(s, d):
    c = X.components(s, d)
    return c.select("transcript_id", "ord", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), T.token_estimate(F.col("text")).cast("long").alias("n_tokens"), T.component_label(F.col("ctype")).alias("label"), T.component_priority(F.col("ctype")).cast("long").alias("priority"))


def chunks(s, d):
    c = E.chunked(X.components(s, d), budget=120)
    return c.select("transcript_id", "ctype", "chunk_no", T.token_estimate(F.col("chunk")).alias("n_tokens"), F.md5("chunk").alias("chunk_md5"))


def nested_components(s, d):
    n = R.nested_components(X.components(s, d), ("transcript_id",))
    return n.select("transcript_id", F.col("n_components").cast("long").alias("n_components"), F.md5("whole").alias("text_md5"))


def rule_targets(s, d):
    p = X.read(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" was $"), F.col("p_size").cast("string"), F.lit(" million. We expect "), "p_type", F.lit(" sales to grow 12%.")).alias("text"))
    t = E.rule_targets(p)
    return t.select("p_partkey", "entity_label", "value_text", "governing_verb")


def financial_kinds(s, d):
    p = X.read(s, d, "part").select("p_partkey", F.lower("p_name").alias("n"), (F.col("p_partkey") % 4).alias("k"))
    name = F.when(F.col("k") == 0, F.concat("n", F.lit(" revenue"))).when(F.col("k") == 1, F.concat(F.lit("customer "), "n")).otherwise(F.col("n"))
    return p.select("p_partkey", T.is_financial(F.when(F.col("p_partkey") % 11 == 0, False), name).alias("is_financial"))


def formulas(s, d):
    o = X.read(s, d, "orders").where("o_totalprice is not null")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.round(S.log_size(S.market_cap(F.col("o_totalprice"), k.cast("double"))), 6).alias("size"), F.round(S.log_book_to_market((k % 7).cast("double"), F.col("o_totalprice")), 6).alias("logbm"), S.backoff(F.lit(0.5), (k % 10).cast("double"), 30.0).alias("wait"), S.clean_flag(F.when(k % 3 == 0, F.lit(" high ")).when(k % 3 == 1, F.lit("n/a"))).alias("flag"), T.humanised(F.floor(F.col("o_totalprice") / 1000) * (k % 3) * 1e7).alias("shown"))


def surprise(s, d):
    f = X.forecasts(s, d)
    return f.select("ticker", "fp", "fpi", F.round(S.surprise(F.col("actual"), F.col("meanest"), F.col("stdev")), 6).alias("sue"), F.round(S.surprise_by_price(F.col("actual"), F.col("meanest"), F.col("prccq")), 6).alias("sue_price"))


def reply_targets(s, d):
    r = X.replies(s, d).select("transcript_id", "ord", F.posexplode_outer(E.reply_targets(F.col("reply"))).alias("pos", "t"), E.reply_objects(F.col("reply")).isNull().alias("unread"))
    return r.select("transcript_id", "ord", "pos", "unread", *[f"t.{f}" for f in E.TARGET_FIELDS])


def _first_words(chunk: str) -> str:
    """A stand-in for a model: the chunk's first word as a metric, with the chunk's length."""
    import re

    return '[{"metric_name": "%s", "numerical_value": %d}]' % ((re.findall(r"[^\W\d_]+", chunk) or ["none"])[0], len(chunk))


def extracted_calls(s, d):
    """Transcripts of which some have targets already, some have components, some a text only, and some nothing."""
    c = X.components(s, d).withColumn("ord", F.col("ord").cast("int"))
    k = F.col("transcript_id") % 5
    calls = c.groupBy("transcript_id").agg(F.max_by(F.coalesce("text", F.lit("")), "ord").alias("text")).withColumn("text", F.when(k == 1, F.col("text")))
    known = c.where(k == 0).select("transcript_id", F.col("ord").alias("pos"), *[(F.concat(F.lit("known "), F.col("ord").cast("string")) if f == "metric_name" else F.lit(None).cast("double" if f == "numerical_value" else "string")).alias(f) for f in E.TARGET_FIELDS])
    found = E.extracted(calls, c.where((k == 0) | (k > 2)), _first_words, known, budget=1_000_000)
    name = F.concat_ws(" ", F.transform("targets", lambda t: F.concat_ws("=", t["metric_name"], t["numerical_value"].cast("long").cast("string"))))
    return found.select("transcript_id", name.alias("told"), F.array_join("errors", "; ").alias("errors"))


def shown_targets(s, d):
    """What is shown of the targets of replies, with the components' labels of calls."""
    r = X.replies(s, d).join(X.components(s, d).select("transcript_id", "ord", "ctype"), ["transcript_id", "ord"])
    t = r.select("transcript_id", "ord", "ctype", F.posexplode(E.reply_targets(F.col("reply"))).alias("pos", "t"))
    shown = T.shown_context(F.col("t.numerical_value") * 617.283 / (F.col("ord") + 7), F.col("t.unit"), F.col("t.trend_direction"), F.col("t.time_horizon"), F.col("t.confidence"), F.col("t.raw_text"))
    return t.select("transcript_id", "ord", "pos", T.component_label(F.col("ctype"), T.CALL_COMPONENTS).alias("label"), shown.alias("shown"), F.length(T.stored_context(F.repeat(F.coalesce("t.metric_name", F.lit("x")), 100))).alias("stored"))


def match_quality(s, d):
    t = X.read(s, d, "part").select("p_brand", F.lower("p_name").alias("name"), "p_partkey")
    pred, truth = t.where("p_partkey % 2 = 0").select("p_brand", "name"), t.where("p_partkey % 2 = 1").select("p_brand", "name")
    n = pred.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_pred")).join(truth.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_true")), "p_brand").join(E.exact_matches(pred, truth, ["p_brand"]), "p_brand", "left").fillna(0)
    q = E.f1(F.col("n_matched"), F.col("n_pred"), F.col("n_true"))
    return n.select("p_brand", "n_pred", "n_true", "n_matched", *[F.round(q[x], 6).alias(x) for x in ("precision", "recall", "f1")])


def greedy_matches(s, d):
    """Order-dependent folds; SQL has them as a recursion."""
    t = X.read(s, d, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set(F.lower("p_name"))).alias("names"))
    return t.select("p_brand", "p_size", E.greedy_matches(F.col("names"), F.reverse("names"), 0.3).alias("n_matched"))


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '-', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
QUERIES = {
    "quarter_functions": (quarter_functions, """WITH q AS (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q_int FROM orders), f AS (SELECT q_int, (q_int // 4) || 'Q' || (q_int % 4 + 1) AS quarter FROM q)
      SELECT q_int, quarter, q_int AS back, ((q_int - 4) // 4) || 'Q' || ((q_int - 4) % 4 + 1) AS lagged,
        ((q_int - 3) // 4) || 'Q' || ((q_int - 3) % 4 + 1) || ',' || ((q_int - 2) // 4) || 'Q' || ((q_int - 2) % 4 + 1) || ',' || ((q_int - 1) // 4) || 'Q' || ((q_int - 1) % 4 + 1) AS prior, quarter AS cleaned FROM f"""),
    "ids_and_keys": (ids_and_keys, """WITH c AS (SELECT *, c_custkey::VARCHAR AS company_id, 2000 + c_custkey % 24 AS fiscal_year, 1 + c_custkey % 4 AS fiscal_quarter FROM customer)
      SELECT c_custkey, company_id, fiscal_year, fiscal_quarter, fiscal_year || 'Q' || fiscal_quarter AS quarter, CASE WHEN length(company_id) < 6 THEN lpad(company_id, 6, '0') ELSE company_id END AS padded,
        company_id || '__' || fiscal_year || 'Q' || fiscal_quarter || '__' || left(replace(replace(lower(c_mktsegment), ' ', '_'), '/', '_'), 54) || '__' || left(md5(c_mktsegment), 8) AS vector_id,
        c_mktsegment || '. ' || c_name AS embed_text FROM c"""),
    "ticker_lookup": (tickers, """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'T' || n_nationkey WHEN n_name = 'NATION_3' THEN 'N3' WHEN n_name = 'NATION_7' THEN 'N7'
      WHEN contains(upper(n_name), '1') THEN '1' WHEN contains(upper(n_name), '2') THEN '2' WHEN contains(upper(n_name), 'NATION') THEN 'NATION' ELSE '' END AS ticker FROM nation"""),
    "target_keys": (target_keys, "SELECT * FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_name) END AS key, count(*) AS n FROM part GROUP BY ALL) WHERE key <> ''"),
    "metric_names": (metric_names, """SELECT p_partkey, lower(p_name) || ' gross margin ' || lower(p_type) || ' revenue' AS canonical, 'in our ' || lower(p_name) || ' gross-margin of in fy24 (' || lower(p_type) || ') sales' AS normalised FROM part"""),
    "sentence_counts": (sentence_counts, f"""WITH {X.COMPONENTS} SELECT transcript_id, ord, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n_sentences,
      CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS n_tokens, CASE ctype WHEN 2 THEN 'presentation' WHEN 3 THEN 'analyst question' ELSE 'management answer' END AS label,
      CASE ctype WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END::BIGINT AS priority FROM comp"""),
    "chunks": (chunks, rf"""WITH RECURSIVE {X.COMPONENTS}, g AS (SELECT transcript_id, ctype, string_agg(text, chr(10) || chr(10) ORDER BY ord, text) AS whole FROM comp GROUP BY ALL),
      s AS (SELECT transcript_id, ctype, list_filter(list_transform(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM g),
      r AS (SELECT transcript_id, ctype, p, 0 AS i, '' AS held, []::VARCHAR[] AS done FROM s
        UNION ALL SELECT transcript_id, ctype, p, i + 1,
          CASE WHEN greatest(1, length(p[i + 1]) // 4) > 120 THEN '' WHEN held = '' THEN p[i + 1] WHEN greatest(1, length(held) // 4) + greatest(1, length(p[i + 1]) // 4) <= 120 THEN held || ' ' || p[i + 1] ELSE p[i + 1] END,
          CASE WHEN greatest(1, length(p[i + 1]) // 4) > 120 THEN list_concat(CASE WHEN held = '' THEN done ELSE list_append(done, held) END, list_transform(range(0, (length(p[i + 1]) - 1) // 480 + 1), lambda k: substr(p[i + 1], k * 480 + 1, 480)))
            WHEN held = '' OR greatest(1, length(held) // 4) + greatest(1, length(p[i + 1]) // 4) <= 120 THEN done ELSE list_append(done, held) END
        FROM r WHERE i < len(p)),
      c AS (SELECT transcript_id, ctype, CASE WHEN held = '' THEN done ELSE list_append(done, held) END AS all_chunks FROM r WHERE i = len(p)),
      u AS (SELECT transcript_id, ctype, unnest(all_chunks) AS chunk, generate_subscripts(all_chunks, 1) - 1 AS chunk_no FROM c)
      SELECT transcript_id, ctype, chunk_no, greatest(1, length(chunk) // 4) AS n_tokens, md5(chunk) AS chunk_md5 FROM u"""),
    "nested_components": (nested_components, f"WITH {X.COMPONENTS} SELECT transcript_id, count(*) AS n_components, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord, text)) AS text_md5 FROM comp WHERE length(trim(text)) > 0 GROUP BY ALL"),
    "rule_targets": (rule_targets, """SELECT p_partkey, 'MONEY' AS entity_label, '$' || p_size || ' million' AS value_text, '' AS governing_verb FROM part
      UNION ALL SELECT p_partkey, 'PERCENT', '12%', 'expect' FROM part"""),
    "reply_targets": (reply_targets, rf"""WITH {X.REPLIED},
      tr AS (SELECT *, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS t FROM rp),
      bo AS (SELECT *, CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '^```(json)?\s*', ''), '\s*```$', '') ELSE t END AS body FROM tr),
      li AS (SELECT *, regexp_extract(body, '(?s)\[.*?\]') AS lst FROM bo),
      va AS (SELECT *, CASE WHEN json_valid(body) AND body <> 'null' THEN body WHEN json_valid(lst) THEN lst END AS val FROM li),
      ob AS (SELECT *, CASE WHEN reply = '' THEN []::VARCHAR[]
        WHEN val IS NULL THEN nullif(list_filter(regexp_extract_all(body, '\{{[^{{}}]*\}}'), lambda x: json_valid(x)), [])
        WHEN json_type(val) = 'ARRAY' THEN list_filter(json_extract(val, '$[*]')::VARCHAR[], lambda x: json_type(x) = 'OBJECT')
        WHEN json_type(val) <> 'OBJECT' THEN NULL
        WHEN json_type(val, '$.targets') = 'ARRAY' THEN list_filter(json_extract(val, '$.targets[*]')::VARCHAR[], lambda x: json_type(x) = 'OBJECT')
        ELSE coalesce(list_filter(list_transform(json_keys(val), lambda k: list_filter(coalesce(json_extract(json_extract(val, '$.' || k), '$[*]')::VARCHAR[], []), lambda x: json_type(x) = 'OBJECT')), lambda l: len(l) > 0)[1],
          CASE WHEN list_has_any(json_keys(val), {E.TARGET_FIELDS}) THEN [val::VARCHAR] END) END AS objs FROM va),
      fi AS (SELECT *, CASE WHEN reply <> '' AND val IS NULL THEN list_filter(objs, lambda x: list_has_any(json_keys(x), {E.TARGET_FIELDS})) ELSE objs END AS found FROM ob),
      un AS (SELECT transcript_id, ord, found IS NULL AS unread, unnest(CASE WHEN coalesce(len(found), 0) = 0 THEN [NULL] ELSE found END) AS o, CASE WHEN coalesce(len(found), 0) > 0 THEN unnest(range(0, len(found))) END AS pos FROM fi)
      SELECT transcript_id, ord, pos::INT AS pos, unread, {", ".join(f"o ->> '$.{f}' AS {f}" for f in E.TARGET_FIELDS if f != "numerical_value")},
        CASE WHEN json_type(o, '$.numerical_value') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (o ->> '$.numerical_value')::DOUBLE END AS numerical_value FROM un"""),
    "extracted_calls": (extracted_calls, f"""WITH {X.COMPONENTS}, k AS (SELECT *, transcript_id % 5 AS k, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) = 0 AS blank FROM comp),
      done AS (SELECT transcript_id, string_agg('known ' || ord, ' ' ORDER BY ord) AS told, '' AS errors FROM k WHERE k = 0 GROUP BY ALL),
      parts AS (SELECT transcript_id, ctype, ord, text FROM k WHERE k > 2 AND NOT blank UNION ALL SELECT transcript_id, 0, 0, arg_max(coalesce(text, ''), ord) FROM k WHERE k = 1 GROUP BY ALL HAVING NOT arg_max(blank, ord)),
      whole AS (SELECT transcript_id, ctype, string_agg(text, chr(10) || chr(10) ORDER BY ord, text) AS t FROM parts GROUP BY ALL),
      chunk AS (SELECT transcript_id, ctype, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS c FROM whole),
      told AS (SELECT transcript_id, string_agg(coalesce(nullif(regexp_extract(c, '\\p{{L}}+'), ''), 'none') || '=' || length(c), ' ' ORDER BY ctype) AS told FROM chunk GROUP BY ALL),
      ids AS (SELECT DISTINCT transcript_id, k FROM k WHERE k > 0)
      SELECT transcript_id, told, errors FROM done UNION ALL
      SELECT ids.transcript_id, coalesce(told, ''), CASE WHEN told IS NULL THEN 'no text and no components' WHEN k = 1 THEN 'no components: the text is read as one' ELSE '' END FROM ids LEFT JOIN told USING (transcript_id)"""),
    "shown_targets": (shown_targets, None),
    "financial_kinds": (financial_kinds, """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) || ' revenue' WHEN 1 THEN 'customer ' || lower(p_name) ELSE lower(p_name) END AS n FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN false WHEN p_partkey % 4 = 0 THEN true WHEN p_partkey % 4 = 1 THEN false ELSE true END AS is_financial FROM p"""),
    "formulas": (formulas, """SELECT o_orderkey, round(ln(greatest(abs(o_totalprice) * o_orderkey::DOUBLE / 1000, 1.0)), 6) AS size, round(ln(greatest((o_orderkey % 7)::DOUBLE / nullif(o_totalprice, 0), 1e-6)), 6) AS logbm,
      least(0.5::DOUBLE * pow(2.0, o_orderkey % 10), 30.0::DOUBLE) AS wait, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' ELSE 'UNKNOWN' END AS flag,
      CASE WHEN abs(x) >= 1e9 THEN printf('%.2f', x / 1e9) || 'B' WHEN abs(x) >= 1e6 THEN printf('%.2f', x / 1e6) || 'M' WHEN abs(x) >= 1e3 THEN printf('%.1f', x / 1e3) || 'K' ELSE regexp_replace(printf('%.4f', x), '\\.?0+$', '') END AS shown
      FROM (SELECT *, floor(o_totalprice / 1000) * (o_orderkey % 3) * 1e7 AS x FROM orders)"""),
    "earnings_surprise": (surprise, f"WITH {X.FORECASTS} SELECT ticker, fp, fpi, round(CASE WHEN stdev > 0 THEN (actual - meanest) / stdev END, 6) AS sue, round((actual - meanest) / nullif(abs(prccq), 0), 6) AS sue_price FROM fc"),
    "match_quality": (match_quality, """WITH t AS (SELECT p_brand, lower(p_name) AS name, p_partkey FROM part), n AS (SELECT p_brand, count(*) FILTER (p_partkey % 2 = 0) AS n_pred, count(*) FILTER (p_partkey % 2 = 1) AS n_true FROM t GROUP BY ALL),
      m AS (SELECT p_brand, count(*) AS n_matched FROM t WHERE p_partkey % 2 = 0 AND EXISTS (SELECT 1 FROM t u WHERE u.p_brand = t.p_brand AND u.name = t.name AND u.p_partkey % 2 = 1) GROUP BY ALL),
      x AS (SELECT n.*, coalesce(n_matched, 0) AS n_matched, coalesce(n_matched, 0) / n_pred AS p, coalesce(n_matched, 0) / n_true AS r FROM n LEFT JOIN m USING (p_brand))
      SELECT p_brand, n_pred, n_true, n_matched, round(p, 6) AS precision, round(r, 6) AS recall, coalesce(round(2 * p * r / nullif(p + r, 0), 6), 0) AS f1 FROM x"""),
    "greedy_matches": (greedy_matches, """WITH RECURSIVE t AS (SELECT p_brand, p_size, list_sort(list_distinct(list(lower(p_name)))) AS names FROM part GROUP BY ALL),
      w AS (SELECT p_brand, p_size, list_transform(names, lambda x: list_distinct(string_split(x, ' '))) AS pred FROM t), b AS (SELECT *, list_reverse(pred) AS truth FROM w),
      r AS (SELECT p_brand, p_size, pred, truth, 0 AS i, []::BIGINT[] AS used FROM b
        UNION ALL SELECT p_brand, p_size, pred, truth, i + 1, CASE WHEN len(c) > 0 THEN list_append(used, c[1].j) ELSE used END
        FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(truth) + 1), lambda j: {'s': -(len(list_intersect(pred[i + 1], truth[j]))::DOUBLE / len(list_distinct(list_concat(pred[i + 1], truth[j])))), 'j': j}),
          lambda x: x.s <= -0.3::DOUBLE AND NOT list_contains(used, x.j))) AS c FROM r WHERE i < len(pred)))
      SELECT p_brand, p_size, len(used)::INT AS n_matched FROM r WHERE i = len(pred)"""),
}
_SHOWN = """CASE WHEN abs(v) >= 1e9 THEN printf('%.2f', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN printf('%.2f', v / 1e6) || 'M' WHEN abs(v) >= 1e3 THEN printf('%.1f', v / 1e3) || 'K' ELSE printf('%g', v) END"""
QUERIES["shown_targets"] = (shown_targets, f"""WITH rt AS ({QUERIES["reply_targets"][1]}), j AS (SELECT rt.*, CASE role WHEN 'system' THEN 'Mgmt Presentation' WHEN 'user' THEN 'Analyst Question' ELSE 'Mgmt Answer' END AS label, numerical_value * 617.283::DOUBLE / (ord + 7) AS v
        FROM rt JOIN conversations ON conv_id = transcript_id AND turn = ord WHERE pos IS NOT NULL),
      n AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN contains(unit, 'USD') THEN '$' || {_SHOWN} WHEN unit <> '' THEN {_SHOWN} || ' ' || unit ELSE {_SHOWN} END AS num FROM j)
      SELECT transcript_id, ord, pos, label, left(coalesce(nullif(concat_ws(' · ', num, nullif(trend_direction, ''), replace(nullif(time_horizon, ''), '_', ' '), nullif(confidence, '')), ''), raw_text, ''), 160) AS shown,
        least(512, length(coalesce(metric_name, 'x')) * 100)::INT AS stored FROM n""")
