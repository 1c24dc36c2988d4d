"""Scans, members, slices and panels of the firm universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .panel import forward_dated, momentum, winsorised

#: Columns by which two tables of signals are joined, as far as both have them.
SIGNAL_KEYS = ("company_id", "company", "date", "fiscal_quarter", "quarter")


def flagged(df: DataFrame, flags: dict[str, object]) -> DataFrame:
    """Rows with all of the flags; as equalities they reach the scan."""
    for c, v in flags.items():
        df = df.where(F.col(c) == v)
    return df


def within(df: DataFrame, column: str, lo: str, hi: str) -> DataFrame:
    return df.where(F.col(column).between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))


def with_momentum_factor(factors: DataFrame, momentum_factor: DataFrame | None, name: str = "umd") -> DataFrame:
    """Factors with the momentum factor by date; nulls where there is none, and without such a table in all rows."""
    if momentum_factor is None or name not in momentum_factor.columns:
        return factors.withColumn(name, F.lit(None).cast("double"))
    return factors.join(momentum_factor.select("date", name), "date", "left")


def with_fundamentals(forecasts: DataFrame, fundamentals: DataFrame, keys: tuple[str, ...] = ("ticker", "fp")) -> DataFrame:
    """Forecasts with the fundamentals of their firm and period; those without any stay, with nulls."""
    return forecasts.join(fundamentals, list(keys), "left")


def id_map(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids).where(F.col(ids[0]).isNotNull()).distinct()


def only_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_semi")


def member_links(members: DataFrame, links: DataFrame, key: str, lo: str, hi: str, open_end: str = "2099-12-31") -> DataFrame:
    """Distinct (key, permno) of index members and links that are both valid within [lo, hi]; members without an end still are."""
    a, b = F.to_date(F.lit(lo)), F.to_date(F.lit(hi))
    m = members.where((F.col("sp_from") <= b) & (F.col("sp_thru").isNull() | (F.col("sp_thru") >= a))).select(key)
    valid = (F.col("linkdt") <= b) & (F.coalesce("linkenddt", F.to_date(F.lit(open_end))) >= a)
    return m.join(links.where(valid).select(key, "permno"), key).distinct()


def top_members(monthly: DataFrame, pairs: DataFrame, n: int, least_months: int) -> DataFrame:
    """The n firms of the highest mean value among members, with a row for each of their keys.

    ``monthly`` has permno, date, mktcap, ticker and name; the last ticker and name are those of the last date.
    """
    m = only_members(monthly, pairs, "permno")
    last = F.max(F.struct("date", "ticker", "name"))
    g = m.groupBy("permno").agg(F.avg("mktcap").alias("avg_mcap"), F.count(F.lit(1)).alias("n_months"), last.alias("l"))
    top = g.where(F.col("n_months") >= least_months).orderBy(F.desc("avg_mcap"), "permno").limit(n)
    return top.select("permno", "avg_mcap", "n_months", "l.ticker", "l.name").join(pairs, "permno", "left")


def loaded_targets(raw: DataFrame) -> DataFrame:
    """company_id, quarter, metric_name, context and is_financial (true where there is no such column); blank names go."""
    have = raw.columns
    out = raw.select(
        T.company_id(F.col("company_id")).alias("company_id"),
        F.col("quarter").cast("string").alias("quarter"),
        F.trim(F.col("metric_name").cast("string")).alias("metric_name"),
        (F.col("raw_text").cast("string") if "raw_text" in have else F.lit("")).alias("context"),
        (F.col("is_financial") if "is_financial" in have else F.lit(True)).alias("is_financial"),
    )
    return out.where(F.col("quarter").isNotNull() & (F.col("company_id") != "") & (F.col("metric_name") != ""))


def sliced(targets: DataFrame, names: DataFrame, quarters: list[str], key: str = "company_id", ticker: str = "ticker") -> DataFrame:
    """(ticker, quarter, targets, n_targets) of the ids of ``names`` and the quarters; targets are structs in order of all their columns."""
    rest = [c for c in targets.columns if c not in (key, "quarter")]
    some = targets.where(F.col("quarter").isin(quarters)).join(names.select(key, ticker).distinct(), key)
    g = some.groupBy(ticker, "quarter").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("targets"))
    return g.withColumn("n_targets", F.size("targets").cast("long"))


def named_like(df: DataFrame, ticker: str, ticker_col: str = "ticker", name_col: str = "companyname") -> Column:
    """Whether a row has the ticker, or its company name holds it; nulls do not."""
    t = ticker.upper()
    return F.coalesce(F.upper(F.col(ticker_col)) == t, F.lit(False)) | F.coalesce(F.contains(F.upper(F.col(name_col)), F.lit(t)), F.lit(False))


def first_truthy(*cols: Column) -> Column:
    """The first that is neither null nor empty; empty if there is none."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(""))


def dropped_rows(dropped: DataFrame) -> DataFrame:
    """Dropped targets as they are shown, whichever of the names of a field they have."""
    have = lambda *names: [F.col(c) for c in names if c in dropped.columns] or [F.lit("")]
    last = first_truthy(*have("last_seen_quarter", "last_quarter", "last_seen"))
    by_flag = F.when(F.coalesce(*have("is_financial")[:1]).cast("boolean"), "financial").otherwise("non-financial") if "is_financial" in dropped.columns else F.lit("non-financial")
    return dropped.select(
        first_truthy(*have("target_name", "metric_name", "canonical_name", "metric", "name")).alias("target_name"),
        F.when(F.trim(last) == "", "prior quarter").otherwise(last).alias("last_seen"),
        first_truthy(*have("type", "target_type"), by_flag).alias("type"),
        first_truthy(*[F.nullif(c.cast("string"), F.lit("0")) for c in have("persistence", "persistent_count", "n_consecutive_quarters")]).alias("persistence"),
    )


def common_join(a: DataFrame, b: DataFrame, value: str, names: tuple[str, str] = ("a", "b"), keys: list[str] | None = None) -> DataFrame:
    """Two tables of one signal, joined on the known keys that both have, else on all columns that both have; nulls go."""
    both = [c for c in a.columns if c in b.columns and c != value]
    keys = keys or [c for c in SIGNAL_KEYS if c in both] or both
    if not keys:
        raise ValueError("the tables have no key in common")
    return a.select(*keys, F.col(value).alias(names[0])).join(b.select(*keys, F.col(value).alias(names[1])), keys).na.drop(subset=list(names))


def target_summary(targets: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(measure, value): counts, a histogram of confidence and of temporal framing, targets of a transcript, those without any included."""
    per = transcripts.select(key).distinct().join(targets.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").fillna(0, ["n"])
    a = per.agg(F.count(F.lit(1)).cast("double").alias("transcripts"), F.min("n").cast("double").alias("min"), F.max("n").cast("double").alias("max"), F.round(F.avg("n"), 2).alias("mean"))
    fin = F.coalesce(F.col("is_financial"), F.lit(False)).cast("int")
    b = targets.agg(F.count(F.lit(1)).cast("double").alias("targets"), F.sum(fin).cast("double").alias("financial"), F.sum(1 - fin).cast("double").alias("operational"))
    wide = [f.unpivot([], f.columns, "measure", "value") for f in (a, b)]
    for c, missing in (("confidence", "low"), ("temporal_framing", "unknown")):
        n = targets.groupBy(F.concat(F.lit(f"{c}:"), F.coalesce(c, F.lit(missing))).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        wide.append(n)
    none = targets.sparkSession.createDataFrame([(f"confidence:{c}", 0.0) for c in ("high", "medium", "low")], "measure string, value double")
    out = wide[0].unionByName(wide[1]).unionByName(wide[2]).unionByName(wide[3]).unionByName(none)
    return out.groupBy("measure").agg(F.sum("value").alias("value"))


def first_containing(labels: Column, needle: Column) -> Column:
    """The place, from 0, of the first label that holds the needle in either case; null if none does."""
    place = F.array_position(F.transform(labels, lambda x: F.contains(F.lower(x), F.lower(needle))), True)
    return F.when(place > 0, place - 1)


def assembled_panel(mt: DataFrame, returns: DataFrame, fundamentals: DataFrame, surprises: DataFrame, factors: DataFrame | None = None, clip: tuple[str, ...] = ("ret_fwd", "size", "logbm", "sue")) -> DataFrame:
    """Scores with the next month's return (inner), size, log book-to-market, surprise and factors (left), momentum, winsorised by month.

    All tables have company and date (month-ends). ``returns`` has ret and
    mktcap_lag, ``fundamentals`` book_equity and, for logbm, mktcap; without it
    logbm is null.
    """
    key = ["company", "date"]
    size = F.when(F.col("mktcap_lag").isNotNull(), F.ln(F.greatest("mktcap_lag", F.lit(1.0)))).alias("size")
    ratio = F.try_divide(F.col("book_equity"), F.col("mktcap")) if "mktcap" in fundamentals.columns else F.lit(None).cast("double")
    bm = fundamentals.select(*key, F.when(ratio.isNotNull(), F.ln(F.greatest(ratio, F.lit(1e-6)))).alias("logbm"))
    out = mt.join(forward_dated(returns.select(*key, F.col("ret").alias("ret_fwd"))), key)
    out = out.join(returns.select(*key, "ret", size), key, "left").join(bm, key, "left").join(surprises.select(*key, "sue"), key, "left")
    if factors is not None:
        out = out.join(factors, "date", "left")
    return winsorised(momentum(out), [c for c in clip if c in out.columns])
