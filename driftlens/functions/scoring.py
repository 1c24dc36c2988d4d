"""Risk scores, flags and small formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_score(n_total: Column, n_dropped: Column, n_persistent: Column, n_other: Column) -> Column:
    """0.5 dropped of all + 0.3 persistent of dropped + 0.2 non-financial of dropped, within 0 and 1."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    raw = 0.5 * share(n_dropped, n_total) + 0.3 * share(n_persistent, n_dropped) + 0.2 * share(n_other, n_dropped)
    return F.when(n_dropped > 0, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def report_flag(score: Column) -> Column:
    return F.when(score > 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def screen_flag(score: Column) -> Column:
    return F.when(score >= 0.15, "HIGH").when(score >= 0.10, "MEDIUM").otherwise("LOW")


def clean_flag(flag: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(flag, F.lit(""))))
    return F.when(s.isin("", "N/A", "NONE"), "UNKNOWN").otherwise(s)


def surprise(actual: Column, mean: Column, stdev: Column) -> Column:
    return F.when(stdev > 0, (actual - mean) / stdev)


def surprise_by_price(actual: Column, mean: Column, price: Column) -> Column:
    return F.try_divide(actual - mean, F.abs(price))


def market_cap(price: Column, shares: Column) -> Column:
    return F.abs(price) * shares / 1000


def log_size(mcap: Column) -> Column:
    return F.when(mcap.isNotNull(), F.ln(F.greatest(mcap, F.lit(1.0))))


def log_book_to_market(book: Column, mcap: Column) -> Column:
    ratio = F.try_divide(book, mcap)
    return F.when(ratio.isNotNull(), F.ln(F.greatest(ratio, F.lit(1e-6))))


def backoff(base: Column, attempt: Column, cap: float) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(cap))


def clipped(x: Column, low: Column, high: Column) -> Column:
    """Null stays null, where least and greatest would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def summary_text(company: Column, quarter: Column, n_total: Column, n_dropped: Column, n_persistent: Column, score: Column, flag: Column) -> Column:
    kept = F.format_string("%s kept all %d targets of the year before in %s; risk %.3f (%s).", company, n_total, quarter, score, flag)
    lost = F.format_string("%s dropped %d of %d targets in %s, %d of them persistent; risk %.3f (%s).", company, n_dropped, n_total, quarter, n_persistent, score, flag)
    return F.when(n_dropped == 0, kept).otherwise(lost)


def recommendation_text(flag: Column) -> Column:
    return F.when(flag == "HIGH", "Ask management about the dropped metrics and review the position.").when(flag == "MEDIUM", "Ask about the dropped metrics and follow them in later quarters.").otherwise("No action; keep monitoring.")


def lenient_number(c: Column) -> Column:
    """A number of a text or of another number, null where it is none."""
    return F.trim(c.cast("string")).try_cast("double")
