"""Joins and picks that have no one-line form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(facts: DataFrame, history: DataFrame, key: str, at: str, start: str, end: str, broadcast: bool = False) -> DataFrame:
    """Facts with the history row of their key that is valid at their date; the key keeps it a hash join."""
    right = F.broadcast(history) if broadcast else history
    f, h = facts.alias("f"), right.alias("h")
    cond = (F.col(f"f.{key}") == F.col(f"h.{key}")) & F.col(f"f.{at}").between(F.col(f"h.{start}"), F.col(f"h.{end}"))
    return f.join(h, cond).select("f.*", *[F.col(f"h.{c}") for c in history.columns if c != key])


def overlapping(links: DataFrame, start: str, end: str, lo: Column, hi: Column, open_end: str = "2099-12-31") -> DataFrame:
    """Links whose validity, open-ended where null, overlaps [lo, hi]."""
    until = F.coalesce(F.col(end), F.to_date(F.lit(open_end)))
    return links.where((F.col(start) <= hi) & (until >= lo))


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[Column | str, ...]) -> DataFrame:
    """The last row of each key by ``order``; a struct maximum, so it is pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*rest).alias("__row")))
    return df.groupBy(*keys).agg(top.getField("__row").alias("__r")).select(*keys, "__r.*")


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order`` (of equal ones the smallest); pre-aggregated before the shuffle, null keys are one key."""
    rest = [c for c in df.columns if c != key]
    first = F.min(F.struct(order, F.struct(*rest).alias("__row"))).getField("__row")
    return df.groupBy(key).agg(first.alias("__r")).select(*[F.col(key) if c == key else F.col(f"__r.{c}") for c in df.columns])


def nearest_date(events: DataFrame, days: DataFrame, key: str, event_date: str, day: str, within: int = 3) -> DataFrame:
    """Events with the nearest day of their key within ``within`` calendar days; the earlier of two as near.

    Days are dealt to the 2 * within + 1 dates that they can serve, which makes it an equi-join.
    """
    e = events.withColumn("__d", F.to_date(event_date))
    d = days.select(key, F.col(day), F.explode(F.array(*[F.lit(i) for i in range(-within, within + 1)])).alias("__off"))
    d = d.withColumn("__d", F.date_add(F.to_date(day), F.col("__off")))
    j = e.join(d, [key, "__d"])
    best = F.min(F.struct(F.abs("__off").alias("o"), F.col(day).alias("day")))
    return j.groupBy(*[c for c in events.columns]).agg(best.getField("day").alias("matched_day"))


def row_positions(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def band_rows(events: DataFrame, rows: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Rows lo..hi places from each event's place; the few events ask for the places that they need."""
    wanted = events.withColumn("rel", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("pos", F.col("event_pos") + F.col("rel"))
    return wanted.join(rows, [key, "pos"])


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def by_priority(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources; for a key in more than one the later source wins."""
    all_rows = None
    for i, f in enumerate(frames):
        f = f.withColumn("__p", F.lit(i))
        all_rows = f if all_rows is None else all_rows.unionByName(f)
    return latest(all_rows, (key,), ("__p",)).drop("__p")


def nested_components(rows: DataFrame, keys: tuple[str, ...], order: str = "ord", text: str = "text", kind: str = "ctype") -> DataFrame:
    """One row for each transcript: components in order, the whole text, their number; transcripts without text go."""
    parts = rows.where(F.length(F.trim(F.col(text))) > 0)
    g = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text), F.col(kind)))).alias("components"))
    return g.withColumns({"whole": F.array_join(F.transform("components", lambda c: c[text]), "\n\n"), "n_components": F.size("components")})
