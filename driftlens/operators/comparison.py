"""Two extractors side by side, and what is made of the better one's targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the verdict: the difference in F1, and the level of significance.
F1_MARGIN, LEVEL = 0.05, 0.05


def alpha_comparison(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' mean_coef, nw_tstat and p_value by ``keys``, their differences (null where a side is) and who is significant.

    A side without a p-value is not significant.
    """
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{n}") for c, n in (("mean_coef", "alpha"), ("nw_tstat", "tstat"), ("p_value", "p_value"))])
    j = side(base, "base").join(side(other, "other"), keys)
    significant = lambda p: F.coalesce(F.when(~F.isnan(f"{p}_p_value"), F.col(f"{p}_p_value") < LEVEL), F.lit(False))
    return j.withColumns({
        "alpha_improvement": F.col("other_alpha") - F.col("base_alpha"),
        "tstat_improvement": F.col("other_tstat") - F.col("base_tstat"),
        "base_significant": significant("base"),
        "other_significant": significant("other"),
    })


def verdict(delta_f1: Column, base_alpha: Column, other_alpha: Column, base_significant: Column, other_significant: Column) -> Column:
    """OTHER_BETTER, BASE_BETTER or SIMILAR: a higher alpha that alone is significant decides, else F1 by more than its margin."""
    return (
        F.when((other_alpha > base_alpha) & other_significant & ~base_significant, "OTHER_BETTER")
        .when((base_alpha > other_alpha) & base_significant & ~other_significant, "BASE_BETTER")
        .when(delta_f1 > F1_MARGIN, "OTHER_BETTER")
        .when(delta_f1 < -F1_MARGIN, "BASE_BETTER")
        .otherwise("SIMILAR")
    )


def latex_table(rows: DataFrame, label: str, cols: list[str], digits: int = 3) -> DataFrame:
    """One row a table line, numbers with ``digits`` places; header and rules are put around it by :func:`latex_document`.

    Numbers are written by Python, which rounds the stored value; Spark's format_string rounds its shortest decimal.
    """

    @F.pandas_udf("string")
    def line(name: pd.Series, *cells: pd.Series) -> pd.Series:
        return pd.Series([" & ".join([n, *(f"{x:.{digits}f}" for x in xs)]) + r" \\" for n, *xs in zip(name, *cells)], dtype=object)

    return rows.select(label, line(F.coalesce(F.col(label).cast("string"), F.lit("")), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("line"))


def latex_document(lines: list[str], heads: list[str]) -> str:
    body = [r"\begin{tabular}{l" + "r" * (len(heads) - 1) + "}", r"\hline", " & ".join(heads) + r" \\", r"\hline", *lines, r"\hline", r"\end{tabular}"]
    return "\n".join(body)


def training_rows(components: DataFrame, targets: DataFrame, key: str, template: str, held_out: float = 0.1, seed: int = 42) -> DataFrame:
    """Prompt and answer of each text that has targets, split by a hash of its key, so that reruns split alike.

    ``targets`` has the key, ``pos`` and the fields of a target, which go into the answer as JSON in order. Null and
    blank texts and texts without targets give no row.
    """
    fields = [c for c in targets.columns if c not in (key, "pos")]
    answers = targets.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("t")))), lambda x: x["t"])).alias("answer"))
    rows = components.where(F.length(F.trim("text")) > 0).join(answers, key)
    whole = F.replace(F.replace(F.lit(template), F.lit("{text}"), F.trim("text")), F.lit("{targets}"), F.col("answer"))
    share = F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.lit(1000)) / 1000.0
    return rows.select(key, "answer", whole.alias("prompt"), F.when(share < held_out, "test").otherwise("train").alias("split"))


def without_company(index: DataFrame, company: str, column: str = "company") -> DataFrame:
    """The vector index without a company's rows; rows without a company stay."""
    return index.where(~F.col(column).eqNullSafe(company))
