"""Metric names, ids and texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lemmas import lemma

# Surface forms and what they stand for, applied by length, longest first.
SYNONYMS = {
    "revenues": "revenue",
    "net sales": "revenue",
    "sales": "revenue",
    "top line": "revenue",
    "topline": "revenue",
    "gross margins": "gross margin",
    "operating margins": "operating margin",
    "net margins": "net margin",
    "ebitda margins": "ebitda margin",
    "earnings per share": "eps",
    "earning per share": "eps",
    "comparable store sales": "comp sales",
    "comp store sales": "comp sales",
    "same store sales": "comp sales",
    "active users": "users",
    "monthly active users": "mau",
    "daily active users": "dau",
    "free cash flows": "free cash flow",
    "operating cash flow": "cash flow from operations",
    "cash flow from operating activities": "cash flow from operations",
}
# Words without meaning of their own.
FILLERS = ["the", "a", "an", "our", "my", "its", "their", "his", "her", "this", "that", "these", "those", "of", "in", "on", "for", "to", "from", "as", "by", "at", "with", "and", "or"]
# Words that only look like plurals.
SINGULARS = ["sales", "earnings", "news", "savings", "proceeds", "gross", "loss", "basis", "analysis", "hypothesis", "miss", "focus", "chassis", "bias", "crisis"]
# Plural endings and what they become, first match first.
PLURALS = [("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("s", "")]
# Units and magnitudes.
UNITS = r"\b(percent(?:age)?|pct|bps|basis\s+points?|bp|million|billion|trillion|thousand|mn|bn|tn|mm|k|x)\b"
# Words of approximation.
HEDGES = (
    r"\b(approximately|approx\.?|about|around|roughly|nearly|almost|over|under|above|below|more\s+than|less\s+than|up\s+to|at\s+least|at\s+most|"
    r"no\s+(?:more|less)\s+than|between|range\s+of|in\s+the\s+range\s+of|north\s+of|south\s+of|low|mid|high|single|double|triple|digits?|plus|minus)\b"
)
# Numbers and currency signs.
NUMBER = r"\b\d+(?:[.,]\d+)*\b"
CURRENCY = "[$€£¥]"


def _gone(c: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, " "), patterns, c)


def singular(word: Column) -> Column:
    """A word without its plural ending; short words and those of SINGULARS stay."""
    out = F.when(F.length(word) <= 3, word).when(word.isin(SINGULARS) | word.endswith("ss"), word)
    for ending, instead in PLURALS:
        rest = F.concat(word.substr(F.lit(1), F.length(word) - len(ending)), F.lit(instead))
        out = out.when(word.endswith(ending) & (F.length(rest) >= 2), rest)
    return out.otherwise(word)


def canonical_metric(name: Column) -> Column:
    """The key under which metric names are matched; empty for null and for what has no words."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), "[-_/]", " "), r"\s+", " ")
    for surface in sorted(SYNONYMS, key=lambda k: -len(k)):
        s = F.regexp_replace(s, rf"\b{surface}\b", SYNONYMS[surface])
    s = _gone(s, CURRENCY, r"\b(?:fy|q|h)\d+\b", NUMBER, UNITS, "%", "[-_/]", r"[^a-z0-9\s]")
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: (w != "") & ~w.isin(FILLERS))
    return F.coalesce(F.array_join(F.transform(words, singular), " "), F.lit(""))


def normalised_target(text: Column) -> Column:
    """A target phrase without currency, numbers, units and hedges, words in the singular, leading determiners dropped."""
    s = F.regexp_replace(_gone(F.trim(F.lower(text)), CURRENCY, NUMBER, UNITS, "%", HEDGES), r"\s+", " ")
    words = F.transform(F.filter(F.split(F.trim(s), " "), lambda w: w != ""), singular)
    joined = F.array_join(words, " ")
    return F.coalesce(F.trim(F.regexp_replace(joined, r"^(?:(?:the|a|an|our|its|their|this|that|these|those|we|it|they)\s+)+", "")), F.lit(""))


# Words that determine or stand for what follows, which a phrase does not begin with.
LEADING = "the a an our its their this that these those my his her your each every any some all no we it they he she i you".split()


def lemmatised_target(text: Column) -> Column:
    """As :func:`normalised_target`, with each word's lemma instead of its singular, and without punctuation."""
    s = F.regexp_replace(_gone(F.trim(F.lower(text)), CURRENCY, NUMBER, UNITS, "%", HEDGES), r"\s+", " ")
    words = F.filter(F.transform(F.split(F.trim(s), " "), lambda w: F.regexp_replace(w, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")), lambda w: w != "")
    # the words from the first that does not lead
    first = F.array_position(F.transform(words, lambda w: ~w.isin(LEADING)), True)
    kept = F.when(first > 0, F.slice(words, first.cast("int"), F.size(words))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_join(F.transform(kept, lemma), " "), F.lit(""))


def target_key(normalised: Column, raw: Column) -> Column:
    """What a target is matched by: the normalised text unless it is empty, else the raw one, trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(F.nullif(normalised, F.lit("")), raw)))


def company_id(c: Column) -> Column:
    """An id as text, without the ".0" that a float left."""
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), F.lit(""))


def padded_key(c: Column, width: int = 6) -> Column:
    """Zeros in front up to ``width``; longer keys stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def transcript_parts(c: Column) -> Column:
    """company_id, fiscal_year, fiscal_quarter and quarter of an id such as 18711.0_2023Q4; other ids are kept as company."""
    pattern = r"^(\d+(?:\.\d+)?)_(\d{4})Q([1-4])$"
    year, n = F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3)
    ok = year != ""
    return F.struct(
        F.when(ok, company_id(F.regexp_extract(c, pattern, 1))).otherwise(F.coalesce(c, F.lit(""))).alias("company_id"),
        F.when(ok, year.try_cast("int")).alias("fiscal_year"),
        F.when(ok, n.try_cast("int")).alias("fiscal_quarter"),
        F.when(ok, F.concat(year, F.lit("Q"), n)).otherwise("").alias("quarter"),
    )


def vector_id(company: Column, quarter: Column, name: Column) -> Column:
    slug = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))
    return F.concat_ws("__", company, quarter, F.substring(slug, 1, 54), F.substring(F.md5(name), 1, 8))


def embed_text(name: Column, context: Column) -> Column:
    return F.regexp_replace(F.trim(F.concat(name, F.lit(". "), F.coalesce(context, F.lit("")))), r"\.+$", "")


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def packed_chunks(parts: Column, budget: int) -> Column:
    """Sentences packed in order into chunks of at most ``budget`` tokens; one that is longer is cut by characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    chars = 4 * budget

    def step(acc: Column, s: Column) -> Column:
        both = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        flushed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / chars).cast("int")), lambda i: s.substr(i * chars + 1, F.lit(chars)))
        return (
            F.when(token_estimate(s) > budget, F.struct(F.concat(flushed, cut).alias("done"), F.lit("").alias("open")))
            .when((acc["open"] == "") | (token_estimate(acc["open"]) + token_estimate(s) <= budget), F.struct(acc["done"].alias("done"), both.alias("open")))
            .otherwise(F.struct(flushed.alias("done"), s.alias("open")))
        )

    return F.aggregate(parts, empty, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


# What marks a metric as financial or not; the financial list wins.
FINANCIAL = ["revenue", "sales", "earnings", "eps", "ebitda", "ebit", "net income", "gross margin", "operating margin", "free cash flow", "fcf", "capex", "guidance", "outlook", "forecast", "return on", "roe", "roa", "roic", "dividend"]
NON_FINANCIAL = ["employee", "headcount", "hiring", "retention", "satisfaction", "customer", "net promoter", "nps", "engagement", "diversity", "sustainability", "carbon", "emission", "esg", "safety", "incident", "brand", "culture", "training", "community", "social", "market share", "pipeline", "backlog", "product launch", "innovation", "r&d output"]


def _has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def is_financial(flag: Column, name: Column) -> Column:
    """The flag where there is one, else by keyword; true where no keyword tells."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(flag, F.when(_has_any(n, FINANCIAL), True).when(_has_any(n, NON_FINANCIAL), False).otherwise(True))


# Company names and their tickers.
TICKERS = {
    "Apple Inc.": "AAPL",
    "Microsoft Corporation": "MSFT",
    "Amazon.com, Inc.": "AMZN",
    "Alphabet Inc.": "GOOGL",
    "Meta Platforms, Inc.": "META",
    "Tesla, Inc.": "TSLA",
    "NVIDIA Corporation": "NVDA",
    "Broadcom Inc.": "AVGO",
    "Oracle Corporation": "ORCL",
    "Cisco Systems, Inc.": "CSCO",
    "Accenture plc": "ACN",
    "Texas Instruments Incorporated": "TXN",
    "QUALCOMM Incorporated": "QCOM",
    "Intel Corporation": "INTC",
    "Advanced Micro Devices, Inc.": "AMD",
    "International Business Machines Corporation": "IBM",
    "Salesforce, Inc.": "CRM",
    "Adobe Inc.": "ADBE",
    "JPMorgan Chase & Co.": "JPM",
    "Bank of America Corporation": "BAC",
    "The Goldman Sachs Group, Inc.": "GS",
    "Morgan Stanley": "MS",
    "BlackRock, Inc.": "BLK",
    "The Charles Schwab Corporation": "SCHW",
    "Visa Inc.": "V",
    "Mastercard Incorporated": "MA",
    "AT&T Inc.": "T",
}


def ticker_of(ticker: Column, name: Column, candidates: list[str], names: dict[str, str] | None = None) -> Column:
    """The row's own ticker, else by exact name, else the first candidate (in order) within the name, else empty."""
    known = F.create_map(*[F.lit(x) for kv in (names or TICKERS).items() for x in kv])
    found = F.lit("")
    for c in reversed([c for c in candidates if c]):
        found = F.when(F.contains(F.upper(name), F.lit(c.upper())), c.upper()).otherwise(found)
    return F.coalesce(F.nullif(F.upper(F.trim(ticker)), F.lit("")), F.element_at(known, name), found)


# Component types.
COMPONENTS = {1: "press release", 2: "presentation", 3: "analyst question", 4: "management answer"}
PRIORITY = {2: 4, 4: 3, 3: 2, 1: 1}


#: The labels that transcripts of calls have.
CALL_COMPONENTS = {2: "Mgmt Presentation", 3: "Analyst Question", 4: "Mgmt Answer"}


def component_label(c: Column, labels: dict[int, str] | None = None) -> Column:
    """Null for a type without label."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in (labels or COMPONENTS).items() for x in kv]), c)


def component_priority(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), c)


def humanised(n: Column) -> Column:
    """Billions, millions and thousands by letter; smaller numbers with six digits, without zeros at the end; a last digit of exactly five is rounded up."""
    a = F.abs(n)
    few = F.when(a >= 100, F.format_string("%.3f", n))
    for least, places in ((10, 4), (1, 5), (0.1, 6), (0.01, 7), (0.001, 8), (0.0001, 9)):
        few = few.when(a >= least, F.format_string(f"%.{places}f", n))
    tiny = F.regexp_replace(F.format_string("%.5e", n), r"\.?0+e", "e")
    return (
        F.when(a >= 1e9, F.concat(F.format_string("%.2f", n / 1e9), F.lit("B")))
        .when(a >= 1e6, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M")))
        .when(a >= 1e3, F.concat(F.format_string("%.1f", n / 1e3), F.lit("K")))
        .when(n == 0, "0")
        .when((a > 0) & (a < 0.0001), tiny)
        .otherwise(F.regexp_replace(few, r"\.?0+$", ""))
    )


#: Characters of a context that is kept beside a vector, and of one that is shown.
STORED_CHARS, SHOWN_CHARS = 512, 160


def stored_context(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, STORED_CHARS)


def shown_context(value: Column, unit: Column, trend: Column, framing: Column, period: Column, fallback: Column) -> Column:
    """What is shown of a target: its number with its unit, its direction, framing and period; else the fallback; cut at SHOWN_CHARS."""
    some = lambda c: F.nullif(c, F.lit(""))
    number = humanised(value)
    with_unit = F.when(F.contains(unit, F.lit("USD")), F.concat(F.lit("$"), number)).when(some(unit).isNotNull() & ~unit.isin("none", "None"), F.concat(number, F.lit(" "), unit)).otherwise(number)
    told = F.concat_ws(" · ", F.when(value.isNotNull(), with_unit), some(trend), F.replace(some(framing), F.lit("_"), F.lit(" ")), some(period))
    return F.substring(F.coalesce(some(told), fallback, F.lit("")), 1, SHOWN_CHARS)
