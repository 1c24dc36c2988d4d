"""Lemmas of English words by an exception table and ordered suffix rules, as column expressions.

The first rule whose pattern fits a word gives its lemma; a word that no rule
fits is its own. Words are lower-cased first. Without a tagger a form that could
be several words is read as the commonest, so that one form has one lemma
wherever it stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms by lemma, where no rule leads to it.
IRREGULAR = {
    "be": "is are was were been being am", "have": "has had having", "do": "does did done doing", "go": "goes went gone", "make": "made making", "take": "took taken taking",
    "give": "gave given giving", "come": "came coming", "become": "became becoming", "see": "saw seen", "grow": "grew grown", "rise": "rose risen rising", "fall": "fell fallen", "drive": "drove driven driving",
    "hold": "held", "sell": "sold", "tell": "told", "spend": "spent", "build": "built", "bring": "brought", "buy": "bought", "pay": "paid", "say": "said", "lose": "lost losing", "keep": "kept", "lead": "led",
    "meet": "met", "leave": "left leaving", "find": "found", "get": "got getting", "begin": "began begun", "know": "knew known", "show": "shown", "think": "thought", "win": "won", "write": "wrote written writing",
    "man": "men", "woman": "women", "child": "children", "person": "people", "foot": "feet", "mouse": "mice", "datum": "data", "index": "indices", "analysis": "analyses", "crisis": "crises", "basis": "bases",
    "good": "better best", "bad": "worse worst", "expense": "expenses expensing", "die": "died dying", "lie": "lied lying", "use": "used using uses", "increase": "increased increasing increases", "release": "released releasing releases",
}
EXCEPTIONS = {form: lemma for lemma, forms in IRREGULAR.items() for form in forms.split()}
#: Words that end like other forms and are none.
WHOLE = "sales earnings news savings proceeds gross loss basis analysis hypothesis miss focus chassis bias crisis series species always perhaps during thing things nothing something anything everything morning evening king ring spring string wing bring sing need feed seed speed red bed led hundred indeed".split()

_DOUBLED = [(rf"^(.*[aeiou]{c}){c}(?:ing|ed)$", "$1") for c in "bdgkmnprt"]
#: Ends of stems that lost an e.
_LOST_E = r"(?:[aeiou]v|[aeiou]z|[^aeiouy]at|[iu]at|i[sz]|[aeiou]c|nc|rc|rg|dg|ng|[^aeiou]ur|[aeou]s|rs|ns|u|bl|tl|dl|pl|[aeiou]g|[aio]m|fin|bin|lin|ir|quir|or|scrib|plet|mot|not|vot)"
#: (pattern, lemma), in order.
RULES = [
    (r"^(.{2,}[^aeiou])ies$", "$1y"),
    (r"^(.+(?:ss|sh|ch|x|zz))es$", "$1"),
    (r"^(.+(?:ss|us|is))$", "$1"),
    (r"^(.{3,})s$", "$1"),
    (r"^(.{2,}[^aeiou])ied$", "$1y"),
    *_DOUBLED,
    (rf"^(.*[aeiouy].*{_LOST_E})(?:ing|ed)$", "$1e"),
    (r"^(.*[aeiouy].+)(?:ing|ed)$", "$1"),
]


def by_rules(word: Column) -> Column:
    """The lemma of a lower-case word that no table has."""
    out = F.when(word.isin(WHOLE) | (F.length(word) <= 3), word)
    return reduce(lambda c, r: c.when(word.rlike(r[0]), F.regexp_replace(word, *r)), RULES, out).otherwise(word)


def lemma(word: Column) -> Column:
    low = F.lower(word)
    known = F.create_map(*[F.lit(x) for kv in EXCEPTIONS.items() for x in kv])
    return F.coalesce(F.element_at(known, low), by_rules(low))


def with_lemmas(words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct lower-case words with ``lemma``: the exceptions, a table of under two hundred rows, are joined once for each word, the rules are for the others."""
    table = words.sparkSession.createDataFrame(list(EXCEPTIONS.items()), "__form string, __lemma string")
    joined = words.join(F.broadcast(table), words[word] == table["__form"], "left")
    return joined.withColumn("lemma", F.coalesce("__lemma", by_rules(F.col(word)))).drop("__form", "__lemma")
