"""Targets as phrases: what an amount, a percentage or a product in a sentence is about.

A sentence is cut into tokens, each token gets the letter of its class, and the
letters joined are a string in which a position is a token. Noun chunks and the
walks between them are then regular expressions over that string, whose group
lengths tell where in the token array a phrase lies. All of it is built-in
expressions; a sentence never meets a row-at-a-time function.

Classes: M amount of money, Q percentage, R product, n number, N noun, J
adjective, G participle, D determiner, O pronoun, P preposition, C linking verb,
V verb, A adverb or hedge, W word that opens a clause, K conjunction, . the rest.

* money: the subject of the linking verb before it; else the noun whose
  preposition it follows; else the noun that it stands before;
* percentage: the object of the preposition after the noun that it stands
  before; else that noun's own chunk; else the noun whose preposition it follows;
* product: the noun chunk around it.

Edge cases: null and blank texts have no sentences and give no rows; an entity
about which nothing is found gives none; of equal phrases (case aside) in a
sentence the first stays; repeated components are extracted each for itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Verbs that link a subject to an amount, and verbs that state a goal.
LINKING = ["be", "become", "remain", "total", "reach", "hit", "equal", "come"]
GOALS = ["achieve", "target", "maintain", "expect", "deliver", "reach", "sustain", "exceed", "grow", "generate", "drive", "hit", "attain", "improve", "increase"]

#: Forms that the rules of :func:`forms` do not give.
IRREGULAR = {"be": ["is", "are", "was", "were", "been", "being", "am"], "become": ["became"], "come": ["came"], "grow": ["grew", "grown"], "drive": ["drove", "driven"], "hit": ["hitting"], "total": ["totalled", "totalling"]}
OTHER_VERBS = ["decline", "decrease", "rise", "fall", "report", "see", "have", "post", "record", "raise", "cut", "lower", "spend", "invest", "return", "pay", "earn", "continue", "plan", "forecast", "guide", "anticipate", "believe", "remind", "launch", "ship", "sell", "add", "gain", "lose", "drop", "make", "take", "give", "show", "do"]
OTHER_FORMS = ["rose", "risen", "fell", "fallen", "saw", "seen", "has", "had", "spent", "paid", "sold", "lost", "made", "took", "taken", "gave", "given", "shown", "does", "did", "will", "would", "can", "could", "should", "may", "might", "must"]
#: Words that are verbs or nouns by where they stand.
EITHER = ["increase", "decrease", "decline", "target", "drive", "hit", "reach", "rise", "fall", "gain", "drop", "return", "launch", "report", "record", "forecast", "plan", "cut", "increases", "decreases", "declines", "targets", "drives", "hits", "gains", "drops", "returns", "launches", "reports", "records", "forecasts", "plans", "cuts"]
CLASSES = {
    "D": "the a an our its their this that these those my his her your each every any some all no another both",
    "O": "we it they he she i you us them who",
    "P": "of in for on from at by with to across within into over under between during through per against versus than",
    "A": "approximately approx about around roughly nearly almost more less up down only just not also now still well even very so here there",
    "W": "which while where when whereas because if as since although though after before until what",
    "K": "and or but nor plus",
    "J": "net gross total free new strong record-high higher lower average fiscal full comparable organic core key big large small high low good annual overall solid",
}
#: Nouns that end like adjectives.
NOUNS = "capital rental referral proposal survival objective initiative incentive executive traffic metric logic music clinic receivable payable variable total material goal deal appeal approval arrival table cable music topic public".split()
#: How products are written: two kinds of letters within a word, or capitals and a digit; quarters and years are none.
PRODUCT, PERIOD = r"^(?:[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[A-Z]+[a-z]*-?[0-9]+[A-Za-z]*)$", r"^(?:[QHF][1-4]|[1-4][QH]|FY[0-9]+|CY[0-9]+)$"
#: Words of a product's name after its first.
VERSIONS = ["Pro", "Max", "Plus", "Ultra", "Mini", "Air"]

MONEY = r"[$€£¥] ?[0-9]+(?:[.,][0-9]+)*(?: ?(?:million|billion|trillion|thousand|mn|bn|tn)\b)?"
PERCENT = r"[0-9]+(?:[.,][0-9]+)* ?(?:%|percent\b|bps\b|basis points\b)"
TOKEN = rf"{MONEY}|{PERCENT}|[0-9]+(?:[.,][0-9]+)*|[\p{{L}}][\p{{L}}0-9]*(?:[&'’-][\p{{L}}0-9]+)*|[^\s\p{{L}}0-9]"

#: A noun chunk; a determiner opens one, so that it is never within.
CHUNK = "D?[JGnAMQ]*[NR]+(?:G[NR]+)*"
_BARE = "D?[JGn]*[NR]+(?:G[NR]+)*"
#: The subject of the linking verb that stands at the end of what is before an amount, with what its prepositions add.
SUBJECT = rf"^(.*?)({_BARE}|O)(?:P(?:{CHUNK}|[MQn]))*[AV]*C[AP]*$"
#: The chunk whose preposition an entity follows; the beginning of a chunk that an entity is in.
OWNER, OPEN = rf"^(.*?)({_BARE})PA*$", "^(.*?)(D?[JGnA]*)$"
#: After an entity: the noun that it stands before, and the object of that noun's preposition.
HEAD, OBJECT = "^([JGnA]*[NR]+(?:G[NR]+)*)", rf"^([JGnA]*[NR]+(?:G[NR]+)*P)({_BARE}|O)"


def forms(lemma: str) -> list[str]:
    """A verb with its regular endings, and those of IRREGULAR."""
    stem = lemma[:-1] if lemma.endswith("e") else lemma
    return [lemma, lemma + ("es" if lemma.endswith(("ch", "sh", "s", "x")) else "s"), stem + "ed", stem + "ing", *IRREGULAR.get(lemma, [])]


#: The goal that a form belongs to.
GOAL_OF = {f: v for v in GOALS for f in forms(v)}
_LINKS = sorted({f for v in LINKING for f in forms(v) if f != "being"} - set(EITHER))
_VERBS = sorted({f for v in [*OTHER_VERBS, *GOALS] for f in forms(v)} | set(OTHER_FORMS))


def rules(products: list[str]) -> list[tuple[str, str, object]]:
    """(letter, kind of rule, argument): the first that fits a token tells its class. Kinds: match on the token, in on its lower case, ends on its lower case."""
    out: list[tuple[str, str, object]] = [("M", "match", "^[$€£¥] ?[0-9]"), ("Q", "match", "^[0-9].*(?:%|percent|bps|basis points)$"), ("n", "match", "^[0-9]"), (".", "match", r"^[^\p{L}]")]
    if products:
        out.append(("R", "is", products))
    out += [("N", "match", PERIOD), ("R", "match", PRODUCT), ("R", "is", VERSIONS)]
    out += [("X", "in", EITHER), ("C", "in", _LINKS), *((k, "in", v.split()) for k, v in CLASSES.items()), ("N", "in", NOUNS)]
    goals = [f for f in GOAL_OF if f not in _LINKS]
    out += [("V", "in", sorted(set(goals) | set(_VERBS) - set(EITHER) - set(_LINKS))), ("J", "match", "-"), ("A", "ends", "ly"), ("G", "ends", "(?:ing|ed)"), ("J", "ends", "..(?:al|ive|ous|ful|ic|able|ible|ary)")]
    return out


def _letter(products: list[str]):
    def of(token: Column) -> Column:
        low, out = F.lower(token), None
        for letter, kind, arg in rules(products):
            cond = token.rlike(arg) if kind == "match" else token.isin(arg) if kind == "is" else low.isin(arg) if kind == "in" else low.rlike(f"{arg}$")
            out = F.when(cond, letter) if out is None else out.when(cond, letter)
        return out.otherwise("N")

    return of


#: Words that are verbs or nouns are nouns after what opens a chunk, and after a noun where a preposition follows, else verbs; a number after a product is its own.
SETTLED = [("([QDJGMnP])X", "$1N"), ("NX(P)", "NN$1"), ("X", "V"), ("Rn", "RR")]
#: The chunk that an entity is in, up to the entity; what follows of it.
LEFT, RIGHT = "^(.*?)(D?[JGnAMQN]*)$", "^([JGnA]*[NR]+(?:G[NR]+)*)"
_LABEL = {"M": "MONEY", "Q": "PERCENT", "R": "PRODUCT"}


def tagged(components: DataFrame, products: list[str] = (), text: str = "text") -> DataFrame:
    """A row for each sentence with an amount, a percentage or a product: ``sentence_no``, ``sentence``, ``tokens``, ``tags``."""
    s = components.select("*", F.posexplode(T.sentences(F.coalesce(text, F.lit("")))).alias("sentence_no", "sentence"))
    s = _once(s, "tokens", F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)))
    letters = F.array_join(F.transform("tokens", _letter(list(products))), "")
    return _once(s, "tags", reduce(lambda c, r: F.regexp_replace(c, *r), SETTLED, letters)).where(F.col("tags").rlike("[MQR]"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once for a row: conditions on what is made of it are not pushed below an explode, where each mention would be worked out anew."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _words(start: Column, n: Column) -> Column:
    """``n`` tokens from the 0-based ``start``; null for none."""
    return F.when(n > 0, F.array_join(F.slice("tokens", start + 1, n), " "))


def _len(of: Column, pattern: str, group: int = 1) -> Column:
    return F.length(F.regexp_extract(of, pattern, group))


def _entities() -> Column:
    """Each amount, percentage and run of product words: ``at`` (its first token, from 0), ``width``, ``kind``, and the tags before and after it."""
    tag = lambda i: F.substring(F.col("tags"), i, F.lit(1))
    size = F.length("tags")
    places = F.filter(F.sequence(F.lit(1), size), lambda i: tag(i).isin("M", "Q") | ((tag(i) == "R") & ((i == 1) | (tag(i - 1) != "R"))))
    wide = F.transform(places, lambda i: F.struct(i.alias("place"), F.greatest(F.lit(1), _len(F.substring(F.col("tags"), i, size), "^(R+)")).alias("width")))
    return F.transform(
        wide,
        lambda e: F.struct(
            (e["place"] - 1).alias("at"), e["width"].alias("width"), tag(e["place"]).alias("kind"),
            F.substring(F.col("tags"), F.lit(1), e["place"] - 1).alias("before"), F.substring(F.col("tags"), e["place"] + e["width"], size).alias("after"),
        ),
    )


def _found(e: Column, target: Column, verb: Column) -> Column:
    return F.struct(F.element_at(_map(_LABEL), e["kind"]).alias("entity_label"), _words(e["at"], e["width"]).alias("value_text"), target.alias("target_text"), verb.alias("governing_verb"), (e["kind"] != "R").alias("is_financial"))


def _paper(e: Column) -> Column:
    before, after, behind = e["before"], e["after"], e["at"] + e["width"]
    subject = _words(_len(before, SUBJECT), _len(before, SUBJECT, 2))
    owner = _words(_len(before, OWNER), _len(before, OWNER, 2))
    around = F.when(_len(after, HEAD) > 0, _words(_len(before, OPEN), behind + _len(after, HEAD) - _len(before, OPEN)))
    of_noun = _words(behind + _len(after, OBJECT), _len(after, OBJECT, 2))
    product = _words(_len(before, LEFT), behind - _len(before, LEFT) + _len(after, "^([NR]*(?:G[NR]+)*)"))
    link = F.lower(F.get("tokens", _len(before, "^(.*C)[AP]*$") - 1))
    verb = F.when((e["kind"] == "M") & subject.isNotNull(), F.coalesce(F.element_at(_map({f: v for v in LINKING for f in forms(v)}), link), F.lit(""))).otherwise("")
    target = F.when(e["kind"] == "M", F.coalesce(subject, owner, around)).when(e["kind"] == "Q", F.coalesce(of_noun, around, owner)).otherwise(product)
    return _found(e, target, verb)


def _strict(e: Column) -> Column:
    behind, lead = e["at"] + e["width"], _len(e["before"], LEFT)
    goals = F.zip_with("tokens", F.split("tags", ""), lambda t, k: F.when(k.isin("V", "C"), F.element_at(_map(GOAL_OF), F.lower(t))))
    known = lambda some: F.filter(some, lambda g: g.isNotNull())
    verb = F.coalesce(F.try_element_at(known(F.slice(goals, 1, e["at"])), F.lit(-1)), F.try_element_at(known(F.slice(goals, behind + 1, F.size("tokens"))), F.lit(1)))
    numeric = F.substring(F.col("tags"), lead + 1, behind - lead).rlike("[MQn]")
    return _found(e, F.when(numeric & verb.isNotNull(), _words(lead, behind - lead + _len(e["after"], RIGHT))), verb)


def _targets(components: DataFrame, walk, products: list[str], text: str) -> DataFrame:
    some = F.filter(F.transform(_entities(), walk), lambda t: t["target_text"].isNotNull())
    low = lambda a: F.transform(a, lambda t: F.lower(t["target_text"]))
    s = _once(_once(tagged(components, list(products), text), "all_found", some), "low", low(F.col("all_found")))
    s = _once(s, "found", F.filter("all_found", lambda t, i: F.array_position("low", F.lower(t["target_text"])) == i + 1))
    out = s.select(*components.columns, "sentence_no", "sentence", F.inline("found"))
    return out.withColumn("normalized_text", T.lemmatised_target(F.col("target_text")))


def phrase_targets(components: DataFrame, products: list[str] = (), text: str = "text") -> DataFrame:
    """A row for each target: the components' columns, ``sentence_no``, ``sentence``, ``entity_label``, ``value_text``, ``target_text``, ``governing_verb``, ``is_financial``, ``normalized_text``."""
    return _targets(components, _paper, products, text)


def strict_targets(components: DataFrame, products: list[str] = (), text: str = "text") -> DataFrame:
    """Chunks that hold an entity and a number and are governed by a verb of a goal: the nearest before them, else the first after; columns as in :func:`phrase_targets`."""
    return _targets(components, _strict, products, text)
