"""Queries of target phrases in statements made from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lemmas as L
from ..operators import phrases as P
from ..sources import standins as X

PRODUCTS = ["Vision"]


def target_phrases(s, d):
    t = P.phrase_targets(X.statements(s, d), PRODUCTS)
    return t.select("transcript_id", "ord", F.col("sentence_no").cast("long").alias("sentence_no"), "entity_label", "value_text", "target_text", "governing_verb", "is_financial")


def strict_phrases(s, d):
    t = P.strict_targets(X.statements(s, d), PRODUCTS)
    return t.select("transcript_id", "ord", F.col("sentence_no").cast("long").alias("sentence_no"), "entity_label", "value_text", "target_text", "governing_verb", "is_financial")


def lemma_counts(s, d):
    """How often each lemma occurs in the documents of a language, and in how many forms; words are counted before lemmas are looked up."""
    words = X.read(s, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return L.with_lemmas(counts).groupBy("lang", "lemma").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_forms"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _letters() -> str:
    """The classes of tokens as a CASE over ``t``."""
    out = []
    for letter, kind, arg in P.rules(PRODUCTS):
        some = f"({', '.join(map(_q, arg))})" if isinstance(arg, list) else ""
        cond = {"match": lambda: f"regexp_matches(t, {_q(arg)})", "is": lambda: f"t IN {some}", "in": lambda: f"lower(t) IN {some}", "ends": lambda: f"regexp_matches(lower(t), {_q(f'{arg}$')})"}[kind]()
        out.append(f"WHEN {cond} THEN '{letter}'")
    return f"CASE {' '.join(out)} ELSE 'N' END"


def _settled(of: str) -> str:
    for pattern, instead in P.SETTLED:
        of = f"regexp_replace({of}, {_q(pattern)}, {_q(instead.replace('$1', chr(92) + '1'))}, 'g')"
    return of


def _words(start: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN array_to_string(tokens[{start} + 1:{start} + {n}], ' ') END"


def _len(of: str, pattern: str, group: int = 1) -> str:
    return f"length(regexp_extract({of}, {_q(pattern)}, {group}))"


def _map_of(pairs: dict[str, str], word: str) -> str:
    return f"MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in pairs.items())}}}[{word}]"


_FOUND = rf"""{X.STATEMENTS},
s AS (SELECT transcript_id, ord, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM st),
u AS (SELECT transcript_id, ord, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS sentence_no FROM s),
tok AS (SELECT *, regexp_extract_all(sentence, {_q(P.TOKEN)}) AS tokens FROM u),
tag AS (SELECT *, {_settled(f"array_to_string(list_transform(tokens, lambda t: {_letters()}), '')")} AS tags FROM tok),
pl AS (SELECT *, unnest(range(1, length(tags) + 1)) AS place FROM tag),
en AS (SELECT *, place - 1 AS k, substr(tags, place, 1) AS kind, greatest(1, {_len("substr(tags, place)", "^(R+)")}) AS width FROM pl
  WHERE substr(tags, place, 1) IN ('M', 'Q') OR (substr(tags, place, 1) = 'R' AND (place = 1 OR substr(tags, place - 1, 1) <> 'R'))),
e AS (SELECT *, substr(tags, 1, k) AS bef, substr(tags, k + width + 1) AS aft, array_to_string(tokens[k + 1:k + width], ' ') AS value_text FROM en)"""
_LAST = """SELECT transcript_id, ord, sentence_no, CASE kind WHEN 'M' THEN 'MONEY' WHEN 'Q' THEN 'PERCENT' ELSE 'PRODUCT' END AS entity_label, value_text, target_text, governing_verb, kind <> 'R' AS is_financial
FROM f WHERE target_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY transcript_id, ord, sentence_no, lower(target_text) ORDER BY k) = 1"""
_LEMMA = f"""coalesce({_map_of(L.EXCEPTIONS, "word")}, CASE WHEN word IN ({", ".join(map(_q, L.WHOLE))}) OR length(word) <= 3 THEN word {" ".join(f"WHEN regexp_matches(word, {_q(p)}) THEN regexp_replace(word, {_q(p)}, {_q(r.replace('$1', chr(92) + '1'))})" for p, r in L.RULES)} ELSE word END)"""
_LINK = {f: v for v in P.LINKING for f in P.forms(v)}


def _goals(lo: str, hi: str) -> str:
    return f"list_filter(list_transform(range({lo}, {hi}), lambda i: CASE WHEN substr(tags, i, 1) IN ('V', 'C') THEN {_map_of(P.GOAL_OF, 'lower(tokens[i])')} END), lambda g: g IS NOT NULL)"



QUERIES = {
    "lemma_counts": (lemma_counts, f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
      l AS (SELECT lang, n, {_LEMMA} AS lemma FROM c) SELECT lang, lemma, sum(n)::BIGINT AS n, count(*) AS n_forms FROM l GROUP BY ALL"""),
    "target_phrases": (target_phrases, f"""WITH {_FOUND},
g AS (SELECT *, {_words(_len("bef", P.SUBJECT), _len("bef", P.SUBJECT, 2))} AS subject, {_words(_len("bef", P.OWNER), _len("bef", P.OWNER, 2))} AS owner,
  CASE WHEN {_len("aft", P.HEAD)} > 0 THEN {_words(_len("bef", P.OPEN), f"(k + width + {_len('aft', P.HEAD)} - {_len('bef', P.OPEN)})")} END AS around,
  {_words(f"(k + width + {_len('aft', P.OBJECT)})", _len("aft", P.OBJECT, 2))} AS of_noun,
  {_words(_len("bef", P.LEFT), f"(k + width - {_len('bef', P.LEFT)} + {_len('aft', '^([NR]*(?:G[NR]+)*)')})")} AS product,
  {_map_of(_LINK, f"lower(tokens[{_len('bef', '^(.*C)[AP]*$')}])")} AS link FROM e),
f AS (SELECT *, CASE kind WHEN 'M' THEN coalesce(subject, owner, around) WHEN 'Q' THEN coalesce(of_noun, around, owner) ELSE product END AS target_text,
  CASE WHEN kind = 'M' AND subject IS NOT NULL THEN coalesce(link, '') ELSE '' END AS governing_verb FROM g) {_LAST}"""),
    "strict_phrases": (strict_phrases, f"""WITH {_FOUND},
g AS (SELECT *, {_len("bef", P.LEFT)} AS lead, coalesce({_goals("1", "k + 1")}[-1], {_goals("k + width + 1", "length(tags) + 1")}[1]) AS governing_verb FROM e),
f AS (SELECT *, {_words("lead", f"(k + width - lead + {_len('aft', P.RIGHT)})")} AS target_text FROM g WHERE governing_verb IS NOT NULL AND regexp_matches(substr(tags, lead + 1, k + width - lead), '[MQn]')) {_LAST}"""),
}
