"""Target phrases by hand."""

from pyspark.sql import functions as F

from driftlens.functions import lemmas as L
from driftlens.functions import text as T
from driftlens.operators import phrases as P

CASES = [
    ("Net income was $1.67 billion.", [("MONEY", "$1.67 billion", "Net income", "be")]),
    ("We saw a 12% year-over-year increase in Mac sales.", [("PERCENT", "12%", "Mac sales", "")]),
    ("Net income of the group was approximately $2 billion.", [("MONEY", "$2 billion", "Net income", "be")]),
    ("In Q4, revenue came in at $5 million, up 12%.", [("MONEY", "$5 million", "revenue", "come")]),
    ("Revenue of $5 billion exceeded expectations.", [("MONEY", "$5 billion", "Revenue", "")]),
    ("The new iPhone 15 Pro launch went well.", [("PRODUCT", "iPhone 15 Pro", "The new iPhone 15 Pro", "")]),
    ("We expect to deliver free cash flow of $3 billion.", [("MONEY", "$3 billion", "free cash flow", "")]),
    ("Gross margin of 45% was strong.", [("PERCENT", "45%", "Gross margin", "")]),
    ("Operating margin was 45%.", []),
    ("We made a $20 million investment in data centers.", [("MONEY", "$20 million", "a $20 million investment", "")]),
    ("We target 10% growth.", [("PERCENT", "10%", "10% growth", "")]),
    ("AirPods and MacBook Air sales increased 8%.", [("PRODUCT", "AirPods", "AirPods", ""), ("PRODUCT", "MacBook Air", "MacBook Air sales", "")]),
    ("Services revenue grew to $9 billion.", []),
    ("Mac sales were $5 million, and mac sales were $6 million.", [("MONEY", "$5 million", "Mac sales", "be")]),
    ("The Surface line and a surface were sold.", [("PRODUCT", "Surface", "The Surface line", "")]),
    ("It was quiet. Revenue totaled €1,250.5 million!", [("MONEY", "€1,250.5 million", "Revenue", "total")]),
    (None, []),
    (" \n ", []),
    ("$ % . ,", []),
]
STRICT = [
    ("Revenue of $5 billion exceeded expectations.", [("MONEY", "$5 billion", "exceed")]),
    ("We expect to deliver free cash flow of $3 billion.", [("MONEY", "$3 billion", "deliver")]),
    ("We target 10% growth.", [("PERCENT", "10% growth", "target")]),
    ("Services revenue grew to $9 billion.", [("MONEY", "$9 billion", "grow")]),
    ("Net income was $1.67 billion.", []),
    ("The new iPhone improved.", []),
    ("We drove 3 iPhone launches.", [("PRODUCT", "3 iPhone", "drive")]),
]


def test_phrases(spark):
    df = spark.createDataFrame([(i, 7, t) for i, (t, _) in enumerate(CASES)], "id int, tokens int, text string").drop("tokens")
    got = P.phrase_targets(df, ["Surface"]).collect()
    for i, (text, want) in enumerate(CASES):
        assert [(r.entity_label, r.value_text, r.target_text, r.governing_verb) for r in got if r.id == i] == want, text
    assert [r.normalized_text for r in got if r.id == 9] == ["investment"] and all(r.is_financial == (r.entity_label != "PRODUCT") for r in got)


def test_strict_phrases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STRICT)], "id int, text string")
    got = P.strict_targets(df).collect()
    for i, (text, want) in enumerate(STRICT):
        assert [(r.entity_label, r.target_text, r.governing_verb) for r in got if r.id == i] == want, text


def test_repeated_components_and_plan(spark):
    """Equal rows give their targets each; nothing is exchanged, and no Python runs."""
    df = spark.createDataFrame([(1, CASES[0][0])] * 3, "id int, text string")
    out = P.phrase_targets(df)
    assert out.count() == 3 and P.phrase_targets(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_tokens_are_cut_once(spark):
    """Sentences are cut into tokens in one place of the plan: conditions on what is found do not cut them again."""
    df = spark.createDataFrame([(1, CASES[0][0])], "id int, text string")
    for find in (P.phrase_targets, P.strict_targets):
        plan = find(df).drop("normalized_text")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and "LocalRelation" not in plan


LEMMAS = {
    "companies": "company", "margins": "margin", "boxes": "box", "losses": "loss", "loss": "loss", "status": "status", "basis": "basis", "sales": "sales", "grew": "grow", "was": "be", "growing": "grow", "Running": "run",
    "planned": "plan", "increasing": "increase", "driving": "drive", "improved": "improve", "expanding": "expand", "generating": "generate", "applied": "apply", "selling": "sell", "charged": "charge", "reduced": "reduce",
    "things": "things", "red": "red", "gas": "gas", "bus": "bus", "processes": "process", "exceeded": "exceed", "people": "person", "shipping": "ship", "expenses": "expense", "acquired": "acquire", "éléments": "élément",
}


def test_lemmas(spark):
    df = spark.createDataFrame([(w,) for w in LEMMAS], "word string")
    got = {r.word: r.lemma for r in df.select("word", L.lemma(F.col("word")).alias("lemma")).collect()}
    want = LEMMAS
    assert got == want
    low = df.select(F.lower("word").alias("word"))
    assert {r.word: r.lemma for r in L.with_lemmas(low).collect()} == {w.lower(): x for w, x in want.items()}


def test_lemmatised_targets(spark):
    cases = {"Our growing services revenues": "grow service revenue", "the approximately $5 million of expenses,": "of expense", "It": "", None: "", "12% year-on-year increases": "year-on-year increase", "These the capital expenditures (net)": "capital expenditure net", "all of the margins": "of the margin"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.n for r in df.select("i", T.lemmatised_target(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == list(cases.values())
