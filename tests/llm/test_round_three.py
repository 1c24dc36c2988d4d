"""Personal data, divergence of sources and alignment of tokenizers against plain versions, and on odd tables."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm import alignment, divergence, html_extract, language_id, near_copies, personal
from driftlens.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row int, pair long, spans string, kind int, n long, part string, term string"


def frame(spark, rows):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, 7, 7, "x", 7, 7, "x", "x") for i, t, lang, s in rows], DOCS)


ODD = [None, "", " ", "\n\t", "a", "A  b", "É é É", "+", "@", "a@", "@b.c", "x" * 5000, "1" * 5000, "1." * 3000, "1 " * 3000, "a.b@c.d@e.f", "+1 2", "▁", "日本語 の テキスト", "a b  c", "it's they'll 's", "<|endoftext|> a", "<s> </s> <0x41>", "🙂 ok 🙂🙂", "é x", "\x00\x01 a\x7f", "a\r\nb\x85c", "don 't  stop   now ", "a ▁b c"]


# op 11


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            twice = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
            if least <= len(d) <= most and (kind == "phone" or sum(twice) % 10 == 0):
                out.append((kind, *m.span()))
    return out


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


PERSONAL = [
    "mail a.b@c.example.com, or x@y", "a@b.c@d.e f@g.h.", "%@a-b.c-d.", "10.0.0.1.2.3.4.5 256.1.1.1 1.2.3 001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111", "4111 1111 1111 1112",
    "+1 (743) 555-3824 and +49 30 1234567890123456", "+12.345.6789-", "call 030 1234 5678 now", "order 4111111111111111", "write to jane.doe [at] mail [dot] example [dot] org", "Dr. Maria Schmidt and James Miller", "fe80:0:0:0:1:2:3:4 up",
    "+1 743 555 38244111111111111111", "4444 4444 4444 4448 5555", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
]


def test_base_spans(spark):
    texts = [*PERSONAL, *ODD, *(r["text"] for r in table(spark, SF, "documents").select("text").collect())]
    for t in texts:
        t = t or ""
        base = [(personal.KINDS[k], s, e) for k, s, e, own in personal.candidates(t) if own]
        assert base == plain_spans(t), t[:200]


def test_personal_data(spark):
    rows = [(i % 50, t, "en", "s") for i, t in enumerate([*PERSONAL, *ODD, *PERSONAL])]
    got = personal.spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for i, t, *_ in rows:
        base = plain_spans(t or "")
        n = Counter(k for k, *_ in base)
        expected[i, *(n[k] for k in personal.KINDS[:4]), hashlib.sha256(listed(base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == expected
    for r in got:
        base = [listed([x]) for i, t, *_ in rows if i == r["doc_id"] for x in plain_spans(t or "")]
        assert set(r["spans"].split(",")) <= {*base, *r["spans"].split(",")}
    assert personal.spans(frame(spark, [])).count() == 0


def test_added_spans(spark):
    """Cards side by side, which the base drops as one long number, and an address that is spelled out."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    own = ["pay 4111111111111111 5500005555555559 today", "mail jane.doe [at] mail [dot] com please", "the 12 34 56 78 and 1999-2003 of 3 4 5 6", "order 1234 5678 9012 3456"]
    got = {r["doc_id"]: r for r in personal.spans(docs.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(own)], docs.schema))).collect()}
    assert got[-1]["n_card"] == 0 and got[-1]["spans"] == "card:4:20,card:21:37"
    assert got[-2]["spans"] == "email:5:33"
    assert got[-3]["spans"] == "" and got[-4]["spans"] == ""
    base = {r["doc_id"]: listed(plain_spans(r["text"] or "")) for r in docs.collect()}
    assert all(set(base[i].split(",")) - {""} <= set(got[i]["spans"].split(",")) for i in base)
    clean = [i for i, b in base.items() if not b]
    assert sum(got[i]["spans"] != "" for i in clean) <= len(clean) // 100


def test_reliabilities():
    """A labeler that contradicts the others is not believed; the probabilities follow the majority of good ones."""
    found = personal.reliabilities([("111---", 400), ("000---", 300), ("110---", 30), ("001---", 30), ("111--0", 200), ("000--0", 150)])
    assert found["111---"] > 0.95 > 0.05 > found["000---"] and found["110---"] > 0.5 > found["001---"]
    assert personal.reliabilities([]) == {}


def test_long_texts_take_linear_time():
    for part in ("a", "1", "1.", "1 ", "a@", "a.", "@a.b", "+1", "+ ", "(12) ", "12 34 ", "A at ", "Maria ", "dot at "):
        began = time.time()
        personal.candidates(part * (300_000 // len(part)) + " dot")
        assert time.time() - began < 8, part


# op 12


def test_divergence(spark):
    rows = []
    for i in range(60):
        lang, source = ("en", None, "xx")[i % 3], ("s1", "s2", None, "ß")[i % 4]
        rows.append((i % 40, " ".join(["The", "the", "éa", "ÉA", "x" * (i % 3 + 1), f"w{i % 5}b"][: i % 7]) if i % 11 else (None, "", "123 .")[i % 3], lang, source))
    rows += [(100 + i, f"only{i}", "few", f"s{i % 3}") for i in range(9)] + rows[:5]
    for some in (rows, rows[-14:-5], []):
        docs = frame(spark, some)
        got = divergence.audit(docs)
        documents = docs.toPandas()  # noqa: F841
        con = duckdb.connect()
        con.register("documents", documents.astype({"text": "string", "lang": "string", "source": "string"}))
        expected = con.sql(divergence.SQL).fetchall()
        assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == Counter(expected)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "string", "bigint", "int"]


def test_divergence_counts_beyond_longs(spark):
    """A billion times a count does not fit a long."""
    one = spark.createDataFrame([(10**13, 3 * 10**13, 1000)], "n long, total long, v long")
    assert one.select(divergence._share("n", "total", "v")).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2000)


# op 13


def plain_alignment(texts):
    """Per text (a ids, b ids, groups, links), from whole texts."""
    import public_tokenizers

    a_path, b_path = alignment.default_tokenizers()
    assert a_path == public_tokenizers.path("byte_bpe_50k.json")
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
        pieces = [b.id_to_piece(i) for i in ib]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces)]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append(None)
            continue
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 50 else list(__import__("itertools").accumulate(map(len, x))) for x in (ba, bb)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, lo = [], [], 0
        for c in cuts:
            ga, gb = ([i for i, e in zip(ids, es) if lo < e <= c] for ids, es in ((ia, ends[0]), (ib, ends[1]))) if len(cuts) < 400 else (None, None)
            groups.append((ga, gb))
            links.append((ia[ends[0].index(c)], ib[ends[1].index(c)]) if len(cuts) < 400 else None)
            lo = c
        if len(cuts) >= 400:  # the same in one walk
            groups, links, i, j = [], [], 0, 0
            for c in cuts:
                x, y = i, j
                while ends[0][i] != c:
                    i += 1
                while ends[1][j] != c:
                    j += 1
                groups.append((ia[x : i + 1], ib[y : j + 1]))
                links.append((ia[i], ib[j]))
                i, j = i + 1, j + 1
        out.append((len(ia), len(ib), groups, links))
    return out


def expected_alignment(rows):
    found = plain_alignment([t for _, t in rows])
    n = Counter(x for f in found if f for x in f[3])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = Counter()
    for (i, _), f in zip(rows, found):
        if f is None:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        out[i, f[0], f[1], len(f[2]), len(f[3]), sum(n[x] == most[x[1]] for x in f[3]), sum(n[x] for x in f[3]), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_groups", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [2, 1 << 16])
def test_alignment(spark, hot):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None if i % 9 == 5 else 2**60 + i % 25, t) for i, t in enumerate([*ODD, *ODD[:9]])], docs.schema)
    docs = docs.union(odd).withColumn("row", F.lit(1)).withColumn("pairs", F.lit("x"))
    found = alignment.aligned(docs, *alignment.default_tokenizers())
    got = alignment.with_counts(found, alignment.pair_counts(found), hot).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == expected_alignment([tuple(r)[:2] for r in docs.select("doc_id", "text").collect()])


def test_alignment_of_nothing(spark):
    found = alignment.aligned(frame(spark, []), *alignment.default_tokenizers())
    assert alignment.with_counts(found, alignment.pair_counts(found)).count() == 0


def test_units_that_cannot_be_joined(monkeypatch):
    """Where a unit would end within a token, units are encoded each for itself."""
    paths = alignment.default_tokenizers()
    u = alignment.Units(alignment.ByteTokens(paths[0]), alignment.PieceTokens(paths[1]))
    v = alignment.Units(u.a, u.b)
    monkeypatch.setattr(v, "_add", lambda units, a, b, ends, own=v._add: len(units) == 1 and own(units, a, b, ends))
    texts = ["one two three", "it's four", "two two"]
    assert [r[:4] for r in u.rows(texts)] == [r[:4] for r in v.rows(texts)]


def test_units_are_forgotten():
    a, b = alignment.ByteTokens(alignment.default_tokenizers()[0]), alignment.PieceTokens(alignment.default_tokenizers()[1])
    few, many = alignment.Units(a, b, 3), alignment.Units(a, b)
    texts = ["one two three four", "two five six", None, "one", "it 's a   test\n of\tspaces "]
    as_lists = lambda u: [(*r[:4], r[4].tolist(), r[5].tolist()) for r in u.rows(texts)]
    assert as_lists(few) == as_lists(many)


# near copies, language and pages: cases that went wrong before


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_near_copies_of_repeated_ids(spark):
    """An id with unlike texts loses only the row that has a near copy; of a group the row of the smallest id, then digest, stays."""
    rng = random.Random(3)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(5, a), (5, b), (3, b + " one"), (9, c), (9, c + " more"), (9, c + " last"), (4, a.upper()), (None, a), (-1, None), (-1, ""), (8, "")]
    got = sorted((r.doc_id or 0, r.text or "") for r in near_copies.keep_one(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect())
    first = min((hashlib.md5(t.encode()).hexdigest(), t) for t in (c, c + " more", c + " last"))[1]
    assert got == sorted([(4, a.upper()), (3, b + " one"), (9, first), (0, a), (-1, "")])


@pytest.mark.parametrize("rows", [1, 7, 10**6])
def test_runs_hold_whole_keys(rows):
    rng = np.random.default_rng(rows)
    key = np.sort(rng.integers(0, 60, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.arange(len(k)))], ["key", "v"]) for k in np.split(key, np.sort(rng.integers(0, 1000, 40)))]
    runs = list(near_copies._runs(iter(batches), rows))
    assert np.concatenate([r[0] for r in runs]).tolist() == key.tolist()
    assert all(x[0][-1] != y[0][0] for x, y in zip(runs, runs[1:])) and (rows > 7 or len(runs) > 20)
    assert list(near_copies._runs(iter([]))) == []


def test_rejected_languages(spark):
    """What is in no learned language goes, though the network names one; what is in one stays."""
    rng = random.Random(4)
    foreign = [
        "\u0421\u044a\u0435\u0448\u044c \u0436\u0435 \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a", "\u6211\u80fd\u541e\u4e0b\u73bb\u7483\u800c\u4e0d\u4f24\u8eab\u4f53",
        "Kaikki ihmiset syntyv\u00e4t vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu j\u00e4rki ja omatunto.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)), base64.b64encode(rng.randbytes(400)).decode(), "x", "12 34 !", None,
    ]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rows = language_id.training_texts(docs)
    model, known = language_id.ByteGru(sorted({lang for lang, _ in rows}), hidden=2), language_id.Familiar(rows)
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign)], docs.schema)
    got = {r.doc_id for r in language_id.accepted(docs.union(more), model, known).select("doc_id").collect()}
    assert not [foreign[-1 - i] for i in got if i < 0]
    own = {r.doc_id for r in docs.collect() if language_id.has_letter(r.text)}
    assert len(own - got) <= len(own) // 100


PAGES = [
    ("<p data-x=it's>first don't stop</p><p>second para</p>", "first don't stop\n\nsecond para"),
    ('<p title="a > b">one</p><p title=\'x"y\'>two</p>', "one\n\ntwo"),
    ("<p class=a\"b title = 'q>r' >one's</p><p>isn't</p>", "one's\n\nisn't"),
    ('<p class="navy-blue">one</p><p class="recommended">two</p><p class="promo widget">three</p>', "one\n\ntwo\n\nthree"),
    ('<p>one</p><div class="recommended"><p>box</p></div><div class="navbar">menu</div><div class="navigate-well"><p>two</p></div><p class="advert">buy</p><p class="sponsored">buy</p>', "one\n\ntwo"),
    ("<p>for <math><mi>x</mi><mo>&gt;</mo><mn>2</mn></math> only</p>", "for x>2 only"),
    ("<p>a<!-->b<!-- > -- --!>c<!---->d</p><p class=comment class=x>no</p><p class=x class=comment>yes</p>", "abcd\n\nyes"),
    ("<p>one</p><script>if (a</b/.exec(c)) '</script foo>'</script >x<p>two</p>", "one\n\n'\n\ntwo"),
    ("<p =x>one</p><p a==b'>two</p>", "one\n\ntwo"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_attributes_and_class_words(page, text):
    got = html_extract.text_at(f"<html><body><article>{page}</article></body></html>", None)
    if "script" in page:  # what follows the script's end is text of the article
        assert got.startswith("one") and got.endswith("two") and "exec" not in got
    else:
        assert got == text


def test_tags_take_linear_time():
    for part in ("<p a='", '<p a="', "<p a=", "<!--", "<a b=c", "<", "<p '", "</script", "='"):
        began = time.time()
        html_extract.parse("<body>" + part * (200_000 // len(part)))
        assert time.time() - began < 10, part


def test_terms_between_separators(spark):
    """Texts that begin, end or consist of what lies between terms count as a scan for terms counts them; each text is scanned by a split, not match by match."""
    import re
    from collections import Counter

    from driftlens.llm import divergence

    texts = ["", " ", "..a", "a..", "-B b-", "\x00x\x7fÉé Z", "a1b2", "\n\t", "ab ab  AB"]
    out = divergence.term_counts(spark.createDataFrame([(t, "l", "s") for t in texts], "text string, lang string, source string"))
    found = [[re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x)] for x in texts]
    assert {r.term: r.n for r in out.collect()} == Counter(t for f in found for t in f) and {r.term: r.docs for r in out.collect()} == Counter(t for f in found for t in set(f))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
