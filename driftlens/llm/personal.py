"""Personal data (op 11): weak supervision, aggregated.

Patterns propose spans of five kinds: those of the base patterns, and looser
ones (addresses spelled with "at" and "dot", cards side by side or of fewer
digits, numbers without a country's sign, long addresses of hosts, names).
Labelers vote on each: patterns (form, check digits), gazetteers (top domains,
card issuers, calling codes, given names and titles) and context (words before,
characters beside). Spark counts the patterns of votes, of which there are at
most 3 to the power of the labelers for each kind; expectation-maximisation over
these counts estimates how reliable each labeler is, and so how likely each
pattern is personal data. These probabilities teach the final classifier, a
logistic regression over the form and surroundings of a bounded sample of spans,
which sees no votes. Base spans always stay; others that it accepts are added
where they overlap nothing.

All spans are found in one pass over the texts; what follows reads a table of
their candidates only.

Edge cases: null and empty texts have no spans; repeated rows are searched each
for itself; of overlapping candidates the likelier, then the earlier and longer
stays; a kind without candidates learns nothing; an empty table gives no rows;
extra columns are not read. Each pattern walks a text in time in proportion to its
length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, returned, table, written

#: In the order in which spans are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "name")
#: Bounds: spans of a kind that the classifier learns from, its weights for each kind.
SAMPLE_SPANS, WIDTH = 20_000, 1 << 11

# The base patterns, written so that they walk a text once.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser patterns.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[\[({] ?(?:at|AT) ?[\])}]| (?:at|AT)(?= )) ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63})+")
_HOST6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NATIONAL = re.compile(r"(?<![\w+.(-])(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}(?![\w@-])")
_NAME = re.compile(r"\b(?:(?P<title>Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.? )?(?P<given>[A-ZÀ-Þ][a-zß-ÿ]{1,20})(?: (?P<more>[A-ZÀ-Þ][a-zß-ÿ]{1,20}))?\b")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it nl at ch uk us ca eu br pl se".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|62")
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 354 358 359 370 380 420 421".split())
GIVEN = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Hans Peter Klaus Jürgen Wolfgang Stefan Ursula Monika Sabine Petra Anna Jean Pierre Michel Philippe Alain Marie Nathalie Isabelle Sylvie Catherine José Antonio Manuel Francisco Carmen María Dolores Pilar Juan Luis".split())
_WORDS = {
    "email": "mail e-mail email contact write address correo adresse courriel",
    "ip": "ip host server address ping from login addr",
    "card": "card visa mastercard amex credit debit karte carte tarjeta pan cc",
    "phone": "phone tel telephone call fax mobile cell ring telefon téléphone teléfono whatsapp",
    "name": "name by from dear signed author hello contact regards",
}
CONTEXT = {k: frozenset(v.split()) for k, v in _WORDS.items()}
#: Words after which a number is none of the kinds.
OTHER = frozenset("order invoice isbn issn ref reference version v id no serial page item part case ticket section chapter".split())
_BEFORE = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _chain(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """What a chain of digits is by the base pattern, or else the numbers in it that look like cards: runs of whole groups, of 13 to 19 digits that an issuer could have given out and that pass the check."""
    digits = _digits(text[start:end])
    if 16 <= len(digits) <= 19 and luhn(digits):
        return [(start, end)], []
    if len(digits) < 13:
        return [], []
    # check sums up to each digit, with every second digit doubled: those at odd places, and those at even ones
    plain = [int(d) for d in digits]
    twice = [2 * d - 9 if d > 4 else 2 * d for d in plain]
    sums = [[0, *accumulate(t if i % 2 != k else d for i, (d, t) in enumerate(zip(plain, twice)))] for k in (0, 1)]
    groups, found, i = [m.span() for m in re.finditer(r"[0-9]+", text[start:end])], [], 0
    edges = [0, *accumulate(hi - lo for lo, hi in groups)]
    while i < len(groups):
        best = None
        if ISSUERS.match(digits, edges[i]):
            for j in range(i, len(groups)):
                a, b = edges[i], edges[j + 1]
                if b - a > 19:
                    break
                if b - a >= 13 and (sums[(b - 1) % 2][b] - sums[(b - 1) % 2][a]) % 10 == 0:
                    best = j
        if best is None:
            i += 1
        else:
            found.append((start + groups[i][0], start + groups[best][1]))
            i = best + 1
    return [], found


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it is a base span) in the order of kind, then start."""
    out: list[tuple[int, int, int, bool]] = [(0, *s, True) for s in emails(text)]
    if "at" in text or "AT" in text:
        lower = text.lower()
        if "dot" in lower or "at]" in lower or "at)" in lower or "at}" in lower:
            out += [(0, *m.span(), False) for m in _SPELLED.finditer(text)]
    out += [(1, *m.span(), True) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    if text.count(":") >= 7:
        out += [(1, *m.span(), False) for m in _HOST6.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            base, loose = _chain(text, *m.span())
            out += [(2, *s, True) for s in base] + [(2, *s, False) for s in loose]
    out += [(3, *m.span(), True) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    out += [(3, *m.span(), False) for m in _NATIONAL.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out += [(4, *m.span(), False) for m in _NAME.finditer(text) if m["more"] and (m["title"] or m["given"] in GIVEN)]
    return sorted(out)


#: What the labelers look at, in the order of their votes.
LABELERS = ("pattern", "check", "gazetteer", "context", "other context", "surroundings")


def votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """A vote of each labeler: 1 for personal data, 0 against, - for none."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    out = ["1" if base else "-"]
    if name == "email":
        last = re.split(r"[.\s\[({\])}]+", span)[-1]
        out += ["1" if last.isalpha() and len(last) > 1 else "0", "1" if last.lower() in TOP_DOMAINS else "-"]
    elif name == "ip":
        parts = span.split(".")
        plain = ":" in span or all(p == "0" or not p.startswith("0") for p in parts)
        out += ["1" if plain else "0", "1" if ":" in span or 0 < int(parts[0].lstrip("0") or 0) < 224 else "0"]
    elif name == "card":
        out += ["1" if luhn(digits) and len(set(digits)) > 2 else "0", "1" if ISSUERS.match(digits) else "0"]
    elif name == "phone":
        code = next((digits[:k] for k in (1, 2, 3) if digits[:k] in CALLING), None)
        out += ["1" if 10 <= len(digits) <= 13 and len(set(digits)) > 2 else "0", ("1" if code else "0") if span.startswith("+") else "-"]
    else:
        m = _NAME.match(span)
        out += ["1" if m and m["title"] else "-", "1" if m and m["given"] in GIVEN else "0"]
    near = [w.lower() for w in _BEFORE.findall(text[max(0, start - 40) : start])][-3:]
    out.append("1" if not CONTEXT[name].isdisjoint(near) else "-")
    out.append("0" if not OTHER.isdisjoint(near) else "-")
    joined = start and (text[start - 1].isalnum() or text[start - 1] in "_/#=") or end < len(text) and (text[end].isalnum() or text[end] in "_/=")
    out.append("0" if joined else "-")
    return "".join(out)


def _shape(text: str) -> str:
    """Runs of digits by length, letters as a, capitals as A, other characters as they are."""
    out = re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 20)}d", text)
    return re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", out))


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span's form and surroundings."""
    span = text[start:end]
    shape = _shape(span)
    told = [f"s{shape[:60]}", f"n{min(len(_digits(span)), 20)}", f"l{min(len(span), 40) // 4}", f"h{span[:1]}", f"x{len(set(_digits(span))) > 2}"]
    told += [f"g{shape[i : i + 3]}" for i in range(min(len(shape), 40) - 2)]
    told += [f"b{_shape(text[max(0, start - 1) : start])}", f"e{_shape(text[end : end + 1])}"]
    told += [f"w{w.lower()}" for w in _BEFORE.findall(text[max(0, start - 40) : start])[-3:]]
    if kind == 0:
        told.append(f"t{re.split('[^A-Za-z0-9]+', span)[-1].lower()}")
    if kind == 2:
        told += [f"c{luhn(_digits(span))}", f"i{_digits(span)[:2]}"]
    if kind == 4:
        told += [f"v{w}" for w in span.split()[:2]]
    return sorted({xxhash.xxh32_intdigest(x.encode("utf-8", "replace"), kind) % WIDTH for x in told})


_CANDIDATES = "array<struct<kind:int,start:long,end:long,base:boolean,votes:string,features:array<int>>>"
_FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans {_CANDIDATES}"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


@returned
def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            counts, digests, spans = [], [], []
            for text in b.column(1)[at : at + 200].to_pylist():
                text = text or ""
                found = candidates(text)
                base = [c[:3] for c in found if c[3]]
                counts.append([sum(c[0] == k for c in base) for k in range(4)])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append([{"kind": k, "start": s, "end": e, "base": x, "votes": votes(text, k, s, e, x), "features": features(text, k, s, e)} for k, s, e, x in found])
            cols = [b.column(0)[at : at + 200], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, _SPAN_TYPE)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def searched(docs: DataFrame) -> DataFrame:
    """Per document its base spans' numbers and digest, and all candidates with votes and features; written."""
    kept_columns(docs, ("doc_id", "text"))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search, _FOUND))


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 100) -> dict[str, float]:
    """The probability that a span with these votes is personal data, by expectation-maximisation.

    Labelers are taken to vote independently of each other given the truth. Each
    begins with, and keeps as prior counts, being right in eight votes of ten;
    abstaining tells what it tells in the data.
    """
    if not patterns:
        return {}
    n = np.array([c for _, c in patterns], float)
    vote = np.array([["01-".index(v) for v in p] for p, _ in patterns])  # patterns x labelers
    prior = np.array([[8.0, 2.0, 5.0], [2.0, 8.0, 5.0]])  # truth x vote
    agreed = (vote == 1).sum(1) - (vote == 0).sum(1)
    p = 1 / (1 + np.exp(-1.5 * agreed))
    for _ in range(rounds):
        share = (n @ p + 1) / (n.sum() + 2)
        log = np.zeros((2, len(p)))
        for truth, weight in enumerate((n * (1 - p), n * p)):
            for j in range(vote.shape[1]):
                seen = prior[truth] + np.bincount(vote[:, j], weight, 3)
                log[truth] += np.log(seen / seen.sum())[vote[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - share) / share), -500, 500)))
    return {pattern: float(x) for (pattern, _), x in zip(patterns, p)}


def train(rows: list[tuple[list[int], float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on probabilities, by gradient descent over all rows."""
    w = np.zeros(WIDTH + 1)
    if not rows:
        return w
    at = np.concatenate([np.asarray(f, np.int64) for f, _ in rows])
    own = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(own, minlength=len(rows))))
    y = np.array([p for _, p in rows])
    step = np.zeros(WIDTH + 1)
    for _ in range(rounds):
        z = np.bincount(own, w[at], len(rows)) * scale + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(rows)
        step *= 0.9
        step[:-1] -= rate * (np.bincount(at, (g * scale)[own], WIDTH) + decay * w[:-1])
        step[-1] -= rate * g.sum()
        w += step
    return w


def likely(w: np.ndarray, found: list[int]) -> float:
    z = w[found].sum() / max(1, len(found)) ** 0.5 + w[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(found: DataFrame, sample_spans: int = SAMPLE_SPANS) -> tuple[list[dict[str, float]], np.ndarray]:
    """By kind: what each pattern of votes is worth, and the final classifier's weights."""
    each = found.select("doc_id", F.inline("spans"))
    counts = each.groupBy("kind", "votes").count().collect()  # 3 to the power of the labelers for each kind at most
    known = [reliabilities(sorted((r["votes"], r["count"]) for r in counts if r["kind"] == k)) for k in range(len(KINDS))]
    totals = [sum(r["count"] for r in counts if r["kind"] == k) for k in range(len(KINDS))]
    bounds = F.array(*(F.lit(int((1 << 30) * min(1.0, sample_spans / max(1, t)))) for t in totals))
    drawn = each.where(F.pmod(F.xxhash64("doc_id", "start", "end"), F.lit(1 << 30)) < F.element_at(bounds, F.col("kind") + 1))
    # the limit bounds memory, at twice what the hash draws
    rows = drawn.select("kind", "votes", "features").orderBy("kind", "votes", "features").limit(2 * sample_spans * len(KINDS)).collect()
    weights = np.stack([train([(r["features"], known[k][r["votes"]]) for r in rows if r["kind"] == k]) for k in range(len(KINDS))])
    return known, weights


def _final(weights: np.ndarray):
    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found in b.column(6).to_pylist():
                kept = [(c["kind"], c["start"], c["end"]) for c in found if c["base"]]
                taken = _covered(kept)
                more = [(likely(weights[c["kind"]], c["features"]), c) for c in found if not c["base"]]
                for _, c in sorted((x for x in more if x[0] >= 0.5), key=lambda x: (-x[0], x[1]["start"], -x[1]["end"], x[1]["kind"])):
                    if _free(taken, c["start"], c["end"]):
                        kept.append((c["kind"], c["start"], c["end"]))
                out.append(listed(sorted(kept)))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out, pa.string())], [*b.schema.names[:6], "spans"])

    return run


def _covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones, in order; base spans of different kinds may overlap each other."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether nothing taken overlaps; if so, it is taken."""
    i = bisect_left(taken, (start, start))
    if i and taken[i - 1][1] > start or i < len(taken) and taken[i][0] < end:
        return False
    insort(taken, (start, end))
    return True


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = searched(docs)
    _, weights = fit(found)
    return found.mapInArrow(_final(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
