"""Language ID (op 7): a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the whole lower-cased text, letters, signs
and spaces alike, in both directions, and labels every byte with a probability
for each language; a document's probabilities are the mean over all its bytes.
Its states run on across words. Texts are read in windows of ``CORE`` bytes with
``CONTEXT`` bytes more on either side, which warm the states up and get their
labels from the window that they belong to, so that memory and time are bounded
for any length.

It is trained in numpy by backpropagation through time, on a bounded sample of
labelled documents of each language, however many languages there are. Training
draws windows from anywhere in their whole texts, each document being as likely
as the next.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
without lang are predicted but not learned from; ties go to the language that
comes first in order; a table without any language to learn gives ``und`` for
all; repeated rows get one and the same prediction; rows without doc_id are
predicted, but not learned from, and their ``held_out`` is null; extra columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, kept_columns, returned, slices, table

HIDDEN = 12
#: Bytes that a window labels, and bytes of context before and after them.
CORE, CONTEXT = 400, 24
#: Windows of a batch; its products stay small enough for one thread.
ROWS = 600
#: Bound of the training sample: documents of a language, and of all languages, but LEAST_DOCS of each at least, and
#: about the characters of all of them; longer texts mean fewer documents.
SAMPLE_DOCS, ALL_DOCS, LEAST_DOCS, SAMPLE_CHARS = 600, 60_000, 20, 40_000_000
#: Training: steps, windows of a step, bytes of a window.
STEPS, BATCH, TRAIN_BYTES = 400, 192, 48
_LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def has_letter(text: str | None) -> bool:
    """Numerals such as a half, which the pattern takes for letters, are none."""
    return bool(text) and any(m.group().isalpha() or any(map(str.isalpha, m.group())) for m in _LETTERS.finditer(text))


def text_of_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class ByteGru:
    """Two gated recurrent layers, one in each direction, and a softmax over languages at each byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))
            self.p[f"c{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        self.p["v"] = rng.normal(0, 0.2, (2 * hidden, len(languages)))
        self.p["o"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _layer(self, d: str, x: np.ndarray, on: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (steps, rows, units) after each byte of x (steps, rows), read forwards or backwards; padding leaves a state as it is."""
        steps, n = x.shape
        k, table_ = self.h, self.p[f"x{d}"].copy()
        # the logistic function by way of tanh
        table_[:, : 2 * k] *= 0.5
        u, c = self.p[f"u{d}"] * table_.dtype.type(0.5), self.p[f"c{d}"]
        h, hs, saved = np.zeros((n, k), table_.dtype), np.empty((steps, n, k), table_.dtype), [()] * steps
        full = on.all(1)[:, 0] if n else np.zeros(steps, bool)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = table_[x[t]]
            zr = h @ u
            zr += g[:, : 2 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :k], zr[:, k:]
            rh = r * h
            cand = rh @ c
            cand += g[:, 2 * k :]
            np.tanh(cand, out=cand)
            if keep:
                saved[t] = (h, z, r, rh, cand)
            step = cand - h
            step *= z
            if not full[t]:
                step *= on[t]
            h = np.add(h, step, out=hs[t])
        return hs, saved

    @staticmethod
    def _padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (steps, rows) and where there are any (steps, rows, 1)."""
        lens = np.fromiter(map(len, windows), np.int64, len(windows))
        on = np.arange(int(lens.max()))[None, :] < lens[:, None]
        x = np.zeros(on.shape, np.uint8)
        x[on] = np.frombuffer(b"".join(windows), np.uint8)
        return np.ascontiguousarray(x.T), np.ascontiguousarray(on.T)[:, :, None].astype(np.float32)

    def _softmax(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        v, k = self.p["v"], self.h
        out = hf @ v[:k]
        out += hb @ v[k:]
        out += self.p["o"]
        out -= out.max(-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(-1, keepdims=True)
        return out

    def labels(self, windows: list[bytes]) -> np.ndarray:
        """(bytes, windows, languages): each byte's probabilities."""
        x, on = self._padded(windows)
        return self._softmax(self._layer("f", x, on)[0], self._layer("b", x, on)[0])

    def pooled(self, windows: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each window the summed probabilities of its bytes from ``first`` to before ``last``."""
        x, on = self._padded(windows)
        hf, hb = self._layer("f", x, on)[0], self._layer("b", x, on)[0]
        out = np.zeros((len(windows), len(self.languages)))
        for a in range(0, len(x), 8):  # blocks stay in the cache
            t = np.arange(a, min(a + 8, len(x)))[:, None]
            mine = ((t >= first) & (t < last)).astype(hf.dtype)
            out += (self._softmax(hf[a : a + 8], hb[a : a + 8]) * mine[:, :, None]).sum(0)
        return out

    def _layer_back(self, d: str, x: np.ndarray, on: np.ndarray, saved: list, dh_all: np.ndarray, grads: dict) -> None:
        u, c, k = self.p[f"u{d}"], self.p[f"c{d}"], self.h
        gx, gu, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros_like(c)
        steps, n = x.shape
        dh, gates = np.zeros((n, k), gx.dtype), np.empty((steps, n, 3 * k), gx.dtype)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, z, r, rh, cand = saved[t]
            dh = dh + dh_all[t]
            m = on[t]
            dz = dh * m * (cand - h)
            dcand = dh * m * z
            dh = dh * (1 - m * z)
            da = dcand * (1 - cand * cand)
            drh = da @ c.T
            gc += rh.T @ da
            dh = dh + drh * r
            dr = drh * h
            dzr = np.concatenate((dz * z * (1 - z), dr * r * (1 - r)), 1)
            gu += h.T @ dzr
            dh = dh + dzr @ u.T
            gates[t, :, : 2 * k], gates[t, :, 2 * k :] = dzr, da
        seen = x.ravel()
        order = np.argsort(seen, kind="stable")
        values, first = np.unique(seen[order], return_index=True)
        gx[values] = np.add.reduceat(gates.reshape(-1, 3 * k)[order], first, axis=0)
        grads[f"x{d}"], grads[f"u{d}"], grads[f"c{d}"] = gx, gu, gc

    def gradients(self, windows: list[bytes], y: np.ndarray) -> tuple[float, dict]:
        x, on = self._padded(windows)
        (hf, sf), (hb, sb) = self._layer("f", x, on, True), self._layer("b", x, on, True)
        probs, total, k = self._softmax(hf, hb), on.sum(), self.h
        t, n = np.arange(len(x))[:, None], np.arange(len(windows))[None, :]
        loss = float(-(np.log(probs[t, n, y[None, :]] + 1e-9) * on[:, :, 0]).sum() / total)
        dl = probs
        dl[t, n, y[None, :]] -= 1
        dl *= on / total
        grads = {"v": np.concatenate((np.einsum("tnk,tnc->kc", hf, dl), np.einsum("tnk,tnc->kc", hb, dl))), "o": dl.sum((0, 1))}
        dboth = dl @ self.p["v"].T
        self._layer_back("f", x, on, sf, dboth[:, :, :k], grads)
        self._layer_back("b", x, on, sb, dboth[:, :, k:], grads)
        return loss, grads

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.015, seed: int = 7) -> list[float]:
        """Adam on windows of whole texts, drawn with each language equally likely, and each of its texts; more languages than a batch take turns in more steps."""
        rng = np.random.default_rng(seed)
        order = np.argsort(y, kind="stable")
        by = np.split(order, np.cumsum(np.bincount(y, minlength=len(self.languages)))[:-1])
        steps *= -(-len(by) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            turn = range(len(by)) if len(by) <= batch else rng.choice(len(by), batch, replace=False)
            pick = np.concatenate([rng.choice(by[k], max(1, batch // len(by) + (len(by) <= batch))) for k in turn])
            at = [int(rng.integers(0, max(1, len(texts[i]) - TRAIN_BYTES + 1))) for i in pick]
            loss, g = self.gradients([texts[i][a : a + TRAIN_BYTES] for i, a in zip(pick, at)], y[pick])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses


def document_labels(model: ByteGru, texts: list[bytes], core: int = CORE, context: int = CONTEXT) -> np.ndarray:
    """For each text its bytes' summed probabilities."""
    at = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), core)]
    cut = [texts[i][max(0, a - context) : a + core + context] for i, a in at]
    before = np.array([min(a, context) for _, a in at], np.int64)
    own = np.array([min(core, len(texts[i]) - a) for i, a in at], np.int64)
    owner = np.array([i for i, _ in at], np.int64)
    out = np.zeros((len(texts), len(model.languages)))
    order = np.argsort(np.fromiter(map(len, cut), np.int64, len(cut)), kind="stable")
    rows = max(1, ROWS * 32 // max(32, len(model.languages)))  # bounds the memory of many languages
    for k in range(0, len(order), rows):
        some = order[k : k + rows]
        np.add.at(out, owner[some], model.pooled([cut[i] for i in some], before[some], (before + own)[some]))
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [text_of_bytes(t) if has_letter(t) else b"" for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["lang", "found"])


def training_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """(lang, bytes) of sampled documents outside the held-out fold that have a lang, for every lang; texts are whole."""
    kept_columns(docs, ("doc_id", "text", "lang"))
    learn = docs.where((crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.avg(F.length("text")).alias("chars")).collect()
    if not counts:
        return []
    most = min(sample_docs, max(LEAST_DOCS, ALL_DOCS // len(counts)))
    chars = sum(min(r["count"], most) * r["chars"] for r in counts)
    most = max(LEAST_DOCS, int(most * min(1.0, sample_chars / max(1.0, chars))))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in counts], "lang string, share double")
    # the draw depends on ids alone
    drawn = learn.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    found = drawn.select("lang", "text").mapInArrow(_packed, "lang string, found binary").toArrow()
    return sorted((lang, t) for lang, t in zip(found.column(0).to_pylist(), found.column(1).to_pylist()) if t)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteGru | None:
    """Learn from documents outside the held-out fold that have a lang."""
    return learned(training_texts(docs, sample_docs))


def learned(rows: list[tuple[str, bytes]]) -> ByteGru | None:
    """A network trained on (lang, bytes); none without rows."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    at = {lang: k for k, lang in enumerate(languages)}
    model = ByteGru(languages)
    model.train([t for _, t in rows], np.array([at[lang] for lang, _ in rows]))
    return model


def _predict(model: ByteGru | None):
    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, pred, score = b.column(1).to_pylist(), [], []
            for lo, hi in slices(texts):
                some = [text_of_bytes(t) if model and has_letter(t) else b"" for t in texts[lo:hi]]
                if model is None:
                    pred += [UND] * len(some)
                    score += [0.0] * len(some)
                    continue
                p = document_labels(model, some) / np.maximum([[len(t)] for t in some], 1)
                best = p.argmax(1)
                pred += [model.languages[k] if t else UND for k, t in zip(best, some)]
                score += [float(min(1.0, x[k])) if t else 0.0 for x, k, t in zip(p, best, some)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """doc_id, lang_pred, score for each row; only the text goes in."""
    return docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


#: Cells of the table of three bytes in a row, and the lengths for which the pipeline's bounds are learned.
CELLS, LENGTHS = 1 << 18, (4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: Windows of each length that bounds are learned from, and how far above the most surprising of them a bound lies, in bits a byte.
BOUND_WINDOWS, MARGIN = 4000, 0.25


def letters_of(text: bytes) -> np.ndarray:
    """The bytes of letters with one space around each run of them; what is no letter does not tell a language."""
    x = np.frombuffer(text, np.uint8)
    x = np.where((x >= 97) & (x <= 122) | (x >= 128), x, 32).astype(np.uint8)
    x = np.concatenate(([32], x, [32])).astype(np.uint8)
    return x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte but the first two, the cell of it and the two before it, and the cell of those two."""
    y = x.astype(np.uint64)
    two = y[:-2] << np.uint64(8) | y[1:-1]
    mix = lambda h: (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
    return mix(two << np.uint64(8) | y[2:]), mix(two + np.uint64(1 << 32))


class Familiar:
    """How surprising a text's letters are, given the two bytes before each, to one who knows the learned texts; and how surprising a learned text can be.

    The network's probabilities tell the learned languages from each other, for any text whatever. This tells whether
    it is in any of them: bounds are set by windows of texts that the counts have not seen.
    """

    def __init__(self, texts: list[tuple[str, bytes]], seed: int = 7):
        found = [(lang, letters_of(t)) for lang, t in texts]
        halves = [found[0::2], found[1::2]]
        rng = np.random.default_rng(seed)
        bounds = np.zeros(len(LENGTHS))
        for learn, rest in (halves, halves[::-1]):
            bits = self._bits(learn)
            rest = [x for _, x in rest if len(x) > 3]
            for i, n in enumerate(LENGTHS):
                for k in rng.integers(0, len(rest), BOUND_WINDOWS) if rest else ():
                    x = rest[k]
                    at = int(rng.integers(0, max(1, len(x) - n - 2)))
                    bounds[i] = max(bounds[i], bits[_cells(x[at : at + n + 2])[0]].mean())
        self.bits, self.bounds = self._bits(found), bounds + MARGIN

    @staticmethod
    def _bits(found: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Bits of surprise by cell, of the language in which it is least."""
        out = np.full(CELLS, np.float32(12.0))
        for lang in sorted({lang for lang, _ in found}):
            three, two, pairs = np.zeros(CELLS), np.zeros(CELLS), np.zeros(CELLS, np.int64)
            for own, x in found:
                if own == lang and len(x) > 2:
                    c, before = _cells(x)
                    three += np.bincount(c, minlength=CELLS)
                    two += np.bincount(before, minlength=CELLS)
                    pairs[c] = before
            seen = three > 0
            out[seen] = np.minimum(out[seen], -np.log2(three[seen] / (two[pairs[seen]] + 1)))
        return out

    def knows(self, text: bytes) -> bool:
        """A text shorter than the shortest length is held to that one's bound, a longer one than the longest to that one's."""
        x = letters_of(text)
        if len(x) < 3:
            return False
        return bool(self.bits[_cells(x)[0]].mean() <= np.interp(np.log(len(x) - 2), np.log(LENGTHS), self.bounds))


def accepted(docs: DataFrame, model: ByteGru | None = None, known: Familiar | None = None) -> DataFrame:
    """The rows of ``docs`` that the network gives a language and whose letters are those of the learned texts, with all their columns.

    Without any language to learn all texts are ``und``, and none is accepted.
    """
    rows = training_texts(docs) if model is None or known is None else []
    model = model or learned(rows)
    known = known or (Familiar(rows) if rows else None)
    run, names = _predict(model), docs.columns
    schema = docs.schema

    @returned
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text = names.index("doc_id"), names.index("text")
        for b in batches:
            out = next(run(iter([pa.RecordBatch.from_arrays([b.column(at), b.column(text)], ["doc_id", "text"])])))
            ok = [p != UND and (known is None or known.knows(text_of_bytes(t.as_py()))) for p, t in zip(out.column(1).to_pylist(), b.column(text))]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
