"""Toxicity (op 4): a classifier chain of linear models.

Categories are predicted one after another; the model of a category sees the
words of the document and the probabilities of the categories before it. Later
models are trained on out-of-fold probabilities of the earlier ones, so that
they learn from predictions as good as those they will meet. Models are L1
logistic regressions over a document's distinct words and their beginnings
(how many of its words begin so, which finds forms of a word that the sample
lacks), fitted in numpy on a bounded sample of labelled documents, whose whole
texts the executors reduce to distinct words; a task looks each distinct word up
once.

Any label columns can be a chain. ``labels`` has two, quality and toxic; op 4
chains ``low_quality`` (quality = 0) and ``toxic``.

Edge cases: null and empty texts have no words and get the models' intercepts;
ids without labels are scored but not learned from; a table without labels
gives 0 for all; repeated rows get the same scores; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordRows, kept_columns, slices, table
from .quality import labelled_sample

_WORD = re.compile(r"[^\W_]+")
#: Bound of the training sample: documents, and about the characters of all of them; longer texts mean fewer documents.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 100_000_000
FOLDS, LEAST_DOCS = 3, 4
#: Distinct words that a task keeps the weights of.
MEMO_WORDS = 200_000
#: Lengths of the beginnings that count besides the whole word.
STARTS = (3, 5, 7)
CATEGORIES = ("low_quality", "toxic")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def packed_words(text: str | None) -> bytes:
    return " ".join(sorted(words_of(text))).encode("utf-8", "surrogatepass")


def unpacked_words(found: bytes) -> list[str]:
    return found.decode("utf-8", "surrogatepass").split(" ") if found else []


def features_of(word: str) -> list[str]:
    """The word and, marked by a hyphen, its beginnings."""
    return [word, *[word[:k] + "-" for k in STARTS if len(word) > k]]


class Sparse:
    """Rows of (column, count)."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.rows = np.repeat(np.arange(len(docs), dtype=np.int32), [len(c) for c, _ in docs])
        self.cols = np.concatenate([np.empty(0, np.int32), *[c for c, _ in docs]])
        self.values = np.concatenate([np.empty(0, np.float32), *[v for _, v in docs]])
        self.n, self.width = len(docs), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols] * self.values, self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows] * self.values, self.width)

    def squares(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows] * self.values**2, self.width)


def counted(texts: list[list[str]]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The features of at least LEAST_DOCS texts, given by their distinct words, and each text's (feature, count)."""
    ids: dict[str, int] = {}
    docs = []
    for words in texts:
        found = [ids.setdefault(f, len(ids)) for w in words for f in features_of(w)]
        docs.append(np.unique(np.array(found, np.int32), return_counts=True))
    n = np.zeros(len(ids), np.int64)
    for c, _ in docs:
        n[c] += 1
    names = [f for f, k in ids.items() if n[k] >= LEAST_DOCS]
    at = np.full(len(ids), -1, np.int32)
    at[[ids[f] for f in names]] = np.arange(len(names))
    return names, [(at[c][at[c] >= 0], v[at[c] >= 0].astype(np.float32)) for c, v in docs]


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray, on: np.ndarray, l1: float = 2e-4, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of words and of (bias, earlier probabilities): accelerated proximal gradient, classes weighing alike."""
    dense = np.concatenate((np.ones((x.n, 1)), extra), 1)
    weight = on * np.where(y == 1, 0.5 / max(1, (on * (y == 1)).sum()), 0.5 / max(1, (on * (y == 0)).sum()))
    # columns are scaled by their squares, which evens out the curvature
    seen = np.maximum(x.squares(weight), 1e-4)
    scale = 1 / np.sqrt(seen)
    w, d = np.zeros(x.width), np.zeros(dense.shape[1])
    vw, vd, t, rate = w, d, 1.0, 0.15
    for _ in range(steps):
        z = x.dot(vw) + dense @ vd
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        new = vw - rate * scale * x.transposed(g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1 * scale, 0)
        nd = vd - rate * (dense.T @ g)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vd = new + (t - 1) / t2 * (new - w), nd + (t - 1) / t2 * (nd - d)
        w, d, t = new, nd, t2
    return w, d


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """For each category the weights of words and beginnings, a bias and the weights of the categories before it."""

    def __init__(self, categories: tuple[str, ...]):
        self.categories, self.words, self.table, self.dense = categories, {}, np.zeros((1, len(categories))), []

    def train(self, texts: list[list[str]], y: np.ndarray, folds: int = FOLDS) -> None:
        names, docs = counted(texts)
        x = Sparse(docs, len(names))
        fold, all_rows = np.arange(x.n) % folds, np.ones(x.n)
        extra, weights = np.zeros((x.n, 0)), []
        for k in range(len(self.categories)):
            w, d = fit_linear(x, extra, y[:, k], all_rows)
            weights.append(w)
            self.dense.append(d)
            if k + 1 < len(self.categories):
                oof = np.zeros(x.n)
                for f in range(folds):
                    fw, fd = fit_linear(x, extra, y[:, k], (fold != f).astype(float))
                    own = fold == f
                    oof[own] = sigmoid(x.dot(fw) + np.concatenate((np.ones((x.n, 1)), extra), 1) @ fd)[own]
                extra = np.concatenate((extra, oof[:, None]), 1)
        table_ = np.array(weights).T.reshape(len(names), -1)
        used = np.flatnonzero(table_.any(1))
        self.words = {names[i]: k for k, i in enumerate(used.tolist())}
        self.table = np.concatenate((table_[used], np.zeros((1, table_.shape[1]))))

    def rows(self, words: list[str]) -> np.ndarray:
        """The summed weights of each word's features; what the sample lacks points at the last row, which is zero."""
        most, none, get = len(STARTS) + 1, len(self.words), self.words.get
        at = np.full((len(words), most), none, np.int64)
        for i, w in enumerate(words):
            for j, f in enumerate(features_of(w)):
                at[i, j] = get(f, none)
        return self.table[at].sum(1)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sums), 0))
        for k, d in enumerate(self.dense):
            z = sums[:, k] + d[0] + out @ d[1:]
            out = np.concatenate((out, sigmoid(z)[:, None]), 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Chain | None:
    """``labels`` has doc_id and a 0/1 column for each category."""
    kept_columns(docs, ("doc_id", "text"))
    kept_columns(labels, ("doc_id", *categories))
    rows = labelled_sample(docs, labels, list(categories), F.lit(True), packed_words, sample_docs, sample_chars)
    if not rows:
        return None
    chain = Chain(tuple(categories))
    chain.train([unpacked_words(r["found"]) for r in rows], np.array([[float(r[c]) for c in categories] for r in rows]))
    return chain


def predict(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...]) -> DataFrame:
    """doc_id and p_<category> for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = None if chain is None else WordRows(len(categories), chain.rows, most=MEMO_WORDS)
        for b in batches:
            texts, out = b.column(1).to_pylist(), [np.zeros((0, len(categories)))]
            for lo, hi in slices(texts):
                out.append(np.zeros((hi - lo, len(categories))) if memo is None else chain.probabilities(memo.sums([list(words_of(t)) for t in texts[lo:hi]])))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(categories)))], ["doc_id", *(f"p_{c}" for c in categories)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    out = predict(docs, fit(docs, labels, CATEGORIES), CATEGORIES)
    return out.withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))
