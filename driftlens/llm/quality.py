"""Quality classifier (op 10): supervised subword embeddings.

Each word and each of its character n-grams has a hashed, learned vector; a
document is the mean over all of them, and a softmax layer scores it. Vectors
and layer are trained in numpy by stochastic gradient descent on a bounded
sample of labelled documents, whose whole texts the executors reduce to counts
of features. As the layer is linear in the mean, a task needs
two numbers and a feature count for each distinct word.

Edge cases: null and empty texts have no features and get the score of the
bias; ids without a label are scored but not learned from; an id that repeats is
learned from by one of its texts, once for each of its labels; a table without labels gives 0.5 for all; a
score of exactly 0.5 is predicted 1; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import WordRows, crc_mod, kept_columns, sample_by_hash, slices, table

BUCKETS, DIM, GRAMS = 1 << 18, 12, (3, 4, 5)
#: Bound of the training sample: documents, and about the characters of all of them; longer texts mean fewer documents.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 50_000_000


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's index, bucket) for each word itself and each character n-gram of <word>."""
    marked = [f"<{w}>" for w in words]
    data = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(data))  # characters to the word's end, its own included
    own = [np.arange(len(words))]
    ids = [np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))]
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        ok = np.flatnonzero(left[:m] >= n)
        h = np.full(len(ok), n, np.uint64)
        for i in range(n):
            h = (h ^ data[ok + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        own.append(owner[ok])
        ids.append(h)
    return np.concatenate(own), (np.concatenate(ids) % np.uint64(BUCKETS)).astype(np.int64)


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and each one's share of its features."""
    n = Counter(words_of(text))
    words, total = list(n), np.zeros(BUCKETS)
    times = np.fromiter(n.values(), np.int64, len(n))
    for at in range(0, len(words), 50_000):
        own, ids = features(words[at : at + 50_000])
        total += np.bincount(ids, times[at : at + 50_000][own], BUCKETS)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / max(1, total.sum())).astype(np.float32)


def packed_shares(text: str | None) -> bytes:
    ids, share = shares(text)
    return ids.tobytes() + share.tobytes()


def unpacked_shares(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(found) // 2
    return np.frombuffer(found[:half], np.int32), np.frombuffer(found[half:], np.float32)


class Subwords:
    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.w, self.b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], y: list[int], epochs: int = 6, rate: float = 0.5, seed: int = 10) -> None:
        """Plain stochastic gradient descent, a document's (buckets, shares) at a time; classes weigh alike."""
        y = np.asarray(y)
        weight = [len(y) / (2 * max(1, (y == k).sum())) for k in (0, 1)]
        rng, step, total = np.random.default_rng(seed), 0, epochs * len(docs)
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                ids, share = docs[i]
                lr = rate * (1 - step / total) * min(4.0, weight[y[i]])
                step += 1
                v = self.e[ids]
                mean = share @ v
                z = mean @ self.w + self.b
                p = np.exp(z - z.max())
                g = p / p.sum()
                g[y[i]] -= 1
                dmean = self.w @ g
                self.w -= lr * np.outer(mean, g)
                self.b -= lr * g * 0.1
                # a shared mean moves each vector by its share; scaled up as a text has hundreds of features
                self.e[ids] = v - lr * np.minimum(1.0, 50 * share)[:, None] * dmean[None, :]

    def logits(self) -> np.ndarray:
        """Per bucket its two contributions to the output."""
        return (self.e @ self.w).astype(np.float32)


def scorer(logits: np.ndarray):
    def compute(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 3))
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            own, ids = features(some)
            for k in (0, 1):
                out[at : at + len(some), k] = np.bincount(own, logits[ids, k], len(some))
            out[at : at + len(some), 2] = np.bincount(own, minlength=len(some))
        return out

    return compute


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Subwords | None:
    kept_columns(docs, ("doc_id", "text"))
    kept_columns(labels, ("doc_id", label))
    rows = labelled_sample(docs, labels, [label], crc_mod("doc_id", 3) != 1, packed_shares, sample_docs, sample_chars)
    if not rows:
        return None
    model = Subwords()
    model.train([unpacked_shares(r["found"]) for r in rows], [int(r[label]) for r in rows])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], fold, reduce: Callable[[str | None], bytes], sample_docs: int, sample_chars: int) -> list:
    """A bounded sample of labelled documents, drawn by a hash of the id, in the order of that hash.

    ``found`` is what ``reduce`` makes of a whole text in the executors. If the
    texts of the sample have more than ``sample_chars`` characters together,
    fewer documents are drawn.
    """
    known = labels.where(fold & F.col("doc_id").isNotNull())
    for c in names:
        known = known.where(F.col(c).isNotNull())
    known = known.select("doc_id", *names)
    count = known.count()

    def drawn(most: int) -> DataFrame:
        # at most 2 * sample_docs narrow rows are broadcast
        some = sample_by_hash(known, "doc_id", most, count).limit(2 * sample_docs)
        return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    rows = drawn(sample_docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > sample_chars:
        rows = drawn(max(1, int(min(sample_docs, count) * sample_chars / chars)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([reduce(t) for t in b.column("text").to_pylist()], pa.binary())
            yield b.drop_columns(["text"]).append_column("found", found)

    schema = StructType([f for f in rows.schema if f.name != "text"]).add("found", BinaryType())
    # a doc_id that repeats is learned from once for each of its labels, whichever number of rows has it
    got = rows.mapInArrow(run, schema).groupBy("doc_id", *names).agg(F.min("found").alias("found")).collect()
    return sorted(got, key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["doc_id"], r["found"], *(r[c] for c in names)))


def _score(logits: np.ndarray | None, bias: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None if logits is None else WordRows(3, scorer(logits))
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for lo, hi in slices(texts):
                if rows is None:
                    out += [0.5] * (hi - lo)
                    continue
                s = rows.sums([words_of(t) for t in texts[lo:hi]])
                z = s[:, :2] / np.maximum(s[:, 2:], 1) + bias
                out += (1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Subwords | None) -> DataFrame:
    """doc_id and the probability of label 1; the model's two numbers a bucket (2 MB) go along with the tasks."""
    args = (None, None) if model is None else (model.logits(), model.b)
    return docs.select("doc_id", "text").mapInArrow(_score(*args), "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
