"""Benchmark decontamination (op 5): size-partitioned MinHash containment search.

Items are put into size partitions by their number of distinct five-word
shingles, [2^c, 2^(c+1)). A partition sets the size of the bottom MinHash
signatures of its items: an item of n shingles that a document contains to 0.8
or more misses at most floor(0.2 n) of them, so a signature of one more than a
fifth of the partition's largest size always meets the document, however long
that is. Documents are searched for signatures shingle by shingle, not by a
signature of their own, which would lose a short item in a long text.

Signatures and shingles of the items stay in Spark. What goes to the tasks is a
Bloom filter of fixed size, whatever the number of items; documents that pass
it send the shingles that an item may have, and copies of the same matches are
merged before these meet the items in a join. Exact containment on the words of
the shingles decides.

Words are maximal runs of letters and digits of the lower-cased text. Edge
cases: null and empty texts match nothing; an item of one to four words is one
shingle, held against every run of as many words; repeated rows match alike, and
so do rows without doc_id or item_id; ties don't occur, as all items that reach
the threshold are returned; empty tables give an empty result; extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, dropped, kept_columns, passes, returned, salted, table, written

WORDS, LEAST = 5, 0.8
#: Words of a text that are looked at together.
BLOCK_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], k: int = WORDS) -> set[tuple[str, ...]]:
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


class WordHashes:
    """A 64-bit hash per word, kept between texts; forgotten when ``most`` are held."""

    def __init__(self, most: int = 500_000):
        self.known, self.most = {}, most

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.most:
            known.clear()
        return out


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signature_size(n: int, least: float = LEAST) -> int:
    """The bottom hashes that items of n's size partition keep: one more than the largest of them may miss."""
    largest = (1 << n.bit_length()) - 1
    # integers avoid rounding at the threshold
    return largest - -(-int(round(least * 1000)) * largest // 1000) + 1


_ITEM = "item long, item_id long, width int, n_shingles long, size_class int, shingle string, hash long, signature boolean"


def _shingled(least: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in b.columns)):
                w = words_of(text)
                if not w:
                    continue
                names = sorted(shingles(w, k))
                width, n = len(names[0]), len(names)
                h = np.array([_mix(WordHashes().of(list(s)), width)[0] for s in names], np.uint64)
                bottom = np.zeros(n, bool)
                bottom[np.argsort(h, kind="stable")[: signature_size(n, least)]] = True
                cols = ([item] * n, [item_id] * n, [width] * n, [n] * n, [n.bit_length() - 1] * n, [" ".join(s) for s in names], h.view(np.int64), bottom)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in _ITEM.split(", ")])

    return run


def item_shingles(benchmark: DataFrame, least: float = LEAST, k: int = WORDS) -> DataFrame:
    """A row for each distinct shingle of each item row: its size partition and whether it is in the item's signature."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(_shingled(least, k), _ITEM)


def _blocks(text: str, size: int = BLOCK_WORDS, overlap: int = WORDS - 1) -> Iterator[list[str]]:
    """The words of a text in blocks that share the words of a shingle less one."""
    found = (m.group() for m in _WORD.finditer(text.lower()))
    block = list(islice(found, size))
    while block:
        yield block
        more = list(islice(found, size))
        block = block[len(block) - min(overlap, len(block)) :] + more if more else []


_MATCH = "doc_id long, text_hash long, class binary, shingles array<string>"


def _search(widths: list[int], signatures: np.ndarray, wanted: np.ndarray):
    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = []
            for i, text in enumerate(b.column(2).to_pylist()):
                found, hit = set(), False
                for w in _blocks(text) if text else ():
                    h = hashes.of(w)
                    for width in widths:
                        own = _mix(h, width)
                        here = passes(wanted, own)
                        if here.any():
                            hit = hit or bool(passes(signatures, own[here]).any())
                            found.update(" ".join(w[j : j + width]) for j in np.flatnonzero(here).tolist())
                if hit:
                    names = sorted(found)
                    out.append((i, xxhash.xxh3_128_digest("\n".join(names).encode("utf-8", "surrogatepass")), names))
            rows = pa.array([r[0] for r in out], pa.int64())
            cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "class", "shingles"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, k: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared) for every item row that a document row holds to ``least`` or more."""
    kept_columns(docs, ("doc_id", "text"))
    kept_columns(benchmark, ("item_id", "text"))
    items = written(item_shingles(benchmark, least, k))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # k values at most
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = written(seen.mapInArrow(_search(widths, bit_filter(items.where("signature")), bit_filter(items)), _MATCH))
    # documents that hold the same shingles of items, such as copies, are one class
    classes = written(found.groupBy("class").agg(F.first("shingles").alias("shingles"), F.count(F.lit(1)).alias("n")))
    exploded = written(classes.select("class", F.explode("shingles").alias("shingle")))
    met = salted(exploded, items.select("shingle", "item", "item_id", "n_shingles", "signature"), ["shingle"])
    shared = met.groupBy("class", "item", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"), F.max("signature").alias("met"))
    enough = F.col("n_shared") * 1000 >= int(round(least * 1000)) * F.col("n_shingles")
    held = written(shared.where(F.col("met") & enough).select("class", "item_id", "n_shingles", "n_shared"))
    out = salted(found.select("doc_id", "text_hash", "class"), held, ["class"], counts=classes.select("class", "n"))
    dropped(exploded, items)
    return out.select("doc_id", "text_hash", "item_id", "n_shingles", "n_shared")


def contained(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, k: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item that a document holds to ``least`` or more."""
    return matches(docs, benchmark, least, k).select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows without doc_id are told apart by their texts."""
    hit = matches(docs, benchmark).select(F.col("doc_id").alias("__hit"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bs),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM bs JOIN s USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared * 10 >= n_shingles * 8
"""
