"""SimHash near-dedup (op 9) by multi-index hashing.

Whole texts give 64-bit fingerprints of three-word shingles. Distinct
fingerprints are cut into two 32-bit segments; three differing bits leave at
most one in one of them, so each fingerprint enumerates the Hamming ball of
radius 1 around each of its segments (33 keys), fetches the matches of the
segment's table and verifies whole distances. Components come from hooking and
pointer jumping over the verified links.

A task verifies its buckets in numpy and emits a spanning forest of the links
it finds, not every pair, so a dense group costs rows in proportion to its
fingerprints. Two documents of one fingerprint meet as one fingerprint.

Edge cases: null and empty texts have no words, hence fingerprint zero, linked
like any other; texts of one or two words form one shingle; repeated rows join
one component; a row without doc_id gets the component of its fingerprint, null
if no row of the component has an id; an empty input gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_PARTS, SHARE, dropped, kept_columns, parts, returned, salted, table, written
from .components import components

SEED, WORDS, LINK_BITS = 42, 3, 3
_SHIFTS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of the text's words, A-Z lower-cased; fewer words than asked for form one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(w), len(w)
    k = min(words, n)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def fingerprint(text: str) -> int:
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):  # blocks bound the memory of long texts
        ones += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


@returned
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    kept_columns(docs, ("doc_id", "text"))
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


#: Marks a key as the segment table's own row, and one as part of a segment value that very many fingerprints have.
OWN, PART = 1 << 40, 1 << 41


def _balls(hot: np.ndarray):
    """Per fingerprint and segment, the 33 keys of the ball: bit 32 tells the segment; the centre is also the table's row.

    What is left to differ in the other segment is three bits at most, so one of
    its four bytes is equal: keys of ``hot`` are dealt by each of these bytes.
    """
    flips = np.concatenate(([0], np.left_shift(np.int64(1), np.arange(32, dtype=np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2000):
                x = fp[at : at + 2000]
                halves = [(x.view(np.uint64) >> np.uint64(32 * k) & np.uint64(0xFFFFFFFF)).astype(np.int64) for k in (0, 1)]
                for table_no in (0, 1):
                    keys = (halves[table_no][:, None] ^ flips[None, :]) | np.int64(table_no << 32)
                    split = np.isin(keys, hot)
                    keys[:, 0] |= OWN
                    names = np.repeat(x, 33).reshape(keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[~split]), pa.array(names[~split])], ["key", "fp"])
                    rest = np.broadcast_to(halves[1 - table_no][:, None], keys.shape)[split]
                    for j in range(4 if len(rest) else 0):
                        part = keys[split] | PART | (j << 42) | ((rest >> (8 * j) & 255) << 44)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(names[split])], ["key", "fp"])

    return run


def hot_segments(distinct_fps: DataFrame, total: int) -> np.ndarray:
    """Segment values, with their table's number, that more than a thousandth of the fingerprints have: fewer than two thousand."""
    seg = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).bitwiseOR(F.lit(k << 32).cast("long"))
    keys = distinct_fps.select(F.explode(F.array(seg(0), seg(1))).alias("key")).groupBy("key").count()
    found = keys.where(F.col("count") * SHARE > max(total, LEAST_HOT * SHARE)).collect()
    return np.array(sorted(r["key"] for r in found), np.int64)


#: A bucket of so many fingerprints or fewer is never split.
LEAST_HOT = 1000


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while len(x) and ((up := parent[x]) != x).any():
        x = up
    return x


@returned
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in the buckets of one partition."""
    keys, fps = [], []
    for b in batches:
        keys.append(b.column(0).to_numpy(zero_copy_only=False))
        fps.append(b.column(1).to_numpy(zero_copy_only=False))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    own = key >= OWN
    key &= OWN - 1
    t_key, t_fp = key[own], fp[own]
    order = np.argsort(t_key, kind="stable")
    t_key, t_fp = t_key[order], t_fp[order]
    lo, hi = np.searchsorted(t_key, key, "left"), np.searchsorted(t_key, key, "right")
    probe = np.flatnonzero(hi > lo)
    left, count, a = lo[probe], (hi - lo)[probe], fp[probe]
    del key, lo, hi, own
    names = np.unique(np.concatenate((t_fp, a)))
    parent, step = np.arange(len(names)), 0
    t_name = np.searchsorted(names, t_fp)
    while len(a):  # a step looks at the next match of each probe, so memory stays that of the probes
        b = t_fp[left]
        ok = (a < b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= LINK_BITS)
        i, j = np.searchsorted(names, a[ok]), np.searchsorted(names, b[ok])
        new = _roots(parent, i) != _roots(parent, j)
        x_out, y_out = [], []
        for x, y in zip(i[new].tolist(), j[new].tolist()):
            p, q = x, y
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            if p != q:
                parent[max(p, q)] = min(p, q)
                x_out.append(x)
                y_out.append(y)
        if x_out:
            parent = _roots(parent, parent)
            yield pa.RecordBatch.from_arrays([pa.array(names[x_out]), pa.array(names[y_out])], ["a", "b"])
        more = count > 1
        a, left, count = a[more], left[more] + 1, count[more] - 1
        if (step := step + 1) % 32 == 0 and len(a):  # probes whose remaining matches are all linked to them already are done
            roots = np.append(_roots(parent, t_name), -1)
            edges = np.stack((left, left + count), 1).ravel()
            lo, hi = np.minimum.reduceat(roots, edges)[::2], np.maximum.reduceat(roots, edges)[::2]
            open_ = (lo != hi) | (lo != _roots(parent, np.searchsorted(names, a)))
            a, left, count = a[open_], left[open_], count[open_]


def links(distinct_fps: DataFrame, total: int) -> DataFrame:
    """Links (a, b) of fingerprints at most three bits apart that connect what all such links connect."""
    spark = distinct_fps.sparkSession
    balls = distinct_fps.mapInArrow(_balls(hot_segments(distinct_fps, total)), "key long, fp long")
    n = min(parts(spark, total * 66 * 24), MOST_PARTS)
    # the table's row and the probes of a segment value go where the value is hashed to
    return balls.repartition(n, F.col("key").bitwiseAND(F.lit(~OWN).cast("long"))).mapInArrow(_verify, "a long, b long")


def fingerprint_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (doc_id, fp), the smallest document of each (fp, head, n), and links (a, b) of fingerprints; all written."""
    fps = written(fingerprints(docs))
    heads = written(fps.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")))
    return fps, heads, written(links(heads.select("fp"), heads.count()).dropDuplicates(["a", "b"]))


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    fps, heads, pairs = fingerprint_links(docs)
    linked = components(pairs).select(F.col("node").alias("fp"), "component")
    classes = written(heads.join(linked, "fp", "left").select("fp", "n", "head", F.coalesce("component", "fp").alias("root")))
    least = written(classes.groupBy("root").agg(F.min("head").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = written(salted(classes, least.select("root", "component_id"), ["root"], counts=least.select("root", "n")).select("fp", "n", "component_id"))
    dropped(heads, pairs, classes, least)
    return salted(fps, named.drop("n"), ["fp"], counts=named.select("fp", "n"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
