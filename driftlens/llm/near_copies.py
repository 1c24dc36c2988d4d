"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the multi-index tables of :mod:`simhash` and, as many such
pairs differ in more bits than its balls hold, from a prefix filter that makes
the result exact: all shingles are put into one order; two sets that similar
share one at least of the first n - ceil(0.8 n) + 1 shingles of each, so only
those prefixes are exchanged. The order puts shingles that a sample of the
documents repeats last, the most frequent at the end, so that boilerplate rarely
is in a prefix; the sample decides the cost only, as any order finds all pairs.

No group is turned into all its pairs. First, fingerprint links and one pair a
document, with the smallest document of its prefix shingles, are verified on
whole sets; they join dense groups into components. Then only pairs of
documents in different components are listed, at those prefix shingles that can
be the first that they share. What is before it then is in one set only, and of
what follows sketches (the parities of shingles in 256 classes by hash, which
differ in no more places than the sets) tell how much is: both bound their
overlap from above. A shingle goes with
minima over those before it: two sets with a minimum in common share an earlier
one, where they are listed. Where the bounds still reach 0.8 wide sketches, with
two classes for each shingle, and then their prefixes are held against each
other, which bounds the overlap further, and only what is left is verified. A link within a component could not change the components.

Words are those of the fingerprints of ``simhash``. Edge cases: null and empty
texts have no words and are copies of each other only; a text of one to four
words is one shingle; rows without doc_id have no copies; an empty input gives
an empty result; extra columns are not read. ``keep_one`` tells rows apart, not
ids: an id that repeats with unlike texts has a row for each, repeated rows are
copies of each other, and of the smallest doc_id's rows the one with the
smallest digest stays. The other functions take ids that don't repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_PARTS, bit_filter, dropped, kept_columns, parts, passes, returned, salted, sample_by_hash, written
from .components import components
from .simhash import fingerprint_links, shingle_hashes

WORDS = 5
#: The similarity as a fraction; integers avoid rounding at the threshold.
NUM, DEN = 4, 5
#: The order's sample: documents, its most frequent shingles that are kept (8 bytes each go to the tasks).
ORDER_DOCS, ORDER_KEYS = 10_000, 100_000


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes in order; a text without words has the one element 0."""
    h = shingle_hashes(text or "", WORDS)
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


#: Classes of a sketch: eight bits of a shingle's hash.
SKETCH_BITS = 256
#: Odd factors, each of which orders shingles in another way.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def sketch(h: np.ndarray) -> bytes:
    """Whether the number of shingles in each class is odd; two sketches differ in at most as many places as their sets."""
    return np.packbits(np.bincount(h >> np.uint64(56), minlength=SKETCH_BITS).astype(np.uint8) & 1, bitorder="little").tobytes()


def wide_sketch(h: np.ndarray) -> bytes:
    """As :func:`sketch`, with two classes or more for each shingle, by the first bits of its hash: a power of two, eight at least."""
    bits = max(3, int(2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def places_apart(x: bytes, y: bytes) -> int:
    """In how many places two wide sketches differ, the larger one with neighbouring classes joined until both have as many."""
    a, b = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (x, y))
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[0::2] ^ a[1::2]
        else:
            b = b[0::2] ^ b[1::2]
    return int(np.count_nonzero(a != b))


def need(n):
    """The least overlap of a set of n with any set that is similar to it."""
    return (NUM * n + DEN - 1) // DEN


def _sets(wanted: np.ndarray):
    """The sets of documents whose ids pass a filter."""

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(passes(wanted, mixed(ids)))
            for at in range(0, len(rows), 500):
                some = pa.array(rows[at : at + 500])
                grams = [shingle_set(t).tobytes() for t in b.column(1).take(some).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), pa.array(grams, pa.binary())], ["doc_id", "grams"])

    return run


def mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of ids, as :func:`bit_filter` takes it from ``xxhash64`` of theirs."""
    return np.fromiter((xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) for i in ids), np.uint64, len(ids))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], ["key"])


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that a sample of documents repeats, the most frequent last."""
    some = sample_by_hash(docs, "doc_id", ORDER_DOCS, docs.count()).select("text")
    counts = some.mapInArrow(_hashes, "key long").groupBy("key").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "key").limit(ORDER_KEYS).select("key").toArrow()
    return top.column(0).to_numpy()[::-1].view(np.uint64)


def _prefixes(last: np.ndarray):
    order = np.argsort(last)
    known = last[order]

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, texts = b.column(0)[at : at + 500], b.column(1)[at : at + 500].to_pylist()
                keys, sizes, marks, wide = [], [], [], []
                for t in texts:
                    h = shingle_set(t)
                    n = len(h)
                    marks.append(sketch(h))
                    wide.append(wide_sketch(h))
                    if len(known):
                        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        rank = np.where(known[place] == h, order[place], -1)
                        h = h[np.argsort(rank, kind="stable")]
                    keys.append(h[: n - need(n) + 1].view(np.int64))
                    sizes.append(n)
                ends = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), lists, pa.array(marks, pa.binary()), pa.array(wide, pa.binary())], ["doc_id", "n", "keys", "sketch", "wide"])

    return run


#: Rows of whole keys that a task works on at once; a key with more is worked on alone.
RUN_ROWS = 400_000


def _runs(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by their first, in runs of whole keys of about ``rows`` rows."""
    rows = rows or RUN_ROWS
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        last = held[-1][0][-1]
        if n < rows or held[0][0][0] == last:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(cols[0], last))  # the last key may go on
        yield [c[:cut] for c in cols]
        held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


@returned
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, nb) for each document b of a prefix shingle whose smallest document a is of similar size."""
    for key, doc, n in _runs(batches):
        order = np.lexsort((doc, key))
        key, doc, n = key[order], doc[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        head = np.repeat(first, np.diff(np.append(first, len(key))))
        ok = (doc != doc[head]) & (NUM * np.maximum(n, n[head]) <= DEN * np.minimum(n, n[head]))
        for at in range(0, int(ok.sum()), 200_000):
            rows = np.flatnonzero(ok)[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[head[rows]], doc[rows], n[rows])], ["a", "b", "nb"])


#: Prefix shingles that are made into rows at once, and pairs that are held at once.
STEP_ROWS, STEP_PAIRS = 100_000, 300_000
_LOW, _SKETCH = [f"low{i}" for i in range(len(FACTORS))], [f"s{i}" for i in range(SKETCH_BITS // 64)]
_PLACED = ", ".join(["key long, pos int, doc_id long, n int, comp long", *(f"{c} long" for c in _LOW + _SKETCH)])


@returned
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle: its place, its document, minima over the shingles before it (0 at the first place), the sketch of it and those after it."""
    for b in batches:
        ends = b.column(2).offsets.to_numpy().astype(np.int64)
        marks = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, SKETCH_BITS // 64)
        doc, n, comp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
        values = b.column(2).values.to_numpy()
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_ROWS, "right")) - 1)
            edges = ends[at : to + 1] - ends[at]
            key = values[ends[at] : ends[to]]
            low = np.zeros((len(FACTORS), len(key)), np.uint64)
            for mixed_, out in zip((key.view(np.uint64) * np.uint64(f) for f in FACTORS), low):
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    np.minimum.accumulate(mixed_[x : y - 1], out=out[x + 1 : y])
            row = np.repeat(np.arange(at, to), np.diff(edges))
            starts = edges[row - at]
            pos = (np.arange(len(key)) - starts).astype(np.int32)
            after = []
            for i in range(marks.shape[1]):
                kind = key.view(np.uint64) >> np.uint64(56)
                bit = np.where(kind >> np.uint64(6) == i, np.uint64(1) << (kind & np.uint64(63)), np.uint64(0))
                before = np.bitwise_xor.accumulate(np.append(np.uint64(0), bit))[:-1]
                after.append(before ^ before[starts] ^ marks[row, i])
            for x in range(0, len(key), STEP_ROWS):
                part = slice(x, x + STEP_ROWS)
                r = row[part]
                cols = [key[part], pos[part], doc[r], n[r], comp[r], *(v[part].view(np.int64) for v in (*low, *after))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "pos", "doc_id", "n", "comp", *_LOW, *_SKETCH])
            at = to


@returned
def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each prefix shingle that can be the first one shared by two similar documents in different components."""
    for cols in _runs(batches):
        yield from _crossed(cols)


def _crossed(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((cols[2], cols[4], cols[0]))
    new_key = np.append(np.diff(cols[0][order]) != 0, True)
    # shingles of one component only have no partners
    alone = np.append(True, new_key[:-1]) & new_key
    order, new_key = order[~alone], new_key[~alone]
    cols = [c[order] for c in cols]
    pos, doc, n, comp = cols[1], cols[2], cols[3].astype(np.int64), cols[4]
    low, marks = cols[5 : 5 + len(FACTORS)], [c.view(np.uint64) for c in cols[5 + len(FACTORS) :]]
    new_run = new_key | np.append(comp[1:] != comp[:-1], True)[: len(comp)]
    rows = np.arange(len(doc))
    # the run of a row's component ends here, and the rows of its key end there; what lies between are its partners
    first = np.flatnonzero(new_run)[np.searchsorted(np.flatnonzero(new_run), rows)] + 1
    last = np.flatnonzero(new_key)[np.searchsorted(np.flatnonzero(new_key), rows)] + 1
    count = last - first
    busy = np.flatnonzero(count)
    while len(busy):
        held = np.cumsum(count[busy])
        take = max(1, int(np.searchsorted(held, STEP_PAIRS, "right")))
        left = np.repeat(busy[:take], count[busy[:take]])
        right = np.arange(len(left)) - np.repeat(held[:take] - count[busy[:take]], count[busy[:take]]) + first[left]
        # the first shingle that two sets share has nothing in common before it
        overlap = -(-NUM * (n[left] + n[right]) // (NUM + DEN))
        ok = (np.minimum(n[left] - pos[left], n[right] - pos[right]) >= overlap) & (doc[left] != doc[right])
        left, right, overlap = left[ok], right[ok], overlap[ok]
        # two that share an earlier shingle are listed there
        early = np.zeros(len(left), bool)
        for v in low:
            early |= v[left] == v[right]
        ok = ~early | (pos[left] == 0) | (pos[right] == 0)
        left, right, overlap = left[ok], right[ok], overlap[ok]
        apart = pos[left].astype(np.int64) + pos[right]
        for v in marks:
            apart += np.bitwise_count(v[left] ^ v[right])
        ok = n[left] + n[right] - apart >= 2 * overlap
        x, y = doc[left[ok]], doc[right[ok]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        busy = busy[take:]


@returned
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose wide sketches differ in no more places than two similar sets of their sizes do."""
    for batch in batches:
        n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        most = n - 2 * -(-NUM * n // (NUM + DEN))
        ok = [places_apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(4), batch.column(5), most.tolist())]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


@returned
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(DEN * shared >= NUM * (len(s) + len(t) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def prefix_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, n, keys, sketch, wide): the number of a document's shingles, those in its prefix, and the sketches of all; written."""
    return written(docs.mapInArrow(_prefixes(frequent(docs)), "doc_id long, n int, keys array<long>, sketch binary, wide binary"))


def met(rows: DataFrame, total: int, width: int = 32) -> DataFrame:
    """Rows of prefix shingles, of ``width`` bytes each, with those of one shingle after one another in one partition."""
    return rows.repartition(min(parts(rows.sparkSession, width * total), MOST_PARTS), "key").sortWithinPartitions("key")


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and grams, the whole set, of the documents in ``pairs``, and of few others; written. Texts stay where they are."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = bit_filter(ids.select(F.xxhash64("id").alias("hash")))
    return written(docs.mapInArrow(_sets(wanted), "doc_id long, grams binary"))


def star_pairs(keys: DataFrame, total: int) -> DataFrame:
    """(a, b): each document with that document that is the smallest of most of its prefix shingles, if of a quarter of them."""
    shared = met(keys.select(F.explode("keys").alias("key"), "doc_id", "n"), total).mapInArrow(_stars, "a long, b long, nb long").groupBy("a", "b", "nb").agg(F.count(F.lit(1)).alias("k"))
    prefix = F.col("nb") - F.floor((NUM * F.col("nb") + DEN - 1) / DEN) + 1
    best = shared.where(4 * F.col("k") >= prefix).groupBy("b").agg(F.max(F.struct("k", (-F.col("a")).alias("neg"))).alias("h"))
    return best.select((-F.col("h.neg")).alias("a"), "b")


def cross_pairs(keys: DataFrame, total: int, components_: DataFrame) -> DataFrame:
    """(a, b) of documents in different components that can still be similar, as their prefixes tell; written."""
    named = components_.select(F.col("node").alias("doc_id"), "component")
    of = keys.join(named, "doc_id", "left").select("doc_id", "n", "keys", "sketch", F.coalesce("component", "doc_id").alias("comp"))
    pairs = written(met(of.mapInArrow(_placed, _PLACED), total, 64).mapInArrow(_cross, "a long, b long").distinct())
    # first by sketches, which are a thirtieth of the sets, then by prefixes, which are a fifth
    x, y = (keys.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
    told = written(salted(pairs, x, ["a"]).join(y, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_close, "a long, b long"))
    dropped(pairs)
    pairs = told
    # beyond the prefix that ends first, at most the rest of its own set is shared; prefixes are a fifth of the sets
    one, two = (keys.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"k{c}")) for c in "ab")
    both = salted(pairs, one, ["a"]).join(two, "b")
    rest = F.greatest(*(F.floor((NUM * F.col(c) + DEN - 1) / DEN) - 1 for c in ("na", "nb")))
    could = (NUM + DEN) * (F.size(F.array_intersect("ka", "kb")) + rest) >= NUM * (F.col("na") + F.col("nb"))
    out = written(both.where(could).select("a", "b").distinct())
    dropped(pairs)
    return out


def n_keys(keys: DataFrame) -> int:
    return keys.agg(F.sum(F.size("keys"))).first()[0] or 0


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose similarity is 0.8 or more; the pairs of a hub are split among tasks."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = salted(pairs, one, ["a"]).join(two, "b").select("a", "b", "ga", "gb")
    return both.mapInArrow(_similar, "a long, b long").distinct()


def usable(docs: DataFrame) -> DataFrame:
    kept_columns(docs, ("doc_id", "text"))
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def similar_pairs(docs: DataFrame) -> DataFrame:
    """(a, b), a < b: every two documents whose similarity is 0.8 or more; for groups of bounded size, as it lists all pairs."""
    docs = usable(docs)
    alone = docs.sparkSession.createDataFrame([], "node long, component long")
    keys = prefix_keys(docs)
    pairs = cross_pairs(keys, n_keys(keys), alone)
    return verified(pairs, sets_of(docs, pairs))


def groups(docs: DataFrame) -> DataFrame:
    """(node, component) of documents with a near copy: the smallest doc_id that links of similarity 0.8 or more reach."""
    docs = usable(docs)
    fps, heads, near = fingerprint_links(docs)
    head = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    linked = near.join(head[0], "a").join(head[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    copies = salted(fps, heads.where("n > 1").select("fp", "head"), ["fp"], counts=heads.select("fp", "n")).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    keys = prefix_keys(docs)
    total = n_keys(keys)
    first = linked.union(copies).union(star_pairs(keys, total)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = written(first.where("a < b").distinct())
    sets = sets_of(docs, first)
    links = written(verified(first, sets))
    dropped(fps, heads, near, first, sets)
    apart = cross_pairs(keys, total, components(links))
    sets = sets_of(docs, apart)
    more = written(verified(apart, sets))
    dropped(keys, apart, sets)
    return components(links.union(more))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose near copies, or theirs in turn, lead to one with a smaller (doc_id, digest); with all their columns.

    Rows are numbered once, in a written table, as ids may repeat; its numbers are the nodes of all links.
    """
    kept_columns(docs, ("doc_id", "text"))
    rows = written(docs.withColumn("__node", F.monotonically_increasing_id()))
    known = rows.where(F.col("doc_id").isNotNull())
    found = written(groups(known.select(F.col("__node").alias("doc_id"), "text")))
    order = F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.col("__node").alias("node"))
    named = found.join(known.select(F.col("__node").alias("node"), order.alias("order")), "node")
    stay = written(named.groupBy("component").agg(F.min("order").alias("o")).select(F.col("o.node").alias("node")))
    gone = found.join(stay, "node", "left_anti").select(F.col("node").alias("__gone"))
    return rows.join(gone, rows["__node"] == gone["__gone"], "left_anti").drop("__node")
