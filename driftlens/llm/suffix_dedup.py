"""Suffix-array dedup (op 1) by bucket-pointer refinement.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller doc_id. Sorting all suffixes of a large corpus would move every
position; here only sampled ones move:

1. Every 50-byte window is assigned to the leftmost of its 20-grams with the
   smallest hash. Equal windows are assigned to equal 20-grams at equal
   offsets, so a window can repeat only where its 20-gram does. Distinct
   20-gram hashes of each block of documents are exchanged, and those of two
   texts or more are candidates.
2. The windows of each candidate, with their text, go where its hash goes.
   Equal stretches are merged first, both before and after the exchange: all
   but the smallest doc_id lose them. The suffixes of the others are sorted by
   bucket-pointer refinement: initial 8-gram buckets, in order, are split by the
   pointers of the buckets at a later offset; the new pointers hold at once, so
   that buckets refined later, and the parts of a bucket, which are refined
   recursively, see the finer order, and each bucket's known depth grows by
   that of the bucket it was sorted by. It ends with buckets of one suffix or
   of a depth of 50; neighbours in this order that share 50 bytes are equal.
3. Each document's covered ranges are united and its remaining bytes hashed.

Whole copies of a text are found by digest and need no windows; large groups of
copies are split among tasks. A passage that very many documents share costs
each block of documents one stretch. Buckets of a bounded size are dealt to a
bounded number of partitions, and a task works through them one at a time.

Edge cases: null texts are empty; texts of under 50 bytes stay whole; rows with
one doc_id don't match each other; rows without doc_id match nothing and stay
whole; repeated rows get equal results; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_runs, dealt, dropped, kept_columns, parts, salted, table, text_bytes, text_of, written

LENGTH, GRAM = 50, 20
#: 20-grams in a window.
SPAN = LENGTH - GRAM + 1
BLOCK = 1 << 20
_MULT = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(33)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20 bytes from each position (too few at the end: left out)."""
    h = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)

    def twice(x: np.ndarray, n: int) -> np.ndarray:
        return x[:-n] * np.uint64(_MULT[n]) + x[n:]

    h4 = twice(twice(h, 1), 2)
    h16 = twice(twice(h4, 4), 8)
    out = h16[: len(buf) - GRAM + 1] * np.uint64(_MULT[4]) + h4[16 : 16 + len(buf) - GRAM + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows assigned to one 20-gram: document, first window, windows, 20-gram's place, its hash (places in the joined texts)."""
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < LENGTH:
        return none
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    h = gram_hashes(buf)
    at = np.arange(len(h), dtype=np.int32)
    low, n = h, 1
    while n < SPAN:  # doubling: the smallest of n, 2n, 4n ... from each place, the leftmost of equals
        step = min(n, SPAN - n)
        right_is_less = low[step:] < low[:-step]
        at = np.where(right_is_less, at[step:], at[:-step])
        low = np.where(right_is_less, low[step:], low[:-step])
        n += step
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(texts)), np.maximum(lens - LENGTH + 1, 0))
    if not len(owner):
        return none
    per = np.maximum(lens - LENGTH + 1, 0)
    s = np.arange(len(owner)) + np.repeat((ends - lens) - (np.cumsum(per) - per), per)
    a = at[s].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.concatenate((new, [len(s)])))
    return owner[new], s[new], count, a[new], h[a[new]]


def content_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BLOCK:
            yield at, i
            at, held = i, 0
        held += n
    if held or at < len(sizes):
        yield at, len(sizes)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _chunk(doc: np.ndarray, n: int) -> np.ndarray:
    """Of :func:`_chunk_column`: ids are mixed with products that stay within 63 bits."""
    x = (doc & 0xFFFFFFF) ^ ((doc >> 28) & 0xFFFFFFF)
    return ((x * 0x5F356495 & 0x7FFFFFFFFFFFFFFF) >> 13) % n


def _chunk_column(name: str, n: int) -> Column:
    c, low = F.col(name), F.lit(0xFFFFFFF).cast("long")
    x = c.bitwiseAND(low).bitwiseXOR(F.shiftright(c, 28).bitwiseAND(low))
    return F.shiftright(x * F.lit(0x5F356495).cast("long"), 13) % F.lit(n)


_ROW = "kind int, at long, doc binary, content binary, a binary, b binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], _NAMES)


def _dealt(kind: int, at: np.ndarray, *cols: np.ndarray) -> list[tuple]:
    """A row for each value of ``at`` with the parts of ``cols`` that belong there."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else []
    ends = [*cut[1:], len(at)] if len(at) else []
    cols = [c[order] for c in cols]
    return [(kind, int(at[i]), *[c[i:j].tobytes() for c in cols], *[b""] * (4 - len(cols))) for i, j in zip(cut, ends)]


def _ints(rows: list, col: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(r[col] for r in rows), kind)


# step 1


def _grams(buckets: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in _blocks([len(t) for t in texts]):
                own, _, _, _, h = stretches(texts[lo:hi])
                if not len(h):
                    continue
                doc, key = ids[lo:hi], np.array([content_key(t) for t in texts[lo:hi]], np.int64)
                h = _bucket(h, buckets).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
                order = np.lexsort((doc[own], key[own], h))
                own, h = own[order], h[order]
                # of copies of a text only the smallest doc_id can matter here
                first = np.concatenate(([True], (h[1:] != h[:-1]) | (key[own[1:]] != key[own[:-1]])))
                own, h = own[first], h[first]
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                size = np.diff(np.concatenate((start, [len(h)])))
                nth = np.arange(len(h)) - np.repeat(start, size)
                shared = np.repeat(size > 1, size)
                # two texts of the block show the others that the hash is shared; all of them are candidates at once
                sent = nth < 2
                d, k = doc[own], key[own]
                yield _batch(_dealt(0, (h[sent] >> np.uint64(32)).astype(np.int64), d[sent], k[sent], h[sent]) + _dealt(1, _chunk(d[shared], chunks), d[shared], k[shared], h[shared]))

    return run


def _shared(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in bucket_runs(batches, 1):
            if passed := [r for r in bucket if r[0]]:
                yield _batch(passed)
            rows = [r for r in bucket if not r[0]]
            if not rows:
                continue
            d, k, h = _ints(rows, 2), _ints(rows, 3), _ints(rows, 4, np.uint64)
            order = np.argsort(h, kind="stable")
            d, k, h = d[order], k[order], h[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.concatenate((start, [len(h)])))
            many = np.repeat(np.minimum.reduceat(k, start) != np.maximum.reduceat(k, start), size)
            yield _batch(_dealt(1, _chunk(d[many], chunks), d[many], k[many], h[many]))

    return run


# step 2


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, set, list]]:
    """For each chunk documents (doc_id, text), ids of copies, and other rows."""
    for chunk in bucket_runs(batches, 0):
        docs = [(r[2], r[3]) for r in chunk if r[1] == 3]
        copies = {(r[2], r[3]) for r in chunk if r[1] == 2}
        yield docs, copies, [r[1:] for r in chunk if r[1] < 2]


def _windows(buckets: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, copies, rows in _gathered(batches):
            yield _stretch_rows(docs, copies, rows, buckets, chunks)

    return run


def _stretch_rows(docs: list, copies: set, rows: list, buckets: int, chunks: int) -> pa.RecordBatch:
    d, k, h = _ints(rows, 3), _ints(rows, 4), _ints(rows, 5, np.uint64)
    order = np.lexsort((h, k, d))
    d, k, h = d[order], k[order], h[order]
    start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))) if len(d) else np.empty(0, np.int64)
    ends = [*start[1:], len(d)]
    cand = {(int(d[i]), int(k[i])): (i, j) for i, j in zip(start, ends)}
    work = []
    for doc_id, text in docs:
        if len(text) >= LENGTH and (span := cand.get((doc_id, key := content_key(text)))) and (doc_id, hashlib.sha256(text).digest()) not in copies:
            work.append((doc_id, key, text, h[span[0] : span[1]]))
    seen: dict[tuple[int, bytes], tuple] = {}
    covered: list[tuple[int, int, int, int]] = []
    for lo, hi in _blocks([len(w[2]) for w in work]):
        some = work[lo:hi]
        own, s, n, _, g = stretches([w[2] for w in some])
        g = _bucket(g, buckets).astype(np.uint64) << np.uint64(32) | (g & np.uint64(0xFFFFFFFF))
        # candidates of the block by (document, hash)
        sizes = [len(w[3]) for w in some]
        mine = np.unique(_pair(np.repeat(np.arange(len(some)), sizes), np.concatenate([w[3] for w in some])))
        ok = np.isin(_pair(own, g), mine)
        buf = b"".join(w[2] for w in some)
        begin = np.cumsum([0, *(len(w[2]) for w in some)])
        for o, x, c, y in zip(own[ok].tolist(), s[ok].tolist(), n[ok].tolist(), g[ok].tolist()):
            doc_id, key = some[o][0], some[o][1]
            _merge(seen, (y, buf[x : x + c + LENGTH - 1]), doc_id, key, x - int(begin[o]), covered)
    by: dict[int, list] = {}
    for (y, part), (doc_id, places) in seen.items():
        by.setdefault(y >> 32, []).extend((doc_id, key, at, len(part), y, part) for key, at in dict.fromkeys(places))
    out, pack = [], zstandard.ZstdCompressor(3)
    for bucket, found in by.items():
        meta = np.array([(at, n, y) for _, _, at, n, y, _ in found], np.uint64)
        out.append((0, bucket, np.array([r[0] for r in found], np.int64).tobytes(), np.array([r[1] for r in found], np.int64).tobytes(), meta.tobytes(), pack.compress(b"".join(r[5] for r in found))))
    return _batch(out + _covered(covered, chunks))


def _merge(seen: dict, part: tuple[int, bytes], doc_id: int, key: int, at: int, covered: list) -> None:
    """Keep the places of the smallest doc_id that has a stretch; the others lose it."""
    end = len(part[1])
    if (best := seen.get(part)) is None:
        seen[part] = (doc_id, [(key, at)])
    elif best[0] < doc_id:
        covered.append((doc_id, key, at, at + end))
    elif best[0] > doc_id:
        covered.extend((best[0], k, x, x + end) for k, x in best[1])
        seen[part] = (doc_id, [(key, at)])
    else:
        best[1].append((key, at))


def _pair(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A value of 64 bits for (document of the block, hash); a chance equality only makes one more candidate."""
    return (h * np.uint64(0x9E3779B97F4A7C15)) ^ (a.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def _covered(spans: list[tuple[int, int, int, int]], chunks: int) -> list[tuple]:
    if not spans:
        return []
    x = np.array(spans, np.int64)
    return _dealt(1, _chunk(x[:, 0], chunks), x[:, 0], x[:, 1], x[:, 2], x[:, 3])


#: Suffixes of an initial batch of buckets; what one batch has refined the next one uses.
BATCH = 1 << 16


def suffix_order(buf: np.ndarray, grams: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Pointers that order the suffixes of ``buf`` by their first ``depth`` bytes at least, by bucket-pointer refinement.

    A suffix's pointer is the place of its bucket's end in the order. Suffixes
    with one pointer share the known depth of their bucket; a bucket of depth d
    is split by the pointers of what follows d bytes on.
    """
    n = len(buf)
    order = np.argsort(grams, kind="stable")
    last = np.append(grams[order][1:] != grams[order][:-1], True)
    ends = np.flatnonzero(last)
    # behind the text all is alike, and nothing is left to tell apart
    pointer = np.full(n + depth, -1, np.int64)
    pointer[order] = ends[np.searchsorted(ends, np.arange(n))]
    known = np.full(n + 1, 8, np.int64)  # by pointer
    known[-1] = depth
    size = np.diff(np.append(-1, ends))
    live = order[np.repeat(size > 1, size)]
    todo = []
    while len(live):  # whole buckets, up to about BATCH suffixes
        cut = min(BATCH, len(live))
        cut = int(np.searchsorted(pointer[live], pointer[live[cut - 1]], "right"))
        todo.append((8, live[:cut]))
        live = live[cut:]
    todo.reverse()
    while todo:
        offset, some = todo.pop()
        own, by = pointer[some], pointer[some + offset]
        sort = np.lexsort((by, own))
        some, own, by = some[sort], own[sort], by[sort]
        new = np.append(True, (own[1:] != own[:-1]) | (by[1:] != by[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(some)))
        # parts lie one after another before the end of the bucket that they come from
        bucket_end = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        to_end = np.repeat(bucket_end, np.diff(np.append(-1, bucket_end))) - np.arange(len(some))
        part_end = at + size - 1
        ptr = own[part_end] - to_end[part_end]
        deeper = offset + known[by[at]]
        pointer[some] = np.repeat(ptr, size)
        known[ptr] = deeper
        more = (size > 1) & (deeper < depth)
        for d in np.unique(deeper[more]).tolist():
            todo.append((d, some[np.repeat(more & (deeper == d), size)]))
    return pointer[:n]


def window_classes(buf: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A label for the ``LENGTH`` bytes from each place of ``buf``, equal where they are equal; -1 for those that are alone or leave their stretch."""
    left = np.repeat(start + lens, lens) - np.arange(len(buf))
    padded = np.concatenate((buf, np.zeros(LENGTH + 8, np.uint8))).astype(np.uint64)
    grams = np.zeros(len(buf) + LENGTH, np.uint64)
    for i in range(8):
        grams = grams << np.uint64(8) | padded[i : i + len(grams)]
    pointer = suffix_order(buf, grams[: len(buf)])
    win = np.flatnonzero(left >= LENGTH)
    out = np.full(len(buf), -1, np.int64)
    if not len(win):
        return out
    win = win[np.argsort(pointer[win], kind="stable")]
    same = np.ones(len(win) - 1, bool)
    for off in (0, 8, 16, 24, 32, 40, LENGTH - 8):  # the common prefix of neighbours, eight bytes at a time
        same &= grams[win[1:] + off] == grams[win[:-1] + off]
    label = np.cumsum(np.append(True, ~same)) - 1
    shared = np.append(same, False) | np.append(False, same)
    out[win[shared]] = label[shared]
    return out


def _matches(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        seen: dict[tuple[int, bytes], tuple] = {}
        covered: list[tuple[int, int, int, int]] = []
        bucket = None

        def finished() -> pa.RecordBatch:
            nonlocal seen, covered
            # a 20-gram can give matches only with two different stretches of two documents
            by: dict[int, list] = {}
            for (y, part), (doc_id, places) in seen.items():
                by.setdefault(y, []).append((part, doc_id, places))
            rows, held = [], 0
            for group in by.values():
                if len(group) > 1 and any(g[1] != group[0][1] for g in group):
                    if held > RUN_BYTES:
                        covered += _overlaps(rows)
                        rows, held = [], 0
                    rows += group
                    held += sum(len(g[0]) for g in group)
            if rows:
                covered += _overlaps(rows)
            out, seen, covered = _batch(_covered(covered, chunks)), {}, []
            return out

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[1] != bucket:
                    if seen or covered:
                        yield finished()
                    bucket = r[1]
                if r[0]:
                    yield _batch([r])
                    continue
                at, data = 0, unpack.decompress(r[5])
                for doc_id, key, (place, n, y) in zip(np.frombuffer(r[2], np.int64).tolist(), np.frombuffer(r[3], np.int64).tolist(), np.frombuffer(r[4], np.uint64).reshape(-1, 3).tolist()):
                    _merge(seen, (y, data[at : at + n]), doc_id, key, place, covered)
                    at += n
        if seen or covered:
            yield finished()

    return run


#: Bytes of stretches that are sorted together; those of one 20-gram always are.
RUN_BYTES = 4 << 20


def _overlaps(some: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Covered places (doc_id, key, from, to) of distinct stretches (text, doc_id, places)."""
    buf = np.frombuffer(b"".join(p for p, *_ in some), np.uint8)
    lens = np.fromiter((len(p) for p, *_ in some), np.int64, len(some))
    start = np.cumsum(lens) - lens
    label = window_classes(buf, start, lens)
    at = np.flatnonzero(label >= 0)
    if not len(at):
        return []
    own = np.repeat(np.arange(len(some)), lens)[at]
    doc = np.array([d for _, d, _ in some], np.int64)[own]
    label = label[at]
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, doc)
    hit = least[label] < doc
    at, own = at[hit], own[hit]
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return [(some[o][1], k, x + a, x + b + LENGTH) for o, a, b in zip(own[new].tolist(), (at[new] - start[own[new]]).tolist(), (at[last] - start[own[new]]).tolist()) for k, x in some[o][2]]


# step 3


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, copies, rows in _gathered(batches):
        d, k, a, z = (_ints(rows, i) for i in (3, 4, 5, 6))
        order = np.lexsort((a, k, d))
        d, k, a, z = d[order], k[order], a[order], z[order]
        start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))) if len(d) else []
        spans = {(int(d[i]), int(k[i])): (i, j) for i, j in zip(start, [*start[1:], len(d)])}
        for at in range(0, len(docs), 2000):
            out = []
            for doc_id, text in docs[at : at + 2000]:
                removed: list[list[int]] = []
                if len(text) >= LENGTH and (doc_id, hashlib.sha256(text).digest()) in copies:
                    removed = [[0, len(text)]]
                elif span := spans.get((doc_id, content_key(text))) if len(text) >= LENGTH and spans else None:
                    for x, y in zip(a[span[0] : span[1]].tolist(), z[span[0] : span[1]].tolist()):
                        if removed and x <= removed[-1][1]:
                            removed[-1][1] = max(removed[-1][1], y)
                        else:
                            removed.append([x, y])
                kept, last = [], 0
                for x, y in removed:
                    kept.append(text[last:x])
                    last = y
                kept.append(text[last:])
                rest = b"".join(kept)
                out.append((doc_id, len(text), len(text) - len(rest), len(removed), hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in _OUT.split(", ")])


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay."""
    kept_columns(docs, ("doc_id", "text"))
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    texts = every.where("doc_id is not null")
    size = text_bytes(docs)
    buckets, chunks = parts(spark, 0.6 * size), parts(spark, size, 12 << 20)
    # whole copies: the smallest doc_id of a text stands for it
    shas = written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")))
    heads = written(shas.groupBy("sha").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")))
    several = heads.where("head < most").select("sha", "head")
    copies = written(salted(shas, several, ["sha"], counts=heads.select("sha", "n")).where("doc_id > head").select("doc_id", "sha").distinct())
    dropped(shas, heads)
    candidates = written(dealt(texts.mapInArrow(_grams(buckets, chunks), _ROW), buckets).mapInArrow(_shared(chunks), _ROW))
    chunk = _chunk_column("doc_id", chunks)

    def gathered(rows: DataFrame) -> DataFrame:
        """Texts, copies and rows of each chunk together."""
        no_id, none = F.lit(None).cast("long"), F.lit(None).cast("binary")
        return dealt(
            texts.select(chunk.alias("at"), F.lit(3).alias("kind"), "doc_id", F.col("text").alias("data"), none.alias("doc"), none.alias("content"), none.alias("a"), none.alias("b"))
            .union(copies.select(chunk, F.lit(2), "doc_id", "sha", none, none, none, none))
            .union(rows.select("at", "kind", no_id, none, "doc", "content", "a", "b")),
            chunks,
        )

    spans = written(dealt(gathered(candidates).mapInArrow(_windows(buckets, chunks), _ROW), buckets).mapInArrow(_matches(chunks), _ROW))
    dropped(candidates)
    whole = every.where("doc_id is null").select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2("text", 256), F.col("text").alias("kept"))
    return gathered(spans).mapInArrow(_cut, _OUT).union(whole)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
