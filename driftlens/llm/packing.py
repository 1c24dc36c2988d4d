"""Best-fit packing (op 3): hierarchical residual packing.

Texts are tokenised where they lie; only pieces longer than a sequence are cut.
Full pieces leave at once. The others are packed best-fit, largest first, in
each partition; nearly full bins leave, and underfull bins go as items to fewer
partitions for the next round, down to one. A bin carries its pieces' ids and
lengths, never tokens.

Edge cases: a null or empty text is one piece holding the end id alone; repeated
doc_ids are packed as separate documents; ties in size are resolved by arrival;
an empty input gives no sequences; extra columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, returned, table, written

LENGTH, END_ID = 2048, 0
#: A bin with so few free places or fewer leaves at once; the last round emits everything.
SLACK = 4
#: Items of one task of the first round, and pieces of a task of a later one.
TASK_BINS = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: how the tokenizer cuts text before it merges bytes.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin letters in this range are composed and have lower cases of one character, but for this one.
_SIMPLE, _DOTTED = "\u0250", "\u0130"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others follow at 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class WordTokens:
    """Token ids of white-space separated words, as little-endian bytes; forgotten when ``most`` are held.

    The tokenizer splits at white space before anything else and drops it, so a
    text's ids are those of its words in turn. Words of simple letters are
    lower-cased and cut here, and their parts go straight to the tokenizer's
    model; all other words go through the tokenizer.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.whole, self.most, self.known, self.parts = Tokenizer.from_file(path), most, {}, {}
        self.model, self.letters = self.whole.model, _byte_letters()

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()])
        out = self.parts[part] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return out

    def _word(self, word: bytes) -> bytes:
        w = word.decode("utf-8")
        if "<|" in w or not w.isascii() and (max(w) >= _SIMPLE or _DOTTED in w):
            return array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()
        w, parts = w.lower(), self.parts
        if w.isalpha():
            return parts.get(w) or self._part(w)
        return b"".join([parts.get(p) or self._part(p) for p in _CUT.findall(w)])

    def ids(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._word(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > self.most:
            known.clear()
        if len(self.parts) > self.most:
            self.parts.clear()
        return out


_TOKENS: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """One per Python worker, kept between its tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut only where longer than ``length``."""
    kept_columns(docs, ("doc_id", "text"))
    end = int(end_id).to_bytes(4, "little")

    @returned
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(tokenizer)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = t.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Bins of indexes into ``sizes``: largest item first, each into the fullest bin that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0  # bit f is set if a bin with f free places is open
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if found := mask >> size:
            free = size + (found & -found).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[k].append(i)
        else:
            free, k = length, len(bins)
            bins.append([i])
        if left := free - size:
            by_free[left].append(k)
            mask |= 1 << left
    return bins


_BIN = "size long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>, done boolean"


def _packer(length: int, nearly: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = [f for f in frames if len(f)]
        if not all_rows:
            return
        rows = pd.concat(all_rows, ignore_index=True)
        sizes, members = rows["size"].to_numpy(np.int64), rows["members"].tolist()
        bins = best_fit(sizes, length)
        for at in range(0, len(bins), 5000):
            some = bins[at : at + 5000]
            held = [int(sizes[b].sum()) for b in some]
            yield pd.DataFrame({"size": held, "members": [[m for i in b for m in members[i]] for b in some], "done": [h >= nearly for h in held]})

    return run


def packed(items: DataFrame, length: int = LENGTH, slack: int = SLACK, task_bins: int = TASK_BINS, most: int = TASK_BINS, tasks: int | None = None) -> DataFrame:
    """Bins (size, members, done) of ``items`` (the columns of :func:`pieces`).

    A round packs what is open in ``n`` tasks, a quarter as many the next time,
    down to one. The pieces of underfull bins go on by themselves while a task
    of the next round gets no more than ``most`` of them. Otherwise, as with
    pieces that hardly ever fit together, the bins go on whole: of a task's bins
    at most one is half empty or more, as best-fit would have joined two, so few
    small bins are open after a round. The larger ones can't be joined with each
    other; each that is joined takes in a small one at least, so as many of the
    emptiest as there are small ones go on with those, and the others are final.
    """
    spark = items.sparkSession
    struct = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    items = items.select(F.col("length").alias("size"), F.array(struct).alias("members"), (F.col("length") >= length).alias("done"))
    out, rest = [items.where("done")], items.where("not done")
    n = tasks or max(1, -(-rest.count() // task_bins))
    while True:
        # rows are dealt in turn, so that each partition has its share of sizes and of any one document
        bins = written((rest.repartition(n) if n > 1 else rest.coalesce(1)).mapInPandas(_packer(length, max(1, length - slack)), _BIN))
        out.append(bins.where("done"))
        open_bins = bins.where("not done")
        if n == 1:
            out.append(open_bins)
            return _union(out)
        n = max(1, n // 4)
        if (open_bins.agg(F.sum(F.size("members"))).first()[0] or 0) <= most * n:
            rest = open_bins.select(F.explode("members").alias("m")).select(F.col("m.length").alias("size"), F.array("m").alias("members"), F.lit(False).alias("done"))
        else:
            rest, final = going_on(open_bins, length)
            out.append(final)
        rest = written(rest)


def going_on(bins: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The small bins and as many of the emptiest others, and the rest."""
    sizes = {r["size"]: r["count"] for r in bins.groupBy("size").count().collect()}  # a row for each size at most
    wanted = sum(k for s, k in sizes.items() if 2 * s <= length)
    cut, left = length, wanted
    for s in sorted(s for s in sizes if 2 * s > length):
        if sizes[s] > left:
            cut = s
            break
        left -= sizes[s]
    # of the bins of the size at which the count is reached, which are alike, any will do
    edge = written(bins.where(F.col("size") == cut).withColumn("__nth", F.monotonically_increasing_id()))
    some = edge.select("__nth").orderBy("__nth").limit(left).withColumnRenamed("__nth", "__taken")
    some = written(some)
    both = F.col("__nth") == F.col("__taken")
    going = bins.where(F.col("size") < cut).unionByName(edge.join(some, both, "left_semi").drop("__nth"))
    return going, bins.where(F.col("size") > cut).unionByName(edge.join(some, both, "left_anti").drop("__nth"))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = written(pieces(docs, tokenizer, length, end_id))
    bins = packed(items, length)
    # a bin's first piece names it: pieces of a document have their own (doc_id, piece)
    bins = written(bins.select("members").withColumn("sequence_id", F.monotonically_increasing_id()))
    return bins.select(
        "sequence_id",
        F.explode(
            F.expr(
                "transform(members, (m, i) -> named_struct('m', m, 'offset', "
                "aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))"
            )
        ).alias("p"),
    ).select("p.m.doc_id", "p.m.piece", "p.m.start", "p.m.length", "p.m.ids_crc32", "sequence_id", "p.offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"), default_tokenizer())
