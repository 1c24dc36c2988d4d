"""Cross-tokenizer alignment (op 13): where the tokens of two tokenizers end together.

A text's tokens of A (byte-level BPE) and of B (pieces with byte fallback) cover
the same bytes, a space and the text. Two pointers run over the cumulative ends
of both, in ``mapInPandas``: an end that both have closes a group, and links the
two tokens that end there. Spark counts linked pairs over the corpus, and joins
the counts and the highest count of each B token back to the documents.

Neither tokenizer joins bytes over a single space between two characters that
aren't white space: A's pattern starts a part there, and no piece of B has a
space after another character (held true of the file when it is loaded; else
whole texts are encoded). So a text is cut there, and units that a worker has
met before are not encoded and merged again. New units are encoded as one text,
and their ends are merged in one run, the two pointers being those of a merge
sort of two sorted lists; that each unit ends where tokens of both do is checked.

The most frequent pairs, at most 65,536, are broadcast for the join back; all
others, none of which has a larger share of the links than one in 65,536, go
through a shuffle. Maxima have a row for each id of B.

Edge cases: null and empty texts, and texts that B does not give back (those
with its space sign), have no tokens: zeros and an empty digest; repeated rows
are documents of their own; a null doc_id stays null; ties for a B token's
highest count all count as best; an empty table gives no rows; extra columns are
not read. A text without single spaces is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, kept_columns, table, written

#: Fixed value: how A cuts text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The sign for a space in pieces of B, and a piece that stands for a byte.
SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: Units that a worker remembers, and pairs that are broadcast.
MOST_UNITS, HOT_PAIRS = 150_000, 1 << 16
_ROW = "doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others follow at 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """A tokenizer's ids for texts that begin with a space, each id's bytes and their number, and the id's decimal digits before each separator."""

    def __init__(self, of_id: dict[int, bytes]):
        n = max(of_id) + 1
        self.bytes = of_id
        self.size = np.zeros(n, np.int64)
        self.size[list(of_id)] = [*map(len, of_id.values())]
        self.shown = {sep: np.array([f"{i}{sep}" for i in range(n)], object) for sep in ",|;\n"}

    def encode(self, text: str) -> list[int]:
        raise NotImplementedError

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteTokens(Tokens):
    """A: tokens of ordinary text, special tokens' strings included."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = _byte_of_letter()
        # an entry's id is its rank, as entries are numbered in the order of their merges
        ranks = {bytes([of[c] for c in entry]): i for entry, i in vocab.items()}
        super().__init__(dict(zip(ranks.values(), ranks)))
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class PieceTokens(Tokens):
    """B: pieces of text, which it begins with a space itself. ``cuts``: no piece has a space after another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__({i: bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)})
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both of the ends that both have: the two sorted lists are merged, and equal ends are neighbours then."""
    both = np.concatenate((ends_a, ends_b))
    order = np.argsort(both, kind="stable")  # two sorted runs are merged, not sorted again
    twice = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return order[twice], order[twice + 1] - len(ends_a)


class Units:
    """The tokens, groups and links of units of text, computed when a task first meets them; forgotten when ``most`` are held."""

    def __init__(self, a: ByteTokens, b: PieceTokens, most: int = MOST_UNITS):
        self.a, self.b, self.most = a, b, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        # of each unit its numbers of tokens of A and B, and of groups, which is -1 where B does not give it back; where its pairs begin
        self.n, self.starts, self.pairs = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _add(self, units: list[str], ids_a: list[int], ids_b: list[int], ends: np.ndarray) -> bool:
        """Learn units whose tokens follow one another; ``ends`` are theirs in bytes. False if one ends within a token."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        i, j = merged(ends_a, ends_b)
        common = ends_a[i]
        last = np.searchsorted(common, ends)  # of each unit, its last group
        if (last >= len(common)).any() or (common[last] != ends).any():
            return False
        # a group's tokens of A, then its tokens of B: each token's place is its number and that of the other side's tokens before it
        of_a, of_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        shown = np.empty(len(a) + len(b), object)
        text_a = self.a.shown[","][a]
        text_a[i] = self.a.shown["|"][a[i]]
        text_b = self.b.shown[","][b]
        text_b[j] = self.b.shown[";"][b[j]]
        text_b[j[last]] = self.b.shown["\n"][b[j[last]]]
        shown[np.arange(len(a)) + np.append(-1, j)[of_a] + 1] = text_a
        shown[np.arange(len(b)) + i[of_b] + 1] = text_b
        self.known.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += "".join(shown.tolist()).split("\n")[:-1]
        n = np.diff(np.stack((i[last], j[last], last)), prepend=-1).T
        self.n = np.concatenate((self.n, n))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(n[:, 2])))
        self.pairs = np.concatenate((self.pairs, a[i] << 32 | b[j]))
        return True

    def _alone(self, unit: str) -> None:
        a, b, whole = self.a.encode(unit), self.b.encode(unit), b" " + unit.encode()
        if self.a.joined(a) == whole == self.b.joined(b):
            self._add([unit], a, b, np.array([len(whole)]))
            return
        self.known[unit] = len(self.groups)
        self.groups.append("")
        self.n = np.concatenate((self.n, [[0, 0, -1]]))
        self.starts = np.append(self.starts, self.starts[-1])

    def _learn(self, units: list[str]) -> None:
        usual = [u for u in units if not u[:1].isspace() and not u[-1:].isspace() and u and SPACE not in u] if self.b.cuts else []
        if usual:
            text = " ".join(usual)
            a, b, whole = self.a.encode(text), self.b.encode(text), b" " + text.encode()
            ends = np.cumsum([len(u.encode()) + 1 for u in usual])
            if not (self.a.joined(a) == whole == self.b.joined(b) and self._add(usual, a, b, ends)):
                usual = []
        for u in set(units).difference(usual) if usual else units:
            self._alone(u)

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, digest, distinct pairs, how often each) of each text."""
        nothing = (0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        cut = [[] if not t else _CUT.split(t) if self.b.cuts and SPACE not in t else [t] for t in texts]
        if len(self.known) > self.most:
            self._clear()
        if new := list({u for units in cut for u in units}.difference(self.known)):
            self._learn(new)
        for units in cut:
            at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            n = self.n[at]
            if not len(at) or (n[:, 2] < 0).any():
                yield nothing
                continue
            digest = hashlib.sha256()
            for k in range(0, len(at), 100_000):  # long texts in parts
                digest.update(((";" if k else "") + ";".join(map(self.groups.__getitem__, at[k : k + 100_000].tolist()))).encode())
            links = n[:, 2]
            place = np.arange(links.sum()) + np.repeat(self.starts[at] - np.cumsum(links) + links, links)
            pairs, times = np.unique(self.pairs[place], return_counts=True)
            yield *n.sum(0).tolist(), digest.hexdigest(), pairs, times


_UNITS: dict[tuple[str, str], Units] = {}


def _aligned(a_path: str, b_path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (a_path, b_path) not in _UNITS:  # one per Python worker, kept between its tasks
            _UNITS[a_path, b_path] = Units(ByteTokens(a_path), PieceTokens(b_path))
        units = _UNITS[a_path, b_path]
        for f in frames:
            for at in range(0, len(f), 250):
                part = f.iloc[at : at + 250]
                cols = zip(*units.rows(part["text"].tolist()))
                yield pd.DataFrame(dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"), (part["doc_id"].tolist(), *map(list, cols)))))

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: numbers of tokens and groups, the groups' digest, its linked pairs and how often each; written.

    A pair is A's id times 2^32 and B's id. ``row`` numbers the rows.
    """
    kept_columns(docs, ("doc_id", "text"))
    # as text, an id that is null does not turn the others into floats
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_aligned(a_path, b_path), _ROW)
    return written(found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold the pair, and whether no pair of its B id has more; written."""
    n = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    n = written(n.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = n.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B at most
    out = written(n.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    dropped(n)
    return out


def with_counts(found: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of :func:`aligned` with ``n_best`` and ``count_sum``."""
    hot = written(counts.orderBy(F.desc("n"), "pair").limit(hot_pairs))
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    told = lambda df: df.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    frequent = told(each.join(F.broadcast(hot), "pair"))
    others = told(each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(counts, "pair"))
    sums = frequent.unionByName(others).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return found.join(sums, "row", "left").na.fill(0, ["count_sum", "n_best"])


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), *default_tokenizers())
    # each group has one link, at its end
    return with_counts(found, pair_counts(found)).select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
