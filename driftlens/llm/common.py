"""What the training-data operators share: inputs, scratch tables and blob exchanges."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows that a Python worker gets at once.
BATCH_ROWS = "2000"
#: Bytes a reducer of a blob exchange should hold, before numpy's working copies.
BUCKET_BYTES = 10 << 20


def prepared(spark: SparkSession) -> None:
    """Ship the package; rows of texts are large, so that few of them should go to a Python worker at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; where it is unset, only a local master gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Scratch folders by application, for :func:`clean_scratch`.
_SCRATCH: dict[str, list[str]] = {}
#: For a write that cuts lineage: its shuffle files go with its end; what Python workers get at once stays small where rows are large.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_scratch(spark: SparkSession) -> None:
    """Remove the scratch folders of this application; results that were not written elsewhere can't be read after it."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        removed(spark, path)


def written(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again with its own schema; the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = path or scratch(spark)
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            removed(df.sparkSession, path)
            paths = _SCRATCH.get(df.sparkSession.sparkContext.applicationId, [])
            if path in paths:
                paths.remove(path)


#: A key with more than one row in so many is split, hence at most so many keys are.
SHARE = 1000


def salted(big: DataFrame, small: DataFrame, key: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, however many rows of ``big`` one key has.

    A key of more than a thousandth of big's rows is split into parts of at most
    that share, and its rows of ``small`` are repeated for each part. There are
    fewer than a thousand such keys, so their list can be broadcast. ``counts``
    (the key and ``n``, at most twice what big has) saves the count. ``big`` has to be a written table: the
    salt numbers its rows.
    """
    n = counts if counts is not None else big.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total = big.count()
    hot = n.where(F.col("n") * SHARE > total).na.drop("any").select(*[F.col(k).alias(f"__hot_{k}") for k in key], F.ceil(F.col("n") * SHARE / F.lit(max(total, 1))).cast("int").alias("__parts"))

    def on(df: DataFrame):
        cond = None
        for k in key:
            c = df[k] == hot[f"__hot_{k}"]
            cond = c if cond is None else cond & c
        return cond

    drop = [f"__hot_{k}" for k in key]
    parts = F.coalesce("__parts", F.lit(1))
    left = big.join(F.broadcast(hot), on(big), "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop(*drop, "__parts")
    right = small.join(F.broadcast(hot), on(small), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(*drop, "__parts")
    return left.join(right, [*key, "__salt"], how).drop("__salt")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """At most about the bytes of a text column: three times its files for a file scan, counted where Catalyst has no estimate."""
    stats = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if stats < 1 << 56:
        return 3 * stats
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


#: Partitions of an exchange at most; beyond it a task works through several buckets in turn.
MOST_PARTS = 20_000


def parts(spark: SparkSession, n_bytes: float, each: int = BUCKET_BYTES, least: int | None = None) -> int:
    """Buckets such that each holds about ``each`` bytes; no fewer than the session's shuffle partitions."""
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(n_bytes / each) + 1)


def dealt(df: DataFrame, buckets: int, key: str = "at") -> DataFrame:
    """Rows by bucket number, to at most ``MOST_PARTS`` partitions, in which the rows of a bucket follow one another."""
    return df.repartition(min(buckets, MOST_PARTS), key).sortWithinPartitions(key)


def bucket_runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[list[tuple]]:
    """The rows of each bucket, one bucket at a time; column ``key`` has its number."""
    held, at = [], None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[key] != at and held:
                yield held
                held = []
            at = r[key]
            held.append(r)
    if held:
        yield held


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def kept_columns(df: DataFrame, needed: Iterable[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string")) % n


def sample_by_hash(df: DataFrame, key: str, most: int, count: int) -> DataFrame:
    """About ``most`` of ``count`` rows, chosen by a hash of ``key`` alone, so that reruns choose the same rows."""
    share = min(1.0, most / max(1, count))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def slices(texts: list[str | None], chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    at = held = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if held and held + n > chars:
            yield at, i
            at, held = i, 0
        held += n
    if held:
        yield at, len(texts)


class WordRows:
    """A row of numbers per distinct word, computed when a task first meets it; forgotten when ``most`` are held."""

    def __init__(self, width: int, compute: Callable[[list], np.ndarray], most: int = 500_000):
        self.compute, self.most, self.ids, self.rows = compute, most, {}, np.zeros((1024, width))

    def sums(self, docs: list[list]) -> np.ndarray:
        """For each list of words the sum of their rows."""
        ids = self.ids
        flat = [w for d in docs for w in d]
        if new := list(set(flat).difference(ids)):
            n = len(ids)
            ids.update(zip(new, range(n, n + len(new))))
            if len(ids) > len(self.rows):
                grown = np.zeros((max(len(ids), 2 * len(self.rows)), self.rows.shape[1]))
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : len(ids)] = self.compute(new)
        picked = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        out = np.zeros((len(docs), self.rows.shape[1]))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(self.rows[picked], starts, axis=0)
        if len(ids) > self.most:
            self.ids, self.rows = {}, np.zeros((1024, out.shape[1]))
        return out


#: Bits of a filter that goes to the tasks (4 MB).
FILTER_BITS = 1 << 25


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits a hash, put together in Spark as words of 64 bits; its size is fixed."""
    mask = F.lit(FILTER_BITS - 1).cast("long")
    at = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    x, y = _places(h)
    one = np.uint64(1)
    ok = (bits[x >> 6] >> (x & 63).astype(np.uint64)) & one
    return (ok & (bits[y >> 6] >> (y & 63).astype(np.uint64))).astype(bool)


def returned(fn: Callable) -> Callable:
    """``fn`` over batches, which gives freed memory back to the system at its end: workers live on for other stages."""

    @functools.wraps(fn)
    def run(batches):
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another system's C library
            pass

    return run
