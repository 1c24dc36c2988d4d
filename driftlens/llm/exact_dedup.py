"""Exact dedup (op 6): a persistent digest index, bucketed and sorted by hash.

New rows are reduced to one row per digest, deduplicated against the index by a
sort-merge anti-join that needs no shuffle of the index, and appended to it.

Edge cases: a null text counts as empty; empty texts are equal to each other;
ties on length keep the smallest doc_id; a group whose rows have no doc_id at all
has a null keep_id; ``kept`` marks all rows of a group that have the doc_id and
the length of the one that stays, and :func:`keep_first` returns one of them;
an empty input gives an empty result; other columns are carried by
:func:`keep_first` and never read. Across batches the document that was kept
first stays, whatever comes later, and group sizes count all batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, exists, kept_columns, salted, scratch, table, written

#: The characters that do not count.
SPACE = r"[\x20\x09-\x0D]"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the normalised text's SHA-256 and the original's code points; no text goes further than this."""
    kept_columns(docs, (id_col, text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
    )


class DigestIndex:
    """A bucketed, sorted table at ``path``, kept between runs and only ever appended to.

    A batch adds a head (digest, keep_id, n_chars, group_size) for each digest
    that the index lacks. Of a digest that it has, the document stays that was
    kept first, and the batch adds a row without keep_id that counts its rows;
    :meth:`rows` sums them up. The number of buckets is fixed when the index is
    made and stored beside it; opening it with another number is refused. A
    batch that the index already holds by name is not appended again, so that a
    run can be repeated after a failure.

    The catalogue entry is made anew by each opening and goes with :meth:`close`;
    the files stay.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        spec = f"{self.path}/spec"
        if exists(spark, spec):
            self.buckets = spark.read.schema("buckets int").json(spec).first()["buckets"]
            if buckets is not None and buckets != self.buckets:
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        else:
            self.buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(spec)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n_chars BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def heads(self, batch: str | None = None) -> DataFrame:
        found = self.spark.table(self.name).where("n_chars is not null")
        return (found if batch is None else found.where(F.col("batch") == batch)).select("digest", "keep_id", "n_chars")

    def rows(self) -> DataFrame:
        """One row per digest: the document that stays and how many rows ever had it; the buckets spare a shuffle."""
        head = F.max(F.when(F.col("n_chars").isNotNull(), F.struct("n_chars", "keep_id")))
        g = self.spark.table(self.name).groupBy("digest").agg(head.alias("h"), F.sum("group_size").alias("group_size"))
        return g.select("digest", F.col("h.keep_id").alias("keep_id"), F.col("h.n_chars").alias("n_chars"), "group_size")

    def groups(self, new: DataFrame) -> DataFrame:
        """One row per digest of ``new`` (rows of :func:`digests`); partial aggregation comes before the shuffle."""
        best = F.max(F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("neg_id")))
        g = new.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        return g.select("digest", (-F.col("best.neg_id")).alias("keep_id"), F.col("best.n_chars").alias("n_chars"), "group_size")

    def append(self, new: DataFrame, batch: str | None = None) -> str:
        """Add heads of the digests that the index lacks, and counts of those that it has; returns the batch's name."""
        batch = batch or uuid.uuid4().hex
        if not self.spark.table(self.name).where(F.col("batch") == batch).isEmpty():
            return batch
        groups = written(self.groups(new))
        known = self.heads().select("digest").hint("merge")
        unseen = groups.join(known, "digest", "left_anti")
        again = groups.join(known, "digest", "left_semi").select("digest", F.lit(None).cast("long"), F.lit(None).cast("long"), "group_size")
        rows = unseen.union(again).withColumn("batch", F.lit(batch))
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        dropped(groups)
        return batch

    def decide(self, new: DataFrame) -> DataFrame:
        """Each row of ``new`` (a written table) with the document that stands for its digest; large groups are split."""
        return salted(new, self.rows().withColumnRenamed("n_chars", "kept_chars"), ["digest"])


def index_for(docs: DataFrame, path: str | None = None, batch: str | None = None) -> tuple[DigestIndex, DataFrame, str]:
    """The index at ``path`` (a new one by default) after ``docs`` went in, the digests of ``docs`` and the batch's name."""
    spark = docs.sparkSession
    rows = written(digests(docs))
    index = DigestIndex(spark, path or scratch(spark))
    return index, rows, index.append(rows, batch)


def exact_groups(docs: DataFrame, path: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: its group's size and the document that stays."""
    index, rows, _ = index_for(docs, path, batch)
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("n_chars") == F.col("kept_chars"))
    out = index.decide(rows).select("doc_id", "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    out = written(out)
    index.close()
    dropped(rows)
    return out


def keep_first(docs: DataFrame, path: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text that the index had not seen before.

    What is compared is (doc_id, digest, length); of rows that are equal in all
    three one stays, any of them, and of a text that only rows without doc_id
    have, one stays too.
    """
    index, rows, batch = index_for(docs, path, batch)
    # a document stays where this batch has the row that the index keeps
    heads = index.heads(batch).withColumnRenamed("n_chars", "head_chars")
    mine = rows.groupBy("digest", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("times"))
    same = (F.col("m.digest") == F.col("h.digest")) & F.col("m.doc_id").eqNullSafe(F.col("h.keep_id")) & (F.col("m.n_chars") == F.col("h.head_chars"))
    keep = written(mine.alias("m").join(heads.alias("h"), same).select(F.col("m.digest").alias("__digest"), F.col("m.doc_id").alias("__doc_id"), F.col("m.n_chars").alias("__chars"), "times"))
    index.close()
    dropped(rows)
    size, digest = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long"), F.unhex(F.sha2(normalised(), 256))

    def picked(wanted: DataFrame) -> DataFrame:
        marked = docs.withColumns({"__d": digest, "__n": size})
        return marked.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__d") == F.col("__digest")) & (F.col("__n") == F.col("__chars")), "left_semi")

    once = picked(keep.where("times = 1")).drop("__d", "__n")
    if keep.where("times > 1").isEmpty():
        return once
    rest = picked(keep.where("times > 1")).dropDuplicates(["doc_id", "__d"]).drop("__d", "__n")
    return once.unionByName(rest)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept,
  h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
