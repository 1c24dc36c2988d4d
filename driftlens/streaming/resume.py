"""Appending results as their inputs arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.io import exists


def append_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each input once, also after a stop: the checkpoint holds what was read, the sink what was written."""
    out = transform(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (out.trigger(availableNow=True) if once else out).start()


def write_once(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of a batch whose ids no other batch has written, into a folder of the batch's own.

    A batch that is repeated, as after a crash, replaces its folder and adds
    nothing; an id that repeats, within a batch or in a later one, is written
    once, as its first row by ``order`` (of equal ones the smallest row). Rows
    without id are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, F.struct(*rest).alias("row"))).getField("row").alias("__r"))
        new = first.select(*[F.col(key) if c == key else F.col(f"__r.{c}") for c in batch.columns])
        if exists(spark, path):
            others = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(path).where(F.col("batch") != number)
            new = new.join(others.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def append_once(source: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """What ``source`` has by now, each id once, whatever is sent or run twice."""
    return source.writeStream.foreachBatch(write_once(path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
