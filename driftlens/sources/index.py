"""An index of vectors that lasts: parts that are only added, and a list of them that is exchanged at once.

A change is a part of its own: rows by id, or ids that are gone. It counts when
the next list of parts names it, so that a crash before that leaves a folder
that nothing reads. Reading merges the parts: of an id the row of the last part
stays, unless that part says that it is gone. Compaction writes what is read as
one part. Parts are split by a hash of the id, so that looking ids up opens
their buckets only.

Edge cases: of several rows for one id in a change the last by ``order`` stays,
of equal ones the largest row; ids that are null are refused; deleting unknown
ids changes nothing that is read; of two writers at once one fails and can
repeat its change; an index without parts has no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from .io import exists

_GONE, _BUCKET, _PART = "__gone", "__bucket", "__part"


class VectorIndex:
    """Rows by ``key`` in a folder that all executors share; ``schema`` is that of the rows."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the list of parts

    def _versions(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/lists"):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._fs_path(f"{self.path}/lists")) if f.getPath().getName().isdigit())

    def _list(self, version: int) -> dict | None:
        """What a version lists; None if its writer did not finish."""
        stream = self._fs.open(self._fs_path(f"{self.path}/lists/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def current(self) -> dict:
        """The last finished list: ``version``, ``buckets`` and ``parts`` in order."""
        for v in reversed(self._versions()):
            if found := self._list(v):
                return found | {"version": v}
        return {"version": 0, "buckets": self.buckets, "parts": []}

    def _commit(self, seen: dict, parts: list[str]) -> None:
        """The next list; fails where another writer has written one since ``seen`` was read."""
        if [v for v in self._versions() if v > seen["version"] and self._list(v)]:
            raise RuntimeError("the index has changed since it was read; repeat the change")
        version = max([0, *self._versions()]) + 1
        out = self._fs.create(self._fs_path(f"{self.path}/lists/{version:012d}"), False)
        try:
            out.write(bytearray(json.dumps({"buckets": seen["buckets"], "parts": parts}).encode()))
        finally:
            out.close()

    # parts

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, seen: dict) -> str:
        name = f"part-{uuid.uuid4().hex}"
        n = seen["buckets"]
        # a bucket's rows are written by the tasks that have some; few rows make few files
        rows.withColumn(_BUCKET, self._bucket(n)).repartition(_BUCKET).write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.path}/parts/{name}")
        return name

    def _read(self, name: str, gone: bool | None = None) -> DataFrame:
        fields = [*self.schema.fields, StructField(_GONE, BooleanType()), StructField(_BUCKET, IntegerType())]
        return self.spark.read.schema(StructType(fields)).parquet(f"{self.path}/parts/{name}")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Rows in the place of those with the same ids; of several for one id the last by ``order``."""
        seen = self.current()
        rows = rows.select(*self.schema.names, *([order] if order and order not in self.schema.names else []))
        checked = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("an id is null")).cast(dict(rows.dtypes)[self.key])).otherwise(F.col(self.key))
        rest = [c for c in self.schema.names if c != self.key]
        last = rows.withColumn(self.key, checked).groupBy(self.key).agg(F.max(F.struct(*([order] if order else []), F.struct(*rest).alias("__row"))).getField("__row").alias("__r"))
        own = last.select(*[F.col(self.key) if c == self.key else F.col(f"__r.{c}") for c in self.schema.names], F.lit(False).alias(_GONE))
        self._commit(seen, [*seen["parts"], self._write(own, seen)])

    def delete(self, ids: DataFrame) -> None:
        """Rows with these ids are gone."""
        seen = self.current()
        kinds = {f.name: f.dataType for f in self.schema}
        gone = ids.select(F.col(self.key).cast(kinds[self.key])).where(F.col(self.key).isNotNull()).distinct()
        rows = gone.select(*[F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.schema.names], F.lit(True).alias(_GONE))
        self._commit(seen, [*seen["parts"], self._write(rows, seen)])

    def delete_where(self, condition: Column | str) -> None:
        self.delete(self.read().where(condition).select(self.key))

    def reset(self) -> None:
        """No rows; the parts stay until :meth:`clean`."""
        self._commit(self.current(), [])

    def read(self, seen: dict | None = None) -> DataFrame:
        """All rows. Only ids of later parts take part in the join that hides earlier rows, so the first part, which holds most, is not sorted out by a window."""
        parts = (seen or self.current())["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        first, later = self._read(parts[0]), None
        for i, p in enumerate(parts[1:]):
            part = self._read(p).withColumn(_PART, F.lit(i))
            later = part if later is None else later.unionByName(part)
        out = first.where(~F.col(_GONE))
        if later is not None:
            rest = [c for c in self.schema.names if c != self.key]
            last = later.groupBy(self.key).agg(F.max_by(F.struct(_GONE, *rest), _PART).alias("__r"))
            changed = last.where(f"not __r.{_GONE}").select(*[F.col(self.key) if c == self.key else F.col(f"__r.{c}") for c in self.schema.names])
            out = out.join(later.select(self.key).distinct(), self.key, "left_anti").select(*self.schema.names).unionByName(changed)
        return out.select(*self.schema.names)

    def lookup(self, ids: list) -> DataFrame:
        """The rows of a few ids; only their buckets are opened."""
        seen = self.current()
        kind = next(f.dataType for f in self.schema if f.name == self.key)
        asked = self.spark.createDataFrame([(i,) for i in ids], StructType([StructField(self.key, kind)]))
        buckets = sorted({r[0] for r in asked.select(self._bucket(seen["buckets"])).collect()})
        rows = None
        for i, p in enumerate(seen["parts"]):
            part = self._read(p).where(F.col(_BUCKET).isin(buckets) & F.col(self.key).isin(ids)).withColumn(_PART, F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        rest = [c for c in self.schema.names if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(_GONE, *rest), _PART).alias("__r")).where(f"not __r.{_GONE}")
        return last.select(*[F.col(self.key) if c == self.key else F.col(f"__r.{c}") for c in self.schema.names])

    def count(self) -> int:
        return self.read().count()

    def compact(self) -> None:
        """One part with what is read now."""
        seen = self.current()
        if len(seen["parts"]) > 1:
            self._commit(seen, [self._write(self.read(seen).withColumn(_GONE, F.lit(False)), seen)])

    def clean(self) -> int:
        """Remove parts that the current list does not name, which readers of earlier lists may still need; returns how many."""
        used, n = set(self.current()["parts"]), 0
        folder = f"{self.path}/parts"
        for f in self._fs.listStatus(self._fs_path(folder)) if exists(self.spark, folder) else []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)
                n += 1
        return n
