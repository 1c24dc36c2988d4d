"""Vectors of texts, by an encoder that can be replaced."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

DIM = 64


def hashed_grams(texts: list[str], dim: int = DIM, n: int = 3) -> np.ndarray:
    """Counts of hashed character n-grams of the lower-cased texts, at length 1; texts without any give zeros."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(c) >= n:
            h = np.zeros(len(c) - n + 1, np.int64)
            for k in range(n):
                h = h * 31 + c[k : len(c) - n + 1 + k]
            out[i] = np.bincount(h % dim, minlength=dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embedded(df: DataFrame, text: str, name: str = "v", encode: Callable[[list[str]], np.ndarray] = hashed_grams, batch: int = 512) -> DataFrame:
    """``df`` with the encoder's vector of each text; null texts count as empty.

    The encoder gets ``batch`` texts at a time; a model that it loads should be
    loaded once for each worker, on its first call.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                some = b.slice(lo, batch)
                v = np.asarray(encode([t or "" for t in some.column(at).to_pylist()]), np.float64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(v), pa.list_(pa.float64()))], [*some.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))
