"""Secret scans (op 8): an incremental ledger of scanned blobs.

A document's text is a version of the path it stands at; versions are addressed
by the SHA-256 of their content. The ledger keeps, for each (blob, rule version)
ever scanned, what was found. A scan takes the blobs of the versions at hand,
leaves out the pairs that the ledger has, scans one copy of each of the rest,
appends to the ledger and joins findings back to all paths of each blob.

Edge cases: a null text is the empty blob; empty texts have no spans and the
digest of the empty string; repeated rows and copies are scanned once and all
get the findings, and so do rows without path_id; spans of one start are in the order of kinds; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, salted, scratch, table, text_of, written

#: Fixed values of the base rules, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "private_key", "bearer")
#: Rules beyond the base ones: their findings are in ``spans`` only.
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----")
BEARER = re.compile(r"\bBearer\x20+[A-Za-z0-9._~+/-]{20,}=*")
RULES_VERSION = 1


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) as (start, end, kind), sorted by start, then kind as listed."""
    base, more = [], []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        more += [(m.start(), m.end(), "private_key") for m in PRIVATE_KEY.finditer(text)]
    if "Bearer" in text:
        more += [(m.start(), m.end(), "bearer") for m in BEARER.finditer(text)]
    by = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=by), sorted(base + more, key=by)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_FOUND = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for blob, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            base, spans = scan(text)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((blob, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], [c.split()[0] for c in _FOUND.split(", ")])


class Ledger:
    """Findings by (blob, rule version) at ``path``, kept between scans."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark)
        self.schema = f"{_FOUND}, rules_version int"
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def scan(self, versions: DataFrame, rules_version: int = RULES_VERSION) -> DataFrame:
        """``versions`` (path_id, text) with the findings of each; new pairs are scanned and recorded first."""
        kept_columns(versions, ("path_id", "text"))
        blob = F.unhex(F.sha2(text_of(), 256)).alias("blob")
        at = written(versions.select("path_id", blob))
        known = self.rows().where(F.col("rules_version") == rules_version).select("blob")
        # ids, not texts, decide which copy is scanned; then only the texts chosen are kept
        copies = written(at.groupBy("blob").agg(F.min("path_id").alias("path_id"), F.count(F.lit(1)).alias("n")))
        one = copies.join(known, "blob", "left_anti").select(F.col("path_id").alias("__path"), F.col("blob").alias("__blob"))
        texts = versions.select("path_id", text_of().alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
        chosen = texts.join(one.hint("shuffle_hash"), F.col("path_id").eqNullSafe(F.col("__path")) & (F.col("blob") == F.col("__blob")))
        found = chosen.select("blob", "text").mapInArrow(_scan_blobs, _FOUND)
        # a path may hold one blob twice
        found.dropDuplicates(["blob"]).withColumn("rules_version", F.lit(rules_version)).write.mode("append").parquet(self.path)
        findings = self.rows().where(F.col("rules_version") == rules_version).drop("rules_version")
        return salted(at, findings, ["blob"], counts=copies.select("blob", "n"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path_id"), "text")
    return Ledger(spark).scan(versions).select(F.col("path_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
