"""Readers and writers of the engine's files."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quarters
from ..functions import text as T

# Other names of columns.
ALIASES = {"componenttext": "text", "component_type_id": "component_type", "year": "fiscalyear"}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files(spark: SparkSession, path: str) -> list[list]:
    """Name, length and time of change of each file below ``path``, in order; none where nothing is there."""
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; where it is unset, only a local master gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def first_existing(spark: SparkSession, root: str, names: list[str]) -> str:
    for n in names:
        if exists(spark, f"{root}/{n}"):
            return f"{root}/{n}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {root}")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def aliased(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed where the new name is free."""
    for old, new in (aliases or ALIASES).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def without_stray(df: DataFrame, prefix: str = "temporal_", keep: str = "temporal_framing") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix) and c != keep])


def transcripts(df: DataFrame, types: list[int] = (2, 3, 4)) -> DataFrame:
    """Components with company, fiscal year and quarter, canonical transcript_id and non-null text."""
    df = required(aliased(df), ["companyid", "component_type", "text"])
    if "fiscalyear" not in df.columns or "fiscalquarter" not in df.columns:
        q = quarters.to_int(quarters.clean(F.col("quarter").cast("string") if "quarter" in df.columns else F.lit(""), F.col("event_date") if "event_date" in df.columns else F.lit(None).cast("date")))
        df = df.withColumns({"fiscalyear": F.floor(q / 4).cast("int"), "fiscalquarter": (F.pmod(q, F.lit(4)) + 1).cast("int")})
    c = T.company_id(F.col("companyid"))
    return df.where(F.col("component_type").try_cast("int").isin(*types)).withColumns({
        "companyid": c,
        "component_type": F.col("component_type").try_cast("int"),
        "fiscalyear": F.col("fiscalyear").try_cast("int"),
        "fiscalquarter": F.col("fiscalquarter").try_cast("int"),
        "text": F.coalesce("text", F.lit("")),
        "transcript_id": F.concat(c, F.lit("_"), F.col("fiscalyear").try_cast("int").cast("string"), F.lit("Q"), F.col("fiscalquarter").try_cast("int").cast("string")),
    })


def read_json_dir(spark: SparkSession, path: str) -> DataFrame:
    """One object a file; the file's stem stands in for a missing id, a single component for missing ones; broken files go."""
    schema = "transcript_id string, company_id string, quarter string, text string, content string, components array<struct<text:string, component_type:int>>, _bad string"
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.input_file_name())
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    single = F.array(F.struct(F.coalesce("text", "content", F.lit("")).alias("text"), F.lit(0).alias("component_type")))
    return raw.where("_bad is null").select(F.coalesce("transcript_id", stem).alias("transcript_id"), "company_id", "quarter", F.coalesce("components", single).alias("components"))


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str = "transcript_id") -> DataFrame:
    """Lines that parse and have an id; of one id the last line of the last file stays."""
    lines = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = lines.where(F.col(f"r.{key}").isNotNull() & (F.col(f"r.{key}") != ""))
    last = F.row_number().over(Window.partitionBy(f"r.{key}").orderBy(F.desc("f"), F.desc("n")))
    return rows.withColumn("__k", last).where("__k = 1").select("r.*")


def append_new(results: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key is not at ``path`` yet; returns those rows."""
    spark = results.sparkSession
    done = spark.read.schema(results.schema).json(path).select(key) if exists(spark, path) else None
    new = results.join(done, key, "left_anti") if done is not None else results
    new.write.mode("append").json(path)
    return new


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Overwrite; nested columns stay nested."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_json_artefact(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON document, written by Spark so that any shared file system works."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_artefact(spark: SparkSession, path: str) -> dict | None:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect())) if exists(spark, path) else None


def stage_status(spark: SparkSession, stages: dict[str, list[str]]) -> dict[str, str]:
    """ready, partial or missing for each stage by its files."""
    out = {}
    for name, paths in stages.items():
        n = sum(exists(spark, p) for p in paths)
        out[name] = "ready" if n == len(paths) else "partial" if n else "missing"
    return out


def read_csv_checked(spark: SparkSession, path: str, schema: str, allowed: dict[str, tuple]) -> DataFrame:
    """A CSV file with all columns of the schema; reading raises on a value that its column does not allow."""
    have = spark.read.option("header", True).csv(path).columns
    names = [c.split()[0] for c in schema.split(", ")]
    required(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in have)), names)
    raw = spark.read.option("header", True).csv(path).select(*names)
    df = raw.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))])
    for c, values in allowed.items():
        wrong = F.raise_error(F.concat(F.lit(f"{c} can't be "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        df = df.withColumn(c, F.when(F.col(c).isin(*values), F.col(c)).otherwise(wrong.cast("string")))
    return df


def repaired(spark: SparkSession, jsonl: str, path: str, schema: str, key: str = "transcript_id") -> int:
    """Write the table at ``path`` anew from its lines; the table before stays once, beside it, as ``<path>.bak``."""
    rows = read_jsonl(spark, jsonl, schema, key)
    fresh = f"{path}.new"
    write_parquet(rows, fresh)
    jvm = spark.sparkContext._jvm
    place = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place(path)):
        fs.delete(place(f"{path}.bak"), True)
        fs.rename(place(path), place(f"{path}.bak"))
    fs.rename(place(fresh), place(path))
    return spark.read.parquet(path).count()


#: Ids of members that are asked for by name, and those of one batch; more are found by a join.
MOST_IDS, BATCH_IDS = 100_000, 1000


def id_batches(members: DataFrame, on: str, size: int = BATCH_IDS, most: int = MOST_IDS) -> list[list] | None:
    """The distinct ids of ``members`` in order, in batches; None if there are more than ``most``, which are not brought to the driver."""
    ids = [r[0] for r in members.select(on).where(F.col(on).isNotNull()).distinct().limit(most + 1).collect()]
    if len(ids) > most:
        return None
    ids.sort()
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def of_members(table: DataFrame, members: DataFrame, on: str, most: int = MOST_IDS) -> DataFrame:
    """The rows of a file table whose ``on`` is among the members': as a list that reaches the scan, where row groups are skipped by it, or by a join for more than ``most`` ids."""
    batches = id_batches(members, on, max(1, most), most)
    if batches is None:
        return table.join(members.select(on).distinct(), on, "left_semi")
    return table.where(F.col(on).isin([i for b in batches for i in b]))


def _quoted(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'" if not isinstance(value, (int, float)) else str(value)


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, lo: int = 0, hi: int = 0, n: int = 1, members: DataFrame | None = None, on: str | None = None, where: str | None = None, size: int = BATCH_IDS, most: int = MOST_IDS) -> DataFrame:
    """A remote table or query; filters and columns are pushed down, and a numeric key splits the read.

    With ``members`` only rows whose ``on`` is among theirs: each batch of ids
    is a partition with a list of its own in the remote query, so that nothing
    else is sent and no list grows too long. More than ``most`` ids, or a
    ``key`` that splits the read, are joined after it.
    """
    batches = id_batches(members, on, size, most) if members is not None and not key else None
    if batches is not None:
        have = spark.read.format("jdbc").option("url", url).option("dbtable", query).load().columns
        name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(next(c for c in have if c.lower() == on.lower()))
        found = spark.read.jdbc(url, query, predicates=[f"{name} IN ({', '.join(map(_quoted, b))})" for b in batches] or ["1 = 0"])
        return found.where(where) if where else found
    r = spark.read.format("jdbc").option("url", url).option("dbtable", query)
    if key:
        r = r.options(partitionColumn=key, lowerBound=lo, upperBound=hi, numPartitions=n)
    out = r.load()
    out = out.where(where) if where else out
    return out if members is None else out.join(members.select(on).distinct(), on, "left_semi")
