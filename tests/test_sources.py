"""Remote reads by batches of ids, and the index of vectors."""

import pytest
from pyspark.sql import functions as F

from driftlens.sources import io
from driftlens.sources.index import VectorIndex
from driftlens.streaming.resume import append_once, write_once


def test_remote_reads_by_batches(spark):
    """Each batch of ids is a partition whose list is part of the remote query; other ways give the same rows."""
    url = "jdbc:derby:memory:batches;create=true"
    rows = [(i, f"it's {i}", i % 5) for i in range(100)]
    spark.createDataFrame(rows, "id int, name string, kind int").write.option("createTableColumnTypes", "name varchar(40)").jdbc(url, "things", mode="overwrite")
    some = spark.createDataFrame([(i,) for i in (3, 5, 5, 8, 50, 77, 99, 1000, None)], "id int")
    want = {(i, n, k) for i, n, k in rows if i in (3, 5, 8, 50, 77, 99)}
    got = io.read_jdbc(spark, url, "things", members=some, on="id", size=3)
    assert got.rdd.getNumPartitions() == 3 and {tuple(r) for r in got.collect()} == want
    assert io.id_batches(some, "id", 3) == [[3, 5, 8], [50, 77, 99], [1000]] and io.id_batches(some, "id", 3, most=2) is None
    for more in ({"most": 2}, {"key": "id", "lo": 0, "hi": 100, "n": 4}):
        assert {tuple(r) for r in io.read_jdbc(spark, url, "things", members=some, on="id", **more).collect()} == want
    assert {r.id for r in io.read_jdbc(spark, url, "things", members=some, on="id", where="kind = 0").collect()} == {5, 50}
    names = spark.createDataFrame([("it's 7",), ("none",)], "name string")
    assert [r.id for r in io.read_jdbc(spark, url, "things", members=names, on="name").collect()] == [7]
    assert io.read_jdbc(spark, url, "things", members=some.where("false"), on="id").count() == 0


def test_ids_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(1000).select(F.col("id"), (F.col("id") * 2).alias("x")).write.parquet(path)
    some = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "id long")
    got = io.of_members(spark.read.parquet(path), some, "id")
    assert "PushedFilters: [In(id, [0," in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {r.id for r in got.collect()} == set(range(0, 40, 2)) == {r.id for r in io.of_members(spark.read.parquet(path), some, "id", most=5).collect()}
    assert io.of_members(spark.read.parquet(path), some.where("false"), "id").count() == 0


def test_index(spark, tmp_path):
    schema = "id long, v array<double>, name string"
    rows = lambda *some: spark.createDataFrame([(i, [float(x)], n) for i, x, n in some], schema)
    index = VectorIndex(spark, f"file://{tmp_path}/index", rows((0, 0, "")).schema, buckets=4)
    held = lambda df=None: {r.id: (r.v[0], r.name) for r in (df or index.read()).collect()}
    assert held() == {} and index.count() == 0 and held(index.lookup([1])) == {}
    index.upsert(rows((1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (3, 4, "d")))
    assert held() == {1: (1.0, "a"), 2: (2.0, "b"), 3: (4.0, "d")}
    index.upsert(rows((2, 5, "e"), (4, 6, "f")), order="name")
    index.delete(rows((1, 0, ""), (9, 0, "")).select("id"))
    assert held() == {2: (5.0, "e"), 3: (4.0, "d"), 4: (6.0, "f")} and held(index.lookup([1, 2, 9])) == {2: (5.0, "e")}
    index.upsert(rows((1, 7, "g")))
    index.delete_where("name = 'd'")
    want = {1: (7.0, "g"), 2: (5.0, "e"), 4: (6.0, "f")}
    assert held() == want and index.count() == 3
    index.compact()
    assert held() == want and len(index.current()["parts"]) == 1 and index.clean() == 5 and held() == want
    again = VectorIndex(spark, f"file://{tmp_path}/index", index.schema)
    assert {r.id for r in again.read().collect()} == set(want) and again.current()["buckets"] == 4
    with pytest.raises(Exception, match="an id is null"):
        index.upsert(rows((None, 1, "x")))
    assert held() == want
    index.reset()
    assert held() == {} and index.count() == 0


def test_index_survives_crashes(spark, tmp_path, monkeypatch):
    """A crash between a part and the list that names it, or within the list, leaves the index as it was; of two writers one fails."""
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, v array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index", df.schema)
    index.upsert(df)
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.upsert(df.withColumn("v", F.array(F.lit(9.0))))
    assert sorted(r.v[0] for r in index.read().collect()) == [0.0, 1.0, 2.0, 3.0, 4.0] and index.clean() == 1
    (tmp_path / "index/lists/000000000002").write_text('{"parts": [')
    assert index.count() == 5
    seen = index.current()
    index.delete(df.where("id = 0"))
    assert index.count() == 4 and index.current()["version"] == 3
    with pytest.raises(RuntimeError):
        index._commit(seen, [])
    assert index.count() == 4


def test_streams_that_repeat(spark, tmp_path):
    """Repeated ids, a repeated batch, a run from the beginning and new files add what is new only."""
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    schema = "id long, t int, x string"
    held = lambda: {(r.id, r.t, r.x) for r in spark.read.parquet(out).collect()}
    spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (1, 4, "c"), (2, 1, "d"), (None, 1, "e")], schema).coalesce(1).write.parquet(src)
    run = lambda name: append_once(spark.readStream.schema(schema).parquet(src), out, f"file://{tmp_path}/{name}", "id", "t").awaitTermination()
    run("first")
    assert held() == {(1, 4, "b"), (2, 1, "d")}
    spark.createDataFrame([(2, 0, "late"), (3, 1, "f")], schema).coalesce(1).write.mode("append").parquet(src)
    run("first")
    want = {(1, 4, "b"), (2, 1, "d"), (3, 1, "f")}
    assert held() == want and spark.read.parquet(out).count() == 3
    write_once(out, "id", "t")(spark.createDataFrame([(2, 0, "late"), (3, 1, "f")], schema), 1)
    assert held() == want
    run("second")
    assert {r[0] for r in held()} == {1, 2, 3} and spark.read.parquet(out).count() == 3
