"""Connected components over an edge table, without the driver or a task seeing all edges.

Edge cases: edges of a node with itself add nothing, repeated edges count once,
rows with a null end are no edges; a node on no other edge is not returned; an
empty table gives an empty result; other columns are refused, as the two are
taken by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, salted, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node on an edge.

    ``edges`` has two long columns. Alternating large-star and small-star steps
    (each a grouped minimum and a join) shrink every component to a star around
    its smallest node. The edges of a hub are split among tasks, and no step
    emits more than two rows per edge. A step's tables go when the next has read
    them.
    """
    a, b = edges.columns
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    last = None
    for _ in range(rounds):
        # large star: neighbours that are larger than a node go to its smallest neighbour, itself included
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("mv"), F.count(F.lit(1)).alias("n")))
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = written(salted(up, least.select("u", F.least("mv", "u").alias("m")), ["u"], counts=least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = salted(large, low.select("u", "m"), ["u"], counts=low.select("u", "n"))
        nxt = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        dropped(e, least, large, low)
        e = nxt
        sums = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == sums:
            break
        last = sums
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
