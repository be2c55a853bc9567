"""Connected components of a link table by alternating stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import Work


def _least(near: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u and all its v.

    The rows are joined on one key more than the least values are grouped by, so both sides are dealt out anew and a
    node with very many links can be split over tasks.
    """
    m = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return near.withColumn("k", F.xxhash64("u")).join(m.withColumn("k", F.xxhash64("u")), ["k", "u"]).drop("k")


def components(links: DataFrame, work: Work, name: str = "links") -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): root is the least node that can be reached.

    Large stars hang the greater neighbours of a node on its least neighbour, small stars the others; the two alternate
    until neither changes the table. The number of rounds grows with the logarithm of the component's size.
    """
    table = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    if table.isEmpty():
        return table.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen, k = None, 0
    while True:
        both = table.unionAll(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.save(large, f"{name}-{k}-large")
        small = _least(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = work.save(small, f"{name}-{k + 1}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k}-large", f"{name}-{k}")
        if state == seen:
            break
        seen, table, k = state, after, k + 1
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
