"""Connected components of a link table, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node that has a link; nodes of one component share ``root``.

    Each round hashes the nodes anew, hangs every node under the smallest hash of its closed
    neighbourhood and contracts the links to the parents. The hash makes the expected number
    of rounds logarithmic for any numbering, a long chain in order included. A hub's links
    meet only in a minimum with a map-side part and in joins whose other side has one row
    for each node, so that they can be split. Self links and nulls are dropped; repeated
    links do not matter; without links the result is empty.
    """
    a, b = F.col(left), F.col(right)
    one = edges.where(a != b).select(a.alias("u"), b.alias("v"))
    links = materialise(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    placed = links.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    step = 0
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("h"), c.alias("p"))  # noqa: B023, E731
        parent = materialise(links.groupBy("u").agg(F.min(rank(F.col("v"))).alias("low"))
                             .select("u", F.least(F.col("low"), rank(F.col("u")))["p"].alias("p")), "parents")
        above = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
        links = materialise(links.join(parent, "u").join(above, "v").where(F.col("p") != F.col("q"))
                            .select(F.col("p").alias("u"), F.col("q").alias("v")).distinct(), "links")
        placed = materialise(placed.join(parent, placed["root"] == parent["u"], "left")
                             .select("node", F.coalesce("p", "root").alias("root")), "placed")
        step += 1
    return placed
