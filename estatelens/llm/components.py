"""Connected components of a graph given by its edges, with alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import meet, stage


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b bigint): the smallest node it can reach.

    Each round hangs all neighbours of a node on its smallest one, first the larger neighbours and
    then the smaller ones, until nothing changes; rounds grow with the logarithm of the longest path.
    All steps are aggregates and equality joins, in which hubs are split (`meet`); the edges of
    a round are tables in the shared folder, and only a count and a checksum reach the driver. Loops
    and nulls are ignored; no edges give no rows.
    """
    links = stage(
        edges.where((F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = F.col("v") > F.col("u")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(up).alias("n"))
        large = stage(meet(both.where(up), low, ["u"], mark["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, low, ["u"], mark["n"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
