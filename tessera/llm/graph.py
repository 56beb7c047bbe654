"""Connected components of an edge table, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of edges; component is the smallest node
    reachable. Alternates large stars (each node links its larger neighbours to
    its smallest one) and small stars (the same for the smaller ones) until
    nothing changes. Every round is written to the shared folder. A hub's edges
    are only aggregated (min) and joined, never gathered."""
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        small = written(small, "small")
        same = small.count() == links.count() and not small.exceptAll(links).head(1)
        links = small
        if same:
            break
    tops = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops).groupBy("node").agg(F.min("component").alias("component"))
