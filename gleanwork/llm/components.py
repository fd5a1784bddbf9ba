"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is its least node.

    Every step only moves edges towards smaller nodes, within executors, until all
    are stars around a least node. Minima are written before they meet the edges, so
    that the join has two plain exchanges, which Spark splits where a hub is skewed,
    or a side whose size Spark knows. Loops and repeated edges make no difference.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        edges = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges-0")
        for n in itertools.count(1):
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("below"), F.count_if(F.col("b") > F.col("a")).alias("above")), f"least-{n}")
            if least.filter("below > 1 or below = 1 and above > 0").isEmpty():
                return cut(least.select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
            large = both.join(least.select("a", F.least("a", "m").alias("m")), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            # a hub that is its own minimum keeps its edges; others hand theirs on
            large = scratch.write(large.filter("a <> b").distinct(), f"large-{n}")
            least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"small-{n}")
            small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
            edges = scratch.write(small.filter("a <> b").distinct(), f"edges-{n}")
            scratch.drop(f"edges-{n - 1}", f"least-{n}", f"large-{n}", f"small-{n}")
