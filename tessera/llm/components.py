"""Connected components of a link table by min-label propagation with pointer jumping; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a long, b long); the component is the smallest id reachable.

    Alternates two steps until nothing changes: every node's neighbours (itself included) link to their smallest one;
    larger neighbours first, then smaller ones.  A node with a third of all links is only ever aggregated with min, and
    met in joins that adaptive execution splits.  Rounds grow with the logarithm of the component size.
    """
    edges = links.where("a <> b").selectExpr("greatest(a, b) as v", "least(a, b) as u").distinct()
    edges, last = materialize(edges, "cc"), None
    while True:
        # Large star: all larger neighbours of v go to v's smallest neighbour (or itself).
        both = edges.select("v", "u").union(edges.selectExpr("u as v", "v as u"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").selectExpr("u as v", "m as u")
        # Small star: v's smaller neighbours and v itself go to the smallest of them.
        large = large.where("v <> u").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").selectExpr("u as v", "m as u").union(lowest.selectExpr("v", "m as u")).where("v <> u")
        new = materialize(small.distinct(), "cc")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head()
        discard(edges)
        edges, same, last = new, mark == last, mark
        if same:
            break
    return edges.selectExpr("v as id", "u as component").union(edges.selectExpr("u as id", "u as component").distinct())
