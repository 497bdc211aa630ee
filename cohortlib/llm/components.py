"""Connected components of a link table that is too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import stage


def local_stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among few nodes, cut down to one (node, smallest of its component) for each node but the smallest.

    Connectivity is kept whole, so a task may send these on in place of all pairs it has found."""
    nodes, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))      # hook the larger root below the smaller
        while True:                                                  # then let every node point at its root
            up = low[low]
            if np.array_equal(up, low):
                break
            low = up
    leaf = low != np.arange(len(nodes))
    return nodes[leaf], nodes[low[leaf]]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, root: each linked node and the smallest node it can reach.

    Alternates two steps until nothing changes: every node links its larger neighbours to the smallest of all its
    neighbours, then its smaller neighbours and itself to the smallest of those (large star, small star). The number
    of rounds grows with the logarithm of the longest path. A node's neighbours are never gathered into one row: the
    smallest one comes from an aggregation with map-side combine, and a join brings it back. Each round is written to
    the shared folder, so that neither lineage nor losses pile up. Links to itself and repeated links are allowed."""
    edges = stage(links.select(F.greatest(left, right).alias("x"), F.least(left, right).alias("y")).where("x <> y").distinct(),
                  "links")
    before = None
    while True:
        # Each table is written before it is joined: then both sides of a join come straight from an exchange, and
        # Spark can split the rows of a node that has very many links.
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = stage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low")), "low")
        large = stage(both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct(), "large")
        low = stage(large.groupBy("x").agg(F.min("y").alias("low")), "low")
        small = large.join(low, "x").where("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        edges = stage(small.unionByName(low.withColumnRenamed("low", "y")).distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:                                  # a round without change: every node links to its root
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = now
