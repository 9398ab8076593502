"""Connected components of a table of links, by rounds of contraction.

Each round gives every node the neighbour (or itself) that comes first in an order, and replaces
links by links between those; the order is the ids' own in the first round, which settles
stars around their smallest member at once, and a fresh hash order in each later one, which
shrinks chains by a constant factor. Tables are written to the shared folder in each round, so
lineage stays short; nothing is collected, and hot nodes meet partial aggregates and joins that
Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links(a, b)`` that has a link to another; component is its smallest node."""
    left = staged(simple(links), "links")
    parents = []
    while not left.isEmpty():
        order = (lambda c: F.col(c)) if not parents else (lambda c, k=len(parents): F.xxhash64(F.col(c), F.lit(k)))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("id"))).alias("first"))
        parent = staged(first.select(F.col("a").alias("node"), F.least("first", F.struct(order("a").alias("o"), F.col("a").alias("id")))["id"].alias("parent")), "parents")
        parents.append(parent)
        at_a, at_b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = staged(simple(left.join(at_a, "a").join(at_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "links")
    if not parents:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    rooted = parents[0].select("node", F.col("parent").alias("root"))
    for parent in parents[1:]:
        step = parent.select(F.col("node").alias("root"), F.col("parent").alias("above"))
        rooted = rooted.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    rooted = staged(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return staged(rooted.join(least, "root").select("node", "component"), "components")


def simple(links: DataFrame) -> DataFrame:
    """Each undirected link once, loops left out."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
