"""Connected components of a link table, by stars that Spark joins and sums."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import scratch_tables, stored

LINKS_PER_GROUP = 300_000


def components(links: DataFrame, a="a", b="b", per_group: int = LINKS_PER_GROUP) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Links are dealt by hash into groups of about `per_group`, and each group keeps a star of each of its own components only.
    What several groups have found then meets in large and small stars in turn: each round links the neighbours of a node
    to the smallest of them, which at least halves the depth. A node's smallest neighbour is a pre-aggregated minimum, so
    a node with many links is not gathered. Null nodes and links of a node to itself are left out. No links, no rows.
    """
    with scratch_tables(links.sparkSession):
        return stored(_components(links, a, b, per_group), keep=True)


def _stars(table: pa.Table) -> pa.Table:
    """The links (low, high) of each node of a group to the smallest node of its component there."""
    nodes, ends = np.unique(np.concatenate((np.asarray(table["low"]), np.asarray(table["high"]))), return_inverse=True)
    x, y = ends[:table.num_rows], ends[table.num_rows:]
    root = np.arange(len(nodes))
    while True:
        one, other = root[x], root[y]
        apart = one != other
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while (root[root] != root).any():
            root = root[root]
    far = root != np.arange(len(nodes))
    return pa.table({"low": nodes[root[far]], "high": nodes[far]})


def _labelled(stars):
    roots = stars.select("low").distinct()
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        roots.select(F.col("low").alias("node"), F.col("low").alias("component")))


def _components(links, a, b, per_group):
    edges = stored(links.select(F.least(a, b).cast("long").alias("low"), F.greatest(a, b).cast("long").alias("high")).filter(
        f"{a} IS NOT NULL AND {b} IS NOT NULL AND low < high"))
    groups = 1 + edges.count() // per_group
    found = edges.withColumn("group", F.pmod(F.xxhash64("low", "high"), F.lit(groups))).groupBy("group").applyInArrow(
        _stars, "low long, high long")
    if groups == 1:
        return _labelled(stored(found))
    edges = stored(found.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy(F.col("low").alias("node")).agg(F.min("high").alias("m")).select(
            "node", F.least("node", "m").alias("m"))
        large = edges.join(least, edges.low == least.node).select(F.col("high"), F.col("m")).unionByName(
            edges.join(least, edges.high == least.node).filter("high < low").select(F.col("low").alias("high"), "m"))
        large = large.filter("m < high").select(F.col("m").alias("low"), "high").distinct()
        large = stored(large)
        least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        small = large.join(least, large.high == least.node)
        moved = small.select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(
            small.select(F.col("m").alias("low"), "high")).filter("low < high").distinct()
        moved = stored(moved)
        if moved.count() == edges.count() and moved.exceptAll(edges).isEmpty():
            break
        edges = moved
    return _labelled(moved)
