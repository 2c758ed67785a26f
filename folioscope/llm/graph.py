"""Connected components by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, release, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); a component is named by its smallest node.

    Distributed union-find: in every round nodes hook to the smallest neighbour they know of (first the larger
    neighbours of each node, then the smaller ones), until no edge changes. Rounds grow with the logarithm of the
    longest path. Minima are combined before the shuffle; in the joins that follow a hot node is unique on one side, so
    adaptive execution splits the other. Nodes may be of any type with an order. Loops and repeated edges are allowed;
    without edges there are no rows.
    """
    edges = _ordered(edges.select("u", "v"))
    edges, state = _settled(edges)
    while state[0]:
        # Larger neighbours of a node hook to the smallest neighbour, or the node if it is smaller.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        up = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        up = _ordered(up)
        # Smaller neighbours, and the node itself, hook to the smallest of them.
        least = up.groupBy("u").agg(F.min("v").alias("_m"))
        down = up.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("_m").alias("v"))
        before, (edges, after) = edges, _settled(_ordered(down))
        discard(before)
        release(edges)  # plans and tables of the rounds before would fill the driver
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components of `components` after some more links (u, v): only what these hold together is gone through."""
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    new = nodes.join(groups.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    every = groups.unionByName(new)
    ends = [every.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("u", "v")]
    labels = links.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    higher = components(labels).select(F.col("node").alias("component"), F.col("component").alias("_higher"))
    return every.join(higher, "component", "left").select("node", F.coalesce("_higher", "component").alias("component"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pairs.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written out, with their number and a hash of the set."""
    edges = stored(edges)
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    return edges, tuple(row)
