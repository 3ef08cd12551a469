"""Connected components of an edge table, as joins and aggregates only.

Alternating large-star and small-star steps: each step reattaches the neighbours of a node to the smallest node that
it knows, until every component is a star around its smallest node. A step is one map-side combined minimum by node and
one equi-join on the node, so a hub with a third of all edges is only a skewed join, which adaptive execution splits; no
neighbour list is ever gathered. Between steps the edges lie in the shared folder, and only their count and checksum
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise


#: Edges of a partition: small tables lie in few, so that late rounds don't run hundreds of empty tasks.
PARTITION_EDGES = 50_000


def _packed(edges: DataFrame, at_most: int) -> DataFrame:
    return edges.coalesce(-(-at_most // PARTITION_EDGES)) if at_most < 100 * PARTITION_EDGES else edges


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: for each node that has an edge to another node, the smallest node that it reaches.

    Edges count in both directions; nulls, loops and repeated edges are ignored. Nodes without another end are not
    returned: they are their own component. An empty edge table gives an empty result.
    """
    pairs = edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"), F.col(src).alias("a"), F.col(dst).alias("b"))
    now = materialise(pairs.where("a is not null and b is not null and a <> b").select("hi", "lo").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = now.join(least, now["lo"] == least["node"]).select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        # No step has more edges than the one before.
        now = materialise(_packed(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), state[0]))
        before, state = state, _state(now)
        if state == before:
            break
    centres = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(centres)


def chased(parents: DataFrame) -> DataFrame:
    """node, component of a forest (node, parent), one parent per node and no cycles: every node's root, by pointer jumping."""
    now = materialise(parents.select("node", F.col("parent").alias("component")))
    while True:
        up = now.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        step = now.join(up, now["component"] == up["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"), F.col("_n").isNotNull().alias("moved"))
        step = materialise(step)
        now = step.select("node", "component")
        if step.where("moved").isEmpty():
            return now


def merged(label: DataFrame, links: DataFrame, src: str, dst: str) -> DataFrame:
    """label (node, component; nodes that are their own component are left out) after more links between nodes.

    Only the links, between components, go through connected_components(); they are few where most is merged already.
    """
    at = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    ends = links.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    for end in ("a", "b"):
        ends = ends.join(at, ends[end] == at["_n"], "left").withColumn(end, F.coalesce("_c", end)).select("a", "b")
    joined = materialise(connected_components(ends, "a", "b").where("node <> component"))
    to = joined.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    moved = label.join(to, label["component"] == to["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"))
    return materialise(moved.union(joined))
