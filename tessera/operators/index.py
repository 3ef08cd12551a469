"""The keyed-map index as analytics: which leaf an entry lies in, and which nodes a change rewrites.

The tree itself is only an access path; entries stay a plain table. A node at a level is a prefix of 5 bits per level of
the routing key. Counts are taken once at the deepest level and rolled up, so no level reads the entries again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashes import prefix
from tessera.lineage import materialise

#: Bits of a level, the deepest level, and entries that a leaf has at most above it.
BITS, MAX_LEVEL, LEAF_ENTRIES = 5, 6, 32


def node_counts(entries: DataFrame, path_key: str = "path_key") -> DataFrame:
    """level, node, parent, entries of every prefix that has entries, levels 0 to MAX_LEVEL."""
    deepest = entries.groupBy(prefix(F.col(path_key), MAX_LEVEL).alias("node")).agg(F.count("*").alias("entries"))
    levels, now = [], deepest
    for level in range(MAX_LEVEL, -1, -1):
        up = F.shiftrightunsigned("node", BITS)
        levels.append(now.select(F.lit(level).alias("level"), "node", (up if level else F.lit(None).cast("long")).alias("parent"), "entries"))
        now = now.groupBy(up.alias("node")).agg(F.sum("entries").alias("entries"))
    return reduce(DataFrame.union, levels)


def nodes(entries: DataFrame, path_key: str = "path_key") -> DataFrame:
    """level, node, kind (leaf or internal), entries of the nodes that exist: the root, and children of internal nodes."""
    counted = node_counts(entries, path_key)
    parents = counted.where(f"entries > {LEAF_ENTRIES} and level < {MAX_LEVEL}").select((F.col("level") + 1).alias("level"), F.col("node").alias("parent"))
    below = counted.join(parents, ["level", "parent"], "left_semi").select("level", "node", "entries")
    there = counted.where("level = 0").select("level", "node", "entries").union(below)
    leaf = (F.col("entries") <= LEAF_ENTRIES) | (F.col("level") == MAX_LEVEL)
    return there.select("level", "node", F.when(leaf, "leaf").otherwise("internal").alias("kind"), "entries")


def placed(entries: DataFrame, path_key: str = "path_key") -> DataFrame:
    """entries with the level and node of their leaf. Only the distinct deepest prefixes, two numbers each, are tried on all levels; entries are joined once."""
    leaves = nodes(entries, path_key).where("kind = 'leaf'").select("level", F.col("node").alias("leaf"))
    deep = entries.select(prefix(F.col(path_key), MAX_LEVEL).alias("_deep")).distinct()
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftrightunsigned("_deep", BITS * (MAX_LEVEL - level)).alias("leaf")) for level in range(MAX_LEVEL + 1)])
    found = deep.select("_deep", F.explode(levels).alias("_at")).select("_deep", "_at.level", "_at.leaf").join(leaves, ["level", "leaf"], "left_semi")
    return entries.withColumn("_deep", prefix(F.col(path_key), MAX_LEVEL)).join(found, "_deep").drop("_deep")


def node_refs(entries: DataFrame, key: str = "file_id", value: str = "ref", path_key: str = "path_key", by: Sequence[str] = ()) -> DataFrame:
    """level, node, ref: content hashes of all nodes. A leaf's is of its sorted entries (at most LEAF_ENTRIES, deepest leaves aside), an internal node's of its children.

    by: columns that tell versions apart, which have the same keys; they are hashed in one pass, and the result has them too.
    """
    first = entries.dropDuplicates([path_key, key]) if by else entries
    at = entries.join(placed(first.select(path_key, key), path_key), [path_key, key])
    out = at.groupBy(*by, "level", F.col("leaf").alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, value))), "\n"), 256).alias("ref"))
    out = materialise(out)
    levels = [out]
    now = out.where(f"level = {MAX_LEVEL}")
    for level in range(MAX_LEVEL, 0, -1):
        inner = now.groupBy(*by, F.shiftrightunsigned("node", BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "ref"))).alias("children"))  # 32 at most
        inner = inner.select(*by, F.lit(level - 1).alias("level"), "node", F.sha2(F.array_join(F.transform("children", lambda c: c["ref"]), "\n"), 256).alias("ref"))
        inner = materialise(inner)
        levels.append(inner)
        now = inner.union(out.where(F.col("level") == level - 1))
    return reduce(DataFrame.union, levels)


def rewritten(before: DataFrame, after: DataFrame) -> DataFrame:
    """level, nodes, new_nodes of a version's node_refs(): what it doesn't share with the one before."""
    known = before.select("ref", F.lit(True).alias("_known")).distinct()
    return after.join(known, "ref", "left").groupBy("level").agg(F.count("*").alias("nodes"), F.count_if(F.col("_known").isNull()).alias("new_nodes"))
