"""Hierarchies and reference graphs: paths, closures, reachability, integrity.

Closures go breadth first: each round is one equi-join of the frontier with the edges and one anti-join with what is
known, and the rows between rounds lie in the shared folder. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_path
from tessera.lineage import materialise

#: Parents that a path has at most; longer chains, and cycles, end here.
MAX_DEPTH = 50


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """key, depth: everything that roots (key) reach over edges (src, dst), roots included at depth 0."""
    found = frontier = materialise(roots.select("key").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not frontier.isEmpty() and (max_rounds is None or depth < max_rounds):
        depth += 1
        step = edges.join(frontier, edges["src"] == frontier["key"]).select(F.col("dst").alias("key")).distinct()
        frontier = materialise(step.where("key is not null").join(found.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)))
        found = found.union(frontier)
    return found


def reachable_levels(roots: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """key: roots and what they reach over a fixed chain of edge tables (src, dst), one per level; no rounds, one plan."""
    out = now = roots.select("key").distinct()
    for edges in levels:
        now = edges.join(now, edges["src"] == now["key"], "left_semi").select(F.col("dst").alias("key")).distinct()
        out = out.union(now)
    return out.distinct()


def unreachable(objects: DataFrame, live: DataFrame) -> DataFrame:
    """objects (key, ...) that a sweep deletes."""
    return objects.join(live.select("key"), "key", "left_anti")


def prune_totals(objects: DataFrame, live: DataFrame) -> DataFrame:
    """One row: scanned, deleted, bytes_reclaimed; objects has key and size."""
    marked = objects.join(live.select("key", F.lit(True).alias("_live")).distinct(), "key", "left")
    dead = F.col("_live").isNull()
    return marked.agg(F.count("*").alias("scanned"), F.count_if(dead).alias("deleted"), F.coalesce(F.sum(F.when(dead, F.col("size"))), F.lit(0)).cast("long").alias("bytes_reclaimed"))


def missing(edges: DataFrame, objects: DataFrame, key: str = "key") -> DataFrame:
    """key, type, message for referenced objects that don't exist, once each."""
    gone = edges.select(F.col("dst").alias(key)).where(F.col(key).isNotNull()).distinct().join(objects.select(key), key, "left_anti")
    return gone.select(key, F.lit("missing").alias("type"), F.lit("object is referenced but not stored").alias("message"))


def corrupt(objects: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """key, type, message for objects whose data doesn't have the SHA-256 that their key ends with."""
    bad = objects.where(~F.sha2(F.col(data).cast("binary"), 256).eqNullSafe(F.substring_index(key, "/", -1)))
    return bad.select(key, F.lit("corrupt").alias("type"), F.lit("hash of the data differs from the key").alias("message"))


def unparsable(objects: DataFrame, schema: str, key: str = "key", data: str = "data") -> DataFrame:
    """key, type, message for objects that aren't JSON of the schema."""
    text = F.col(data).cast("string")
    bad = objects.where(F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).isNull() | F.get_json_object(text, "$").isNull(), F.lit(True)))
    return bad.select(key, F.lit("parse_error").alias("type"), F.lit("not a JSON object of the expected form").alias("message"))


def check_summary(errors: DataFrame) -> DataFrame:
    """Errors by type."""
    return errors.groupBy("type").agg(F.count("*").alias("errors"))


def with_parent(files: DataFrame) -> DataFrame:
    """files with parent_name and is_root: the first parent, if it is known; orphans are roots."""
    up = files.select(F.col("file_id").alias("_p"), F.col("name").alias("parent_name"))
    joined = files.join(up, F.get("parents", F.lit(0)) == F.col("_p"), "left")
    return joined.withColumn("is_root", F.col("_p").isNull()).drop("_p")


def paths(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """file_id, path, depth of files (file_id, name, parents, optional paths).

    A stored path wins; otherwise names are joined along first parents, up to a parent with a stored path, an unknown
    parent or max_depth parents. Rows double the distance that they know in each round, so a round count is logarithmic
    in depth; what a last round knows beyond max_depth is cut off.
    """
    stored = F.nullif(normalize_path(F.get("paths", F.lit(0))), F.lit("")) if "paths" in files.columns else F.lit(None).cast("string")
    known = files.select("file_id", "name", stored.alias("stored"), F.get("parents", F.lit(0)).alias("up"))
    ids = known.select(F.col("file_id").alias("_id"))
    start = known.join(ids, known["up"] == ids["_id"], "left")
    # steps: names so far, from the highest ancestor; up: the next ancestor, null at the end; depth: the ancestors in steps.
    now = materialise(start.select("file_id", F.array(F.coalesce("stored", "name")).alias("steps"), F.when(F.col("stored").isNull(), F.col("_id")).alias("up"), F.lit(0).alias("depth")))
    steps = 1
    while steps <= max_depth and not now.where("up is not null").isEmpty():
        above = now.select(F.col("file_id").alias("_id"), F.col("steps").alias("_steps"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        met = now.join(above, now["up"] == above["_id"], "left")
        on = F.col("_id").isNotNull()
        now = materialise(met.select("file_id", F.when(on, F.concat("_steps", "steps")).otherwise(F.col("steps")).alias("steps"), F.when(on, F.col("_up")).alias("up"), F.when(on, F.col("depth") + F.col("_depth") + 1).otherwise(F.col("depth")).alias("depth")))
        steps *= 2
    nearest = F.slice("steps", F.greatest(F.size("steps") - max_depth, F.lit(1)), F.lit(max_depth + 1))
    return now.select("file_id", F.array_join(nearest, "/").alias("path"), F.least("depth", F.lit(max_depth)).alias("depth"))


def topological(files: DataFrame) -> DataFrame:
    """files with path and depth; ordering by them has parents before children."""
    return files.join(paths(files), "file_id").orderBy("depth", "path")


def ancestors_of(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """file_id of all ancestors of chosen (file_id) over all parents."""
    edges = files.select(F.col("file_id").alias("src"), F.explode("parents").alias("dst"))
    known = files.select(F.col("file_id").alias("key"))
    first = edges.join(chosen.select(F.col("file_id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("key"))
    return reachable(edges, first).join(known, "key", "left_semi").select(F.col("key").alias("file_id"))


def descendants_of(files: DataFrame, root: str) -> DataFrame:
    """file_id, depth of everything below a folder."""
    edges = files.select(F.explode("parents").alias("src"), F.col("file_id").alias("dst"))
    top = files.sparkSession.range(1).select(F.lit(root).alias("key"))
    return reachable(edges, top).where("depth > 0").select(F.col("key").alias("file_id"), "depth")


def under_path(path: Column, wanted: str) -> Column:
    """Whether a path is the wanted one or below it; slashes at the ends and dots of wanted don't matter."""
    wanted = "/".join(p for p in wanted.replace("\\", "/").split("/") if p not in ("", "."))
    return F.lit(True) if not wanted else (path == wanted) | path.startswith(wanted + "/")


def relative_path(path: Column, root: str) -> Column:
    """A path as seen from root; empty for root itself, null for a path that isn't below it."""
    base = "/".join(p for p in root.replace("\\", "/").split("/") if p not in ("", "."))
    if not base:
        return path
    return F.when(path == base, "").when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30))


def restore_selection(files: DataFrame, wanted: str) -> DataFrame:
    """files (with path) that a restore of wanted needs: matches, everything below, and all ancestors of those."""
    placed = files.join(paths(files), "file_id")
    hit = placed.where(under_path(F.col("path"), wanted)).select("file_id")
    needed = hit.union(ancestors_of(files, hit)).distinct()
    return placed.join(needed, "file_id", "left_semi")


def restore_totals(selected: DataFrame) -> DataFrame:
    """One row: dirs, files (those with content), bytes."""
    folder, content = F.col("type") == "folder", F.coalesce(F.col("content_hash"), F.lit("")) != ""
    return selected.agg(F.count_if(folder).alias("dirs"), F.count_if(~folder & content).alias("files"), F.coalesce(F.sum(F.when(~folder & content, F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def resolve_path(folders: DataFrame, path: str, root: str) -> str:
    """The id of a folder by its path from root, segment by segment; none or several of one name is an error."""
    at = root
    for name in [p for p in path.split("/") if p]:
        found = folders.where((F.get("parents", F.lit(0)) == at) & (F.col("name") == name) & (F.col("type") == "folder")).select("file_id").limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{len(found) or 'no'} folders named {name!r} in {at!r}")
        at = found[0][0]
    return at
