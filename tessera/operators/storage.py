"""Content-addressed objects, chunks and packs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import materialise

#: The largest object that is packed or inlined, the size at which a pack is closed, and the wasted share from which it is rewritten.
SMALL_OBJECT, PACK_SIZE, MAX_WASTE = 512 * 1024, 8 * 1024 * 1024, 0.3
#: Prefixes of objects that may be packed, and index objects that never are.
PACKED_PREFIXES = ("filemeta/", "node/", "snapshot/", "chunk/", "content/", "index/")
UNPACKED_KEYS = ("index/packs", "index/snapshots")


def new_objects(candidates: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """candidates that must be written: not stored yet, once per key."""
    return candidates.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def already_stored(candidates: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    return candidates.join(stored.select(key), key, "left_semi")


def dedup_ratio(objects: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """One row: objects, distinct_objects, bytes, stored_bytes. Sizes are the same for one key."""
    per_key = objects.groupBy(key).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("objects"), F.count("*").alias("distinct_objects"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("stored_bytes"))


def placement(size: Column, limit: int = SMALL_OBJECT) -> Column:
    """Where content goes: empty (no chunks), inline, or chunked."""
    return F.when(size == 0, "empty").when(size <= limit, "inline").otherwise("chunked")


def packable(key: Column, size: Column, limit: int = SMALL_OBJECT) -> Column:
    small = F.lit(False)
    for p in PACKED_PREFIXES:
        small = small | key.startswith(p)
    return small & ~key.isin(*UNPACKED_KEYS) & ~key.startswith("index/lock") & (size <= limit)


def running_total(rows: DataFrame, order: list[str], size: str, into: str) -> DataFrame:
    """rows with the sum of size up to and including each row in a total order.

    The order is cut into as many ranges as the session has shuffle partitions; each range sums inside, and the ranges'
    totals, one row each, are summed globally. The
    ranges are fixed by one materialised pass, so no task sees more than its range.
    """
    from tessera.lineage import materialise

    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_total"))
    before = totals.select(F.col("_part").alias("_p"), (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_before"))
    summed = ranged.withColumn("_inside", F.sum(size).over(inside)).join(before, F.col("_part") == F.col("_p"))
    return summed.select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("long").alias(into))


def quota_cutoff(writes: DataFrame, budget: int, order: list[str], size: str = "size") -> DataFrame:
    """writes with total (bytes so far) and allowed: a write whose total exceeds the budget, and all after it, are not."""
    return running_total(writes, order, size, "total").withColumn("allowed", F.col("total") <= budget)


def metered(writes: DataFrame, key: str = "key", size: str = "size", deleted: str = "deleted") -> DataFrame:
    """One row: bytes written less bytes deleted; the index isn't counted."""
    counted = ~F.col(key).startswith("index/")
    return writes.where(counted).agg(F.coalesce(F.sum(F.when(F.col(deleted), -F.col(size)).otherwise(F.col(size))), F.lit(0)).cast("long").alias("net_bytes"))


def sizes_by_prefix(objects: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """Objects and bytes by the type of object, the part of the key before the slash."""
    return objects.groupBy(F.substring_index(key, "/", 1).alias("prefix")).agg(F.count("*").alias("objects"), F.sum(size).cast("long").alias("bytes"))


def fixed_packs(objects: DataFrame, order: list[str], size: str = "size", pack_size: int = PACK_SIZE) -> DataFrame:
    """objects with pack and offset: a pack is what begins in one stretch of pack_size bytes of the total order."""
    summed = running_total(objects, order, size, "_end").withColumn("_begin", F.col("_end") - F.col(size))
    packed = summed.withColumn("pack", F.floor(F.col("_begin") / pack_size).cast("long"))
    inside = Window.partitionBy("pack")
    return packed.withColumn("offset", (F.col("_begin") - F.min("_begin").over(inside)).cast("long")).drop("_end", "_begin")


_PACKED = "shard int, pack int, key string, offset long, length long"


def greedy_packs(objects: DataFrame, shards: int, pack_size: int = PACK_SIZE, key: str = "key", size: str = "size") -> DataFrame:
    """shard, pack, key, offset, length: objects fill a pack in key order until it has pack_size bytes or more.

    The buffer's reset depends on all before it, so a shard (by the MD5 of the key) is read in order; only the buffer's
    length is kept, so a shard of any size streams through.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pack, held = None, 0, 0
        for batch in batches:
            out: list[tuple[int, int, str, int, int]] = []
            for shard, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, pack, held = shard, 0, 0
                out.append((shard, pack, k, held, n))
                held += n
                if held >= pack_size:
                    pack, held = pack + 1, 0
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "pack", "key", "offset", "length"])

    dealt = objects.select(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("string").alias("key"), F.col(size).cast("long").alias("size"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(fill, _PACKED)


def read_packed(keys: DataFrame, catalog: DataFrame, packs: DataFrame) -> DataFrame:
    """key, data of keys that the catalog (key, pack_ref, offset, length) knows; packs has pack_ref and data."""
    placed = keys.select("key").join(catalog, "key").join(packs, "pack_ref")
    return placed.select("key", F.expr("substring(data, cast(offset + 1 as int), cast(length as int))").alias("data"))


def list_objects(*sources: DataFrame) -> DataFrame:
    """Distinct keys of stored, packed and buffered objects; packs themselves aren't listed."""
    keys = sources[0].select("key")
    for s in sources[1:]:
        keys = keys.union(s.select("key"))
    return keys.where(~F.col("key").startswith("packs/")).distinct()


def fragmentation(catalog: DataFrame, packs: DataFrame, max_waste: float = MAX_WASTE) -> DataFrame:
    """pack_ref, physical, active, wasted, action for every pack (pack_ref, size): delete without active bytes, repack above max_waste, else keep."""
    active = catalog.groupBy("pack_ref").agg(F.sum("length").alias("active"))
    joined = packs.select("pack_ref", F.col("size").alias("physical")).join(active, "pack_ref", "left").withColumn("active", F.coalesce("active", F.lit(0)).cast("long"))
    wasted = F.col("physical") - F.col("active")
    action = F.when(F.col("active") == 0, "delete").when((wasted > 0) & (wasted / F.col("physical") > max_waste), "repack").otherwise("keep")
    return joined.select("pack_ref", "physical", "active", wasted.alias("wasted"), action.alias("action"))


def repack_totals(fragmented: DataFrame) -> DataFrame:
    """One row: packs_deleted (repacked ones are deleted too) and bytes_reclaimed."""
    gone = F.col("action") != "keep"
    return fragmented.agg(F.count_if(gone).alias("packs_deleted"), F.coalesce(F.sum(F.when(F.col("action") == "delete", F.col("physical")).when(F.col("action") == "repack", F.col("wasted"))), F.lit(0)).cast("long").alias("bytes_reclaimed"))


def repacked_objects(catalog: DataFrame, fragmented: DataFrame) -> DataFrame:
    """Catalog rows whose objects move to new packs."""
    return catalog.join(fragmented.where("action = 'repack'").select("pack_ref"), "pack_ref", "left_semi")


def repack(catalog: DataFrame, packs: DataFrame, max_waste: float = MAX_WASTE, pack_size: int = PACK_SIZE) -> tuple[DataFrame, DataFrame]:
    """The catalog (key, pack_ref, offset, length) and the packs (pack_ref, data) after a repack.

    Packs without active bytes go; the active objects of those with too much waste move to new packs, which are named by
    the SHA-256 of their bytes; the others stay as they are. An object is read once, a new pack holds pack_size bytes and
    the rest of its last object.
    """
    plan = materialise(fragmentation(catalog, packs.select("pack_ref", F.octet_length("data").cast("long").alias("size")), max_waste))
    kept = plan.where("action = 'keep'").select("pack_ref")
    moved = read_packed(repacked_objects(catalog, plan), catalog, packs).withColumn("length", F.octet_length("data").cast("long"))
    placed = materialise(fixed_packs(moved, ["key"], "length", pack_size))
    bodies = placed.groupBy("pack").agg(F.array_sort(F.collect_list(part("offset", "data"))).alias("_parts")).select("pack", joined_bytes("_parts").alias("data"))
    bodies = materialise(bodies.withColumn("pack_ref", F.sha2("data", 256)))
    new_catalog = placed.join(bodies.select("pack", "pack_ref"), "pack").select("key", "pack_ref", "offset", "length")
    old_catalog = catalog.join(kept, "pack_ref", "left_semi").select("key", "pack_ref", "offset", "length")
    return old_catalog.union(new_catalog), packs.join(kept, "pack_ref", "left_semi").select("pack_ref", "data").union(bodies.select("pack_ref", "data"))


def objects(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, data of wanted keys; data is null for a key that isn't stored. Small lists of keys become a broadcast by their size."""
    return wanted.select("key").join(stored.select("key", "data"), "key", "left")


def reassemble(parts: DataFrame, content: str = "content_ref", position: str = "pos", data: str = "data") -> DataFrame:
    """content, text: parts joined in order. A content's parts meet in one row, so its size bounds the group."""
    gathered = parts.groupBy(content).agg(F.array_sort(F.collect_list(F.struct(position, data))).alias("_parts"))
    return gathered.select(content, F.array_join(F.transform("_parts", lambda p: p[data]), "").alias("text"))


def part(position: str, data: str) -> Column:
    """A part for joined_bytes(): its bytes as Latin-1 characters, as only texts are joined in one pass."""
    return F.struct(F.col(position).alias("pos"), F.decode(F.col(data), "ISO-8859-1").alias("text"))


def joined_bytes(parts: str) -> Column:
    """The bytes of an array of part(), in its order; work is linear in them."""
    return F.encode(F.array_join(F.transform(parts, lambda p: p["text"]), ""), "ISO-8859-1")
