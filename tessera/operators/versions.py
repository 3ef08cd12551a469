"""Comparing two versions of a keyed collection, and applying changes to one.

Versions are joined on the file id alone, by one equi-join: a moved file is modified, not removed and added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashes import map_equal
from tessera.functions.text import is_native_document

#: Fields that say whether metadata without a content hash is unchanged; parents count by number only.
PLAIN_FIELDS = ("name", "size", "mtime", "type", "mode", "uid", "gid", "btime", "flags")


def metadata_equal(a: str, b: str) -> Column:
    """Equality of two file metadata records, given by the names of struct columns or aliases."""
    same = F.size(F.coalesce(F.col(f"{a}.parents"), F.array())) == F.size(F.coalesce(F.col(f"{b}.parents"), F.array()))
    for f in PLAIN_FIELDS:
        same = same & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return same & map_equal(F.col(f"{a}.xattrs"), F.col(f"{b}.xattrs"))


def classify(current: DataFrame, previous: DataFrame, key: str = "file_id", ref: str = "ref") -> DataFrame:
    """current with status: new, changed or unmodified, by the reference of its record in previous."""
    before = previous.select(F.col(key).alias("_key"), F.col(ref).alias("previous_ref"), F.lit(True).alias("_known"))
    joined = current.join(before, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_known").isNull(), "new").when(F.col(ref).eqNullSafe(F.col("previous_ref")), "unmodified").otherwise("changed")
    return joined.withColumn("status", status).drop("_key", "_known")


def classify_metadata(current: DataFrame, previous: DataFrame) -> DataFrame:
    """classify() for full metadata: file_id, status, content_hash, content_ref.

    Native documents are unmodified if they have the same, non-empty head revision. A record without a content hash but
    equal metadata takes over the old content; one with the old hash and no reference takes over the reference.
    """
    joined = current.alias("a").join(previous.alias("b"), F.col("a.file_id") == F.col("b.file_id"), "left")
    native = is_native_document(F.col("a.extra")["mimeType"])
    revision, old = F.coalesce(F.col("a.extra")["headRevisionId"], F.lit("")), F.col("b.extra")["headRevisionId"]
    no_hash = (F.coalesce("a.content_hash", F.lit("")) == "") & (F.coalesce("b.content_hash", F.lit("")) != "") & metadata_equal("a", "b")
    same_hash = (F.col("a.content_hash") == F.col("b.content_hash")) & (F.coalesce("a.content_ref", F.lit("")) == "")
    native_same = native & (revision != "") & revision.eqNullSafe(old)
    take_hash = native_same | no_hash
    content_hash = F.when(take_hash, F.col("b.content_hash")).otherwise(F.col("a.content_hash"))
    content_ref = F.when(take_hash | same_hash, F.col("b.content_ref")).otherwise(F.col("a.content_ref"))
    equal = metadata_equal("a", "b") & content_hash.eqNullSafe(F.col("b.content_hash")) & content_ref.eqNullSafe(F.col("b.content_ref"))
    status = F.when(F.col("b.file_id").isNull(), "new").when(native, F.when(native_same, "unmodified").otherwise("changed")).when(equal, "unmodified").otherwise("changed")
    return joined.select(F.col("a.file_id").alias("file_id"), status.alias("status"), content_hash.alias("content_hash"), content_ref.alias("content_ref"))


def removed(current: DataFrame, previous: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of previous whose key current lacks; an empty current removes all."""
    return previous.join(current.select(key), key, "left_anti")


def diff(a: DataFrame, b: DataFrame, key: str = "file_id", ref: str = "ref") -> DataFrame:
    """key, change (A, D or M), old_ref, new_ref of entries that differ between versions a and b."""
    left = a.select(F.col(key).alias("_a"), F.col(ref).alias("old_ref"))
    right = b.select(F.col(key).alias("_b"), F.col(ref).alias("new_ref"))
    joined = left.join(right, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").otherwise("M")
    differs = F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old_ref").eqNullSafe(F.col("new_ref"))
    return joined.where(differs).select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "old_ref", "new_ref")


def backup_stats(classified: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: files and dirs that are new, changed, unmodified, removed, and processed (all but removed). Both need type."""
    rows = classified.select("type", "status").union(gone.select("type", F.lit("removed")))
    folder = F.col("type") == "folder"
    count = lambda kind, status: F.count_if((folder if kind == "dirs" else ~folder) & (F.col("status") == status)).alias(f"{kind}_{status}")
    columns = [count(k, s) for k in ("files", "dirs") for s in ("new", "changed", "unmodified", "removed")]
    return rows.agg(*columns, F.count_if(F.col("status") != "removed").alias("processed"))


def cdc_operation(deleted: Column, payload: Column, trashed: Column) -> Column:
    """delete where the record is gone, empty or in the trash, else upsert."""
    return F.when(F.coalesce(deleted, F.lit(False)) | payload.isNull() | F.coalesce(trashed, F.lit(False)), "delete").otherwise("upsert")


def latest_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of every key."""
    values = [c for c in changes.columns if c != key]
    packed = changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return packed.select(key, *[F.col(f"_last.{c}").alias(c) for c in values])


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: list[str], op: str = "op") -> DataFrame:
    """state after an upsert/delete feed: per key the last change by order wins. Columns of state."""
    last = latest_changes(changes, key, order)
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*state.columns))


def resequence(changes: DataFrame, key: str, order: list[str], seq: str = "seq") -> DataFrame:
    """Changes numbered from 1 inside each key."""
    return changes.withColumn(seq, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def version_fingerprint(version: DataFrame, key: str = "file_id", ref: str = "ref") -> DataFrame:
    """One row that is equal for equal versions whatever their order: entries and a sum of hashes. Equal roots skip a commit."""
    return version.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.xxhash64(key, ref).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def needs_full_scan(token: str | None, old_rules: str | None, new_rules: str | None) -> bool:
    """Whether an incremental run is impossible: no change token, or other exclude rules than last time."""
    return not token or (old_rules or "") != (new_rules or "")
