"""A repository of snapshots on shared storage: the operators put together.

Tables are Parquet: snapshots, entries (by snapshot), files (metadata by reference), contents and chunks. Writers append
from the bottom up, chunks first and the snapshot's row last, so a reader never sees a snapshot that isn't complete, and
a run that fails leaves unreferenced rows, which prune() drops. Deleting writes the rows that stay into a new generation
of a table, names it, and removes the generations before it after a time of grace for readers. Writers hold locks: any
number may append, but nothing is dropped while one does.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashes import canonical_hash, content_ref
from tessera.lineage import materialise
from tessera.operators import chunking, graph, retention, snapshots, storage, versions
from tessera.operators.retention import Policy
from tessera.sources import restore

_TABLES = {
    "snapshots": "ref string, created timestamp_ntz, seq long, source struct<type:string,account:string,path:string,identity:string,path_id:string>, tags array<string>, change_token string, exclude_hash string, entries long",
    "entries": "snapshot string, file_id string, ref string",
    "files": "ref string, file_id string, name string, type string, parents array<string>, size long, mtime long, content_hash string, content_ref string",
    "contents": "content_ref string, pos int, chunk_ref string",
    "chunks": "chunk_ref string, size long, data binary",
}
#: A lock that is older is left over from a run that has died.
LOCK_SECONDS = 24 * 3600
_SOURCE = ("type", "account", "path", "identity", "path_id")
#: Columns of a listing given to backup(); content may be null for folders and empty files.
LISTING = ("file_id", "name", "type", "parents", "size", "mtime", "content")


class RepoLocked(RuntimeError):
    """Another writer is at work."""


class NeedsFullScan(LookupError):
    """There is no snapshot with a change token, or its exclude rules were others."""


class Repo:
    """key makes content references keyed hashes; chunk_sizes are minimal, normal and maximal bytes."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None, chunk_sizes: tuple[int, int, int] = chunking.SIZES) -> None:
        self.spark, self.path, self.key, self.chunk_sizes = spark, path.rstrip("/"), key, chunk_sizes

    # Tables

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _generation(self, name: str) -> int:
        fs, where = self._files(f"{self.path}/{name}/named")
        if not fs.exists(where):
            raise FileNotFoundError(f"{self.path} is not a repository; call init() first")
        return max(int(s.getPath().getName()) for s in fs.listStatus(where))

    def _name(self, name: str, generation: int) -> None:
        fs, where = self._files(f"{self.path}/{name}/named/{generation}")
        fs.create(where, True).close()

    def init(self) -> Repo:
        """Makes an empty repository; one that exists is an error."""
        fs, where = self._files(f"{self.path}/snapshots/named")
        if fs.exists(where):
            raise FileExistsError(self.path)
        for name, schema in _TABLES.items():
            self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}/0")
            self._name(name, 0)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}/{self._generation(name)}")

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in _TABLES[name].split(", ") if not c.startswith(("account", "path:"))]
        rows.select(*columns).write.mode("append").parquet(f"{self.path}/{name}/{self._generation(name)}")

    def _replace(self, name: str, rows: DataFrame) -> None:
        generation = self._generation(name) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{generation}")
        self._name(name, generation)

    @contextmanager
    def _lock(self, exclusive: bool) -> Iterator[None]:
        """Shared locks go together; an exclusive one goes with no other. The own lock is written before others are looked for, so of two at once at least one gives way."""
        name = f"{'exclusive' if exclusive else 'shared'}-{uuid.uuid4().hex}"
        fs, folder = self._files(f"{self.path}/locks")
        _, own = self._files(f"{self.path}/locks/{name}")
        fs.create(own, False).close()
        try:
            for s in fs.listStatus(folder):
                other, age = s.getPath().getName(), time.time() - s.getModificationTime() / 1000
                if other != name and age < LOCK_SECONDS and (exclusive or other.startswith("exclusive")):
                    raise RepoLocked(f"{self.path} is in use by {other}, since {age:.0f} s")
            yield
        finally:
            fs.delete(own, False)

    def _bytes(self) -> int:
        fs, where = self._files(self.path)
        return int(fs.getContentSummary(where).getLength())

    def _drop_superseded(self, grace_seconds: float) -> None:
        """Deletes generations of tables that were replaced at least so many seconds ago."""
        for name in _TABLES:
            fs, named = self._files(f"{self.path}/{name}/named")
            since = {int(s.getPath().getName()): s.getModificationTime() / 1000 for s in fs.listStatus(named)}
            for generation in sorted(since)[:-1]:
                replaced = since[min(g for g in since if g > generation)]
                if time.time() - replaced >= grace_seconds:
                    fs.delete(self._files(f"{self.path}/{name}/{generation}")[1], True)
                    fs.delete(self._files(f"{self.path}/{name}/named/{generation}")[1], False)

    # Writing

    def backup(self, listing: DataFrame, source: dict[str, str], created: str, tags: list[str] | None = None, change_token: str | None = None, exclude_hash: str | None = None) -> DataFrame:
        """Commits a listing (columns LISTING) as a snapshot of source; one row: the counts of backup_stats() and the snapshot's ref.

        Nothing is written for files that are unmodified, and no snapshot if nothing differs from the one before.
        """
        with self._lock(exclusive=False):
            files = self._described(listing)
            before = self.entries(self._previous(source))
            gone = versions.removed(files, self._known(before))
            return self._commit(versions.classify(files, before), gone, files.select("file_id", "ref"), source, created, tags, change_token, exclude_hash)

    def change_token(self, source: dict[str, str], exclude_hash: str | None = None) -> str | None:
        """Where the change feed of source goes on after its last snapshot; null if a full scan is needed."""
        last = self.snapshots().where(F.col("ref") == (self._previous(source) or "")).select("change_token", "exclude_hash").first()
        return None if last is None or versions.needs_full_scan(last["change_token"], last["exclude_hash"], exclude_hash) else last["change_token"]

    def backup_changes(self, changes: DataFrame, source: dict[str, str], created: str, change_token: str, order: str = "seq", tags: list[str] | None = None, exclude_hash: str | None = None) -> DataFrame:
        """Commits the changes since the last snapshot of source: columns op (upsert or delete), order, and LISTING (null for a delete).

        The last change of each file counts, so parents may come after their children. The entries of the snapshot are
        those of the one before, less what changed, plus the upserts; only changed files are described and written. The
        new token is kept with the snapshot. Without a token to go on from this is NeedsFullScan; see change_token().
        """
        with self._lock(exclusive=False):
            if self.change_token(source, exclude_hash) is None:
                raise NeedsFullScan(f"there is no change token of {source}")
            last = materialise(versions.latest_changes(changes.select("op", order, *LISTING), "file_id", [order]))
            before = self.entries(self._previous(source))
            files = self._described(last.where("op <> 'delete'"))
            touched = last.select("file_id")
            gone = self._known(before.join(last.where("op = 'delete'").select("file_id"), "file_id", "left_semi"))
            entries = before.join(touched, "file_id", "left_anti").union(files.select("file_id", "ref"))
            return self._commit(versions.classify(files, before), gone, entries, source, created, tags, change_token, exclude_hash)

    def _described(self, listing: DataFrame) -> DataFrame:
        """A listing with content_hash, content_ref and ref."""
        files = listing.select(*LISTING).withColumn("content_hash", F.when(F.col("content").isNull(), "").otherwise(F.sha2("content", 256)))
        files = files.withColumn("content_ref", F.when(F.col("content_hash") == "", "").otherwise(content_ref(F.col("content_hash"), self.key)))
        return materialise(files.withColumn("ref", canonical_hash(**{c: F.col(c) for c in (*LISTING[:-1], "content_hash", "content_ref")})))

    def _known(self, entries: DataFrame) -> DataFrame:
        return entries.join(self.table("files").select("ref", "type").dropDuplicates(["ref"]), "ref")

    def _commit(self, classified: DataFrame, gone: DataFrame, entries: DataFrame, source: dict[str, str], created: str, tags: list[str] | None, change_token: str | None, exclude_hash: str | None) -> DataFrame:
        stats = materialise(versions.backup_stats(classified, gone))
        row = stats.first()
        if row["processed"] == row["files_unmodified"] + row["dirs_unmodified"] and not row["files_removed"] + row["dirs_removed"] and self._previous(source) is not None:
            return stats.withColumn("ref", F.lit(None).cast("string"))
        changed = classified.where("status <> 'unmodified'")
        new = storage.new_objects(changed.where("content_ref <> ''"), self.table("contents"), "content_ref")
        parts = materialise(chunking.chunks(new, "content_ref", "content", self.chunk_sizes))
        self._append("chunks", storage.new_objects(parts, self.table("chunks"), "chunk_ref"))
        self._append("contents", parts.withColumnRenamed("id", "content_ref"))
        self._append("files", storage.new_objects(changed, self.table("files"), "ref"))
        ref, entries = f"snapshot/{uuid.uuid4().hex}", materialise(entries)
        self._append("entries", entries.select(F.lit(ref).alias("snapshot"), "file_id", "ref"))
        head = snapshots.next_sequence(self.snapshots()).select(
            F.lit(ref).alias("ref"), F.lit(created).cast("timestamp_ntz").alias("created"), F.col("next_seq").alias("seq"), F.struct(*[F.lit(source.get(k, "")).alias(k) for k in _SOURCE]).alias("source"),
            F.array(*map(F.lit, tags or [])).cast("array<string>").alias("tags"), F.lit(change_token).cast("string").alias("change_token"), F.lit(exclude_hash).cast("string").alias("exclude_hash"), F.lit(entries.count()).cast("long").alias("entries"),
        )
        self._append("snapshots", head.coalesce(1))
        return stats.withColumn("ref", F.lit(ref))

    def _previous(self, source: dict[str, str]) -> str | None:
        wanted = self.spark.range(1).select(F.lit("x").alias("id"), *[F.lit(source.get(k, "")).alias(k) for k in _SOURCE])
        return snapshots.previous(self.snapshots(), wanted).first()["ref"]

    # Reading

    def snapshots(self) -> DataFrame:
        return self.table("snapshots")

    def resolve(self, snapshot: str = "latest") -> str:
        """The ref of "latest", a bare or a full id."""
        if snapshot in ("", "latest"):
            found = snapshots.latest(self.snapshots()).first()
            if found is None:
                raise LookupError("there is no snapshot")
            return found["ref"]
        ref = snapshot if snapshot.startswith("snapshot/") else f"snapshot/{snapshot}"
        if self.snapshots().where(F.col("ref") == ref).isEmpty():
            raise LookupError(f"there is no snapshot {snapshot}")
        return ref

    def entries(self, ref: str | None) -> DataFrame:
        return self.table("entries").where(F.col("snapshot") == ref if ref is not None else F.lit(False)).select("file_id", "ref")

    def tree(self, snapshot: str = "latest") -> DataFrame:
        """Files of a snapshot with path and depth, parents first."""
        files = self.table("files").dropDuplicates(["ref"]).drop("file_id")
        return graph.topological(self.entries(self.resolve(snapshot)).join(files, "ref"))

    def diff(self, a: str, b: str = "latest") -> DataFrame:
        """change, path of what differs between two snapshots, by path."""
        left, right = self.resolve(a), self.resolve(b)
        changes = versions.diff(self.entries(left), self.entries(right))
        old, new = (self.tree(r).select("file_id", F.col("path").alias(n)) for r, n in ((left, "_old"), (right, "_new")))
        named = changes.join(old, "file_id", "left").join(new, "file_id", "left")
        return named.select("change", F.coalesce("_new", "_old").alias("path"), "file_id").orderBy("path")

    def restore(self, snapshot: str = "latest", path: str = "") -> DataFrame:
        """path, type, size, mtime, content of a path, all below it and its ancestors; for restore_to_folder() or restore_to_zip()."""
        chosen = graph.restore_selection(self.tree(snapshot).drop("path", "depth"), path)
        parts = self._parts(chosen)
        bodies = parts.groupBy("content_ref").agg(F.array_sort(F.collect_list(storage.part("pos", "data"))).alias("p"))
        bodies = bodies.select("content_ref", storage.joined_bytes("p").alias("content"))
        return chosen.join(bodies, "content_ref", "left").select("path", "type", "size", "mtime", "content")

    def _parts(self, files: DataFrame) -> DataFrame:
        parts = self.table("contents").join(files.select("content_ref").distinct(), "content_ref", "left_semi").dropDuplicates(["content_ref", "pos"])
        return parts.join(self.table("chunks").dropDuplicates(["chunk_ref"]), "chunk_ref")

    def restore_to_folder(self, root: str, snapshot: str = "latest", path: str = "", overwrite: bool = False) -> DataFrame:
        """Writes what restore() gives below root, a folder that all executors mount, chunk by chunk, so a file may have any size; path, state.

        Folders are made first, and get their times last, when nothing is written into them any more.
        """
        chosen = graph.restore_selection(self.tree(snapshot).drop("path", "depth"), path)
        files = chosen.where("type <> 'folder'").select("path", "mtime", "content_ref")
        parts = files.join(self._parts(files).select("content_ref", "pos", "data"), "content_ref", "left")
        return restore.restore_parts(parts, chosen.where("type = 'folder'").select("path", "mtime"), root, overwrite)

    def objects(self, keys: DataFrame) -> DataFrame:
        """key, data of chunks by "chunk/<ref>" keys; data is null for one that isn't stored."""
        stored = self.table("chunks").select(F.concat(F.lit("chunk/"), "chunk_ref").alias("key"), "data").dropDuplicates(["key"])
        return storage.objects(stored, keys)

    # Deleting

    def policy(self, policy: Policy, group_by: str | None = None, **filters) -> DataFrame:
        """ref, kept, reasons and group of the snapshots that the filters match; nothing is deleted."""
        keys = snapshots.group_columns(group_by)
        rows = self.snapshots()
        for n, c in keys.items():
            rows = rows.withColumn(f"group_{n}", c)
        chosen = snapshots.matches(**filters) if filters else None
        return retention.forget(rows, policy, [f"group_{n}" for n in keys], chosen).select("ref", "kept", "reasons", *[f"group_{n}" for n in keys])

    def forget(self, refs: DataFrame) -> None:
        """Drops snapshots (column ref) from the catalog; prune() frees what only they used."""
        with self._lock(exclusive=True):
            self._replace("snapshots", materialise(snapshots.remove_summaries(self.snapshots(), refs)))

    def prune(self, dry_run: bool = False, grace_seconds: float = 0.0) -> DataFrame:
        """Drops all that no snapshot reaches; one row: scanned, deleted, bytes_reclaimed of chunks, and freed_bytes on the store.

        dry_run: nothing is dropped, the counts say what would be. grace_seconds: generations replaced so recently stay for
        readers, and a later prune() deletes them.
        """
        with self._lock(exclusive=True):
            entries = materialise(self.table("entries").join(self.snapshots().select(F.col("ref").alias("snapshot")), "snapshot", "left_semi"))
            files = materialise(self.table("files").dropDuplicates(["ref"]).join(entries.select("ref"), "ref", "left_semi"))
            contents = materialise(self.table("contents").dropDuplicates(["content_ref", "pos"]).join(files.select("content_ref"), "content_ref", "left_semi"))
            live = contents.select(F.col("chunk_ref").alias("key")).distinct()
            totals = materialise(graph.prune_totals(self.table("chunks").select(F.col("chunk_ref").alias("key"), "size"), live))
            if dry_run:
                return totals.withColumn("freed_bytes", F.lit(0).cast("long"))
            before = self._bytes()
            chunks = self.table("chunks").dropDuplicates(["chunk_ref"]).join(live.withColumnRenamed("key", "chunk_ref"), "chunk_ref", "left_semi")
            for name, rows in (("entries", entries), ("files", files), ("contents", contents), ("chunks", chunks)):
                self._replace(name, rows)
            self._drop_superseded(grace_seconds)
            return totals.withColumn("freed_bytes", F.lit(before - self._bytes()).cast("long"))

    def check(self, read_data: bool = False) -> DataFrame:
        """key, type, message of damaged references: missing metadata, contents and chunks; contents whose parts have gaps; with
        read_data also metadata and chunks whose fields or bytes have another hash than their name.
        """
        files, contents, chunks = self.table("files"), self.table("contents"), self.table("chunks")
        live = self.table("entries").join(self.snapshots().select(F.col("ref").alias("snapshot")), "snapshot", "left_semi")
        used = files.join(live.select("ref"), "ref", "left_semi")
        edges = ((live.select(F.col("ref").alias("dst")), files.select("ref"), "ref", "filemeta/"), (used.where("content_ref <> '' and size > 0").select(F.col("content_ref").alias("dst")), contents.select("content_ref"), "content_ref", "content/"), (contents.select(F.col("chunk_ref").alias("dst")), chunks.select("chunk_ref"), "chunk_ref", "chunk/"))
        errors = None
        for refs, stored, column, prefix in edges:
            found = graph.missing(refs, stored, column).withColumn(column, F.concat(F.lit(prefix), column)).withColumnRenamed(column, "key")
            errors = found if errors is None else errors.union(found)
        wanted = contents.join(used.select("content_ref"), "content_ref", "left_semi").groupBy("content_ref").agg(F.max("pos").alias("last"), F.count_distinct("pos").alias("n"))
        errors = errors.union(wanted.where("n <> last + 1").select(F.concat(F.lit("content/"), "content_ref").alias("key"), F.lit("parse"), F.format_string("%d parts, the last is number %d", "n", "last")))
        if read_data:
            named = canonical_hash(**{c: F.col(c) for c in (*LISTING[:-1], "content_hash", "content_ref")})
            errors = errors.union(used.where(F.col("ref") != named).select(F.concat(F.lit("filemeta/"), "ref").alias("key"), F.lit("corrupt"), F.concat(F.lit("the fields have the hash "), named)))
            errors = errors.union(graph.corrupt(chunks.select(F.concat(F.lit("chunk/"), "chunk_ref").alias("key"), "data")).distinct())
        return errors
