"""Listings of local folders and cloud drives as tables of file metadata."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ancestors, base_name, epoch_seconds, is_native_document, native_export, normalize_path, parent_path, strip_drive_root, unescape_octal
from tessera.lineage import materialise
from tessera.operators.exclude import exclude, excluded, parse_rules

#: Fixed value: an attribute that systems set on their own.
SKIPPED_XATTRS = ("com.apple.provenance",)
_FOLDER = "application/vnd.google-apps.folder"


_FOUND = "path string, is_folder boolean, size long, mtime long, mode int, uid long, gid long, xattrs map<string,string>"


def _scanner(root: str, with_xattrs: bool):
    def attributes(path: str) -> list[tuple[str, str]] | None:
        if not with_xattrs:
            return None
        try:
            return [(n, base64.b64encode(os.getxattr(path, n, follow_symlinks=False)).decode()) for n in sorted(os.listxattr(path, follow_symlinks=False))]
        except OSError:  # a file system without attributes, or a file that has gone
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()))
        names = ("path", "is_folder", "size", "mtime", "mode", "uid", "gid", "xattrs")
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        at = e.stat(follow_symlinks=False)
                        rows.append((f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False), at.st_size, int(at.st_mtime), at.st_mode & 0o7777, at.st_uid, at.st_gid, attributes(e.path)))
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def _walked(spark: SparkSession, root: str, rules: list, with_xattrs: bool) -> DataFrame:
    """All entries below a folder that executors mount, level by level: a task lists its folders, hidden and empty ones too.

    An excluded folder isn't entered, symbolic links aren't followed.
    """
    frontier, levels = spark.range(1).select(F.lit("").alias("path")), []
    while True:
        found = materialise(frontier.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_scanner(root, with_xattrs), _FOUND))
        levels.append(found)
        frontier = found.where("is_folder").select("path")
        if rules:
            frontier = frontier.where(~excluded(rules, F.col("path"), F.lit(True)))
        if frontier.isEmpty():
            return reduce(DataFrame.union, levels)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """The same for other file systems, through Hadoop's listing on the driver, as Spark's own readers do it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(where).toString().rstrip("/") + "/"
    rows, todo = [], [where]
    while todo:
        for s in fs.listStatus(todo.pop()):
            rows.append((s.getPath().toString()[len(base) :], s.isDirectory(), s.getLen(), s.getModificationTime() // 1000, int(s.getPermission().toShort()), None, None, None))
            if s.isDirectory():
                todo.append(s.getPath())
    return spark.createDataFrame(rows, _FOUND)


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, folder) in enumerate(zip(batch.column("path").to_pylist(), batch.column("is_folder").to_pylist(), strict=True)):
                body = None
                if not folder:
                    with open(os.path.join(root, path), "rb") as f:
                        body = f.read()
                one = batch.slice(i, 1)  # one file at a time
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([body], pa.binary())], names=[*one.schema.names, "content"])

    return run


def local_files(spark: SparkSession, root: str, patterns: Iterable[str] = (), with_content: bool = False, with_metadata: bool = False, namespaces: Iterable[str] = ()) -> DataFrame:
    """file_id (path below root), name, type, parents, size, mtime of all files and folders under root, without excluded ones.

    Hidden files and empty folders are listed too. with_content adds content, read by executors; with_metadata adds mode,
    uid, gid and xattrs (those of the namespaces, all if none is given; values in base64).
    """
    rules = parse_rules(patterns)
    folder = root.removeprefix("file://").removeprefix("file:")
    local = "://" not in folder
    found = _walked(spark, folder, rules, with_metadata) if local else _listed(spark, root)
    kept = exclude(found, rules) if rules else found
    more: list[Column | str] = []
    if with_content:
        if not local:
            raise ValueError("content is read from folders that executors mount; read other file systems with spark.read.format('binaryFile')")
        kept = kept.mapInArrow(_reader(folder), _FOUND + ", content binary")
        more.append("content")
    if with_metadata:
        more += ["mode", "uid", "gid", collected_xattrs(F.col("xattrs"), namespaces).alias("xattrs")]
    parent = parent_path(F.col("path"))
    parents = F.when(parent == "", F.array().cast("array<string>")).otherwise(F.array(parent))
    return kept.select(F.col("path").alias("file_id"), base_name(F.col("path")).alias("name"), F.when(F.col("is_folder"), "folder").otherwise("file").alias("type"), parents.alias("parents"), "size", "mtime", *more)


def source_size(files: DataFrame) -> DataFrame:
    """One row: bytes and number of files; folders don't count."""
    return files.where("type <> 'folder'").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files"))


def excluded_size(files: DataFrame, patterns: Iterable[str], path: str = "path") -> DataFrame:
    """source_size() of files whose own path no pattern excludes."""
    return source_size(files.where(~excluded(parse_rules(patterns), F.col(path), F.col("type") == "folder")))


def collected_xattrs(xattrs: Column, namespaces: Iterable[str] = ()) -> Column:
    """Attributes of the namespaces (all, if none is given), without those that systems set on their own."""
    spaces = list(namespaces)

    def wanted(name: Column, _: Column) -> Column:
        inside = F.lit(not spaces)
        for s in spaces:
            inside = inside | name.startswith(s)
        return ~name.isin(*SKIPPED_XATTRS) & inside

    return F.map_filter(xattrs, wanted)


def drive_files(items: DataFrame) -> DataFrame:
    """File metadata of items (id, name, mimeType, parents, sha256Checksum, size, modifiedTime, owners, headRevisionId).

    Native documents are named and typed as they are exported; a time that doesn't parse is 0.
    """
    mime = F.col("mimeType")
    export = native_export(mime)
    revision = F.coalesce("headRevisionId", F.lit(""))
    extra = F.map_filter(F.create_map(F.lit("mimeType"), mime, F.lit("exportMimeType"), export["mime"], F.lit("headRevisionId"), F.nullif(revision, F.lit(""))), lambda _, v: v.isNotNull())
    return items.select(
        F.col("id").alias("file_id"), F.concat("name", F.coalesce(export["extension"], F.lit(""))).alias("name"), F.when(mime == _FOLDER, "folder").otherwise("file").alias("type"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"),
        F.coalesce("sha256Checksum", F.lit("")).alias("content_hash"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce(epoch_seconds(F.col("modifiedTime")), F.lit(0)).cast("long").alias("mtime"),
        F.coalesce(F.get("owners", F.lit(0))["emailAddress"], F.lit("")).alias("owner"), extra.alias("extra"), is_native_document(mime).alias("native"),
    )


def graph_files(items: DataFrame) -> DataFrame:
    """File metadata and operation of delta items (id, name, size, lastModifiedDateTime, file, folder, package, deleted, parentReference (id, path)).

    Packages are skipped; a deleted item is a delete, others upserts with their path below the drive's root.
    """
    gone, folder = F.col("deleted").isNotNull(), F.col("folder").isNotNull()
    above = strip_drive_root(F.col("parentReference.path"))
    path = F.when(above.isNull(), None).when(above == "", F.col("name")).otherwise(F.concat_ws("/", above, "name"))
    parent = F.coalesce("parentReference.id", F.lit(""))
    kept = items.where(gone | (F.col("package").isNull() & (F.col("file").isNotNull() | folder)))
    return kept.select(
        F.when(gone, "delete").otherwise("upsert").alias("op"), F.col("id").alias("file_id"), F.when(~gone, F.col("name")).alias("name"), F.when(~gone, F.when(folder, "folder").otherwise("file")).alias("type"),
        F.when(parent == "", F.array().cast("array<string>")).otherwise(F.array(parent)).alias("parents"), F.when(~gone, path).alias("path"), F.when(~gone, F.coalesce("size", F.lit(0))).cast("long").alias("size"),
        F.when(~gone, F.coalesce(epoch_seconds(F.col("lastModifiedDateTime")), F.lit(0))).cast("long").alias("mtime"),
    )


def below_root(changes: DataFrame, root: str) -> DataFrame:
    """Changes (op, path) below a root folder, with paths from there; the root itself and upserts without a path are dropped, deletes without one stay."""
    base = "/".join(p for p in root.split("/") if p)
    if not base:
        return changes
    path = F.col("path")
    inside = F.coalesce(path.startswith(base + "/"), F.lit(False)) | (path.isNull() & (F.col("op") == "delete"))
    return changes.where(inside).withColumn("path", F.expr(f"substring(path, {len(base) + 2})"))


def mounts(lines: DataFrame) -> DataFrame:
    """mount, portable of a mount table (text column value: device mount type ...; optional portable), one row per mount."""
    fields = F.split("value", r"\s+")
    portable = F.col("portable") if "portable" in lines.columns else F.lit(False)
    mount = F.concat(F.lit("/"), normalize_path(unescape_octal(F.get(fields, F.lit(1)))))
    return lines.select(mount.alias("mount"), portable.alias("portable")).where("mount is not null").groupBy("mount").agg(F.bool_or("portable").alias("portable")).orderBy("mount")


def parse_source(uri: str) -> dict[str, str]:
    """scheme, host, user, port and path of a source address, on the driver; an unknown or incomplete one is an error."""
    from urllib.parse import urlsplit

    from tessera.operators.dashboard import PROVIDERS

    if uri.startswith("sftp://"):
        u = urlsplit(uri)
        if not u.hostname:
            raise ValueError(f"{uri!r} has no host")
        return {"scheme": "sftp", "host": u.hostname, "user": u.username or "", "port": str(u.port or ""), "path": u.path}
    scheme, colon, rest = uri.partition(":")
    if scheme == "local" and rest:
        return {"scheme": scheme, "host": "", "user": "", "port": "", "path": rest}
    if scheme not in PROVIDERS:
        raise ValueError(f"{uri!r} is not the address of a source")
    host, path = "", rest
    if rest.startswith("//"):
        host, _, path = rest[2:].partition("/")
    return {"scheme": scheme, "host": host, "user": "", "port": "", "path": path if path.startswith("/") else f"/{path}"}
