"""Writing restored files: a folder on shared storage, or one archive."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Row

from tessera.lineage import materialise


def safe_path(root: str, path: str) -> str:
    """root/path; an absolute path, one that leaves root, or one through a symbolic link is an error."""
    parts = PurePosixPath(path.replace("\\", "/")).parts
    if not parts or path.startswith("/") or ".." in parts:
        raise ValueError(f"{path!r} leaves the folder")
    target = root
    for part in parts:
        target = os.path.join(target, part)
        if os.path.islink(target):
            raise ValueError(f"{path!r} passes a symbolic link")
    return target


def restore_to_folder(files: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Writes files (path, type, content, mtime) below root, a folder that all executors mount; returns path, state (written or skipped).

    Each task writes its rows through a temporary name, so a task that is run again leaves whole files.
    """

    def write(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            out = []
            for path, kind, body, mtime in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = safe_path(root, path)
                if kind == "folder":
                    os.makedirs(target, exist_ok=True)
                elif os.path.exists(target) and not overwrite:
                    out.append((path, "skipped"))
                    continue
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(part := f"{target}.part-{os.getpid()}", "wb") as f:
                        f.write(body or b"")
                    os.replace(part, target)
                    if mtime is not None:
                        os.utime(target, (mtime, mtime))
                out.append((path, "written"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["path", "state"])

    return files.selectExpr("path", "type", "cast(content as binary) content", "cast(mtime as long) mtime").mapInArrow(write, "path string, state string")


def _batched(paths: list[str], state: str):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([state] * len(paths), pa.string())], names=["path", "state"])


def restore_parts(parts: DataFrame, folders: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Writes files given as parts (path, pos, data, mtime; a file without parts has one row of nulls) and folders (path, mtime) below root; path, state.

    A file's parts meet in one task in their order and are appended to a temporary name, one at a time, so a file of any
    size streams through, and a task that is run again leaves whole files. Folders get their times last.
    """

    def make(batches: Iterator) -> Iterator:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path in paths:
                os.makedirs(safe_path(root, path), exist_ok=True)
            yield _batched(paths, "written")

    def append(batches: Iterator) -> Iterator:
        at, out, target, when, states = None, None, "", None, {"written": [], "skipped": []}

        def finish() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, target)
                if when is not None:
                    os.utime(target, (when, when))

        for batch in batches:
            for i, (path, mtime) in enumerate(zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist(), strict=True)):
                if path != at:
                    finish()
                    at, target, when, out = path, safe_path(root, path), mtime, None
                    skipped = os.path.exists(target) and not overwrite
                    states["skipped" if skipped else "written"].append(path)
                    if not skipped:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        out = open(f"{target}.part-{os.getpid()}", "wb")  # noqa: SIM115
                if out is not None:
                    out.write(batch.column("data")[i].as_py() or b"")
        finish()
        for state, paths in states.items():
            yield _batched(paths, state)

    def stamp(batches: Iterator) -> Iterator:
        for batch in batches:
            for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist(), strict=True):
                if mtime is not None:
                    os.utime(safe_path(root, path), (mtime, mtime))
            yield _batched(batch.column("path").to_pylist(), "written")

    os.makedirs(root, exist_ok=True)
    schema = "path string, state string"
    folders = materialise(folders.selectExpr("path", "cast(mtime as long) mtime"))
    materialise(folders.mapInArrow(make, schema))
    rows = parts.selectExpr("path", "cast(mtime as long) mtime", "cast(pos as int) pos", "cast(data as binary) data").repartition("path").sortWithinPartitions("path", "pos")
    written = materialise(rows.mapInArrow(append, schema))
    return materialise(written.union(folders.mapInArrow(stamp, schema)))


def restore_to_zip(files: DataFrame, target: str) -> int:
    """Writes files (path, type, content) in path order into one archive on the driver; one partition of rows is held at a time."""
    count = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        row: Row
        for row in files.select("path", "type", "content").orderBy("path").toLocalIterator():
            safe_path("/", row["path"])
            archive.writestr(row["path"] + "/" * (row["type"] == "folder"), b"" if row["type"] == "folder" else bytes(row["content"] or b""))
            count += 1
    return count
