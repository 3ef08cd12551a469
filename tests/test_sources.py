import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import versions
from tessera.sources import listing, restore
from tessera.streaming.changes import ChangeState


def test_local_files(spark, tmp_path):
    for name, body in {"a.txt": "1", "sub/b.log": "22", "sub/deep/c.txt": "333", "skip/d.txt": "4"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r["file_id"]: (r["type"], r["parents"], r["size"] * (r["type"] == "file")) for r in listing.local_files(spark, str(tmp_path), ["*.log", "skip/"]).collect()}
    assert got == {"a.txt": ("file", [], 1), "sub": ("folder", [], 0), "sub/deep": ("folder", ["sub"], 0), "sub/deep/c.txt": ("file", ["sub/deep"], 3)}
    files = listing.local_files(spark, str(tmp_path), with_content=True)
    assert tuple(listing.source_size(files).first()) == (7, 4)
    assert bytes(files.where("file_id = 'sub/b.log'").first()["content"]) == b"22"


def test_local_files_lists_hidden_files_and_empty_folders(spark, tmp_path):
    for name in ("a/x.txt", ".bashrc", "_private.txt", ".git/config", "a/_y"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty/sub").mkdir(parents=True)
    os.symlink(str(tmp_path / "a"), str(tmp_path / "link"))
    os.chmod(tmp_path / "a/x.txt", 0o640)
    files = listing.local_files(spark, str(tmp_path), with_metadata=True).collect()
    assert {r["file_id"]: r["type"] for r in files} == {"a": "folder", "a/x.txt": "file", ".bashrc": "file", "_private.txt": "file", ".git": "folder", ".git/config": "file", "a/_y": "file", "empty": "folder", "empty/sub": "folder", "link": "file"}
    assert {r["file_id"]: r["mode"] for r in files}["a/x.txt"] == 0o640 and all(r["mtime"] for r in files)
    other = listing._listed(spark, f"file://{tmp_path}")
    assert {r["path"] for r in other.collect()} >= {r["file_id"] for r in files} - {"link"}


def test_restore_to_folder_and_zip(spark, tmp_path):
    rows = [("d", "folder", None, None), ("d/x.txt", "file", b"hello", 1_000_000_000), ("y.txt", "file", b"", None)]
    files = spark.createDataFrame(rows, "path string, type string, content binary, mtime long")
    root = str(tmp_path / "out")
    assert {r["state"] for r in restore.restore_to_folder(files, root).collect()} == {"written"}
    assert open(f"{root}/d/x.txt", "rb").read() == b"hello" and os.stat(f"{root}/d/x.txt").st_mtime == 1_000_000_000
    assert {r["path"]: r["state"] for r in restore.restore_to_folder(files, root).collect()}["d/x.txt"] == "skipped"
    assert restore.restore_to_zip(files, str(tmp_path / "a.zip")) == 3
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.namelist() == ["d/", "d/x.txt", "y.txt"] and z.read("d/x.txt") == b"hello"
    os.symlink("/tmp", f"{root}/link")
    for bad in ("../x", "/etc/x", "a/../../x", "", "link/x"):
        with pytest.raises(ValueError):
            restore.safe_path(root, bad)


def test_drive_items(spark):
    schema = "id string, name string, mimeType string, parents array<string>, sha256Checksum string, size long, modifiedTime string, owners array<struct<emailAddress:string>>, headRevisionId string"
    rows = [("1", "Plan", "application/vnd.google-apps.document", ["p"], None, None, "2024-01-01T00:00:00Z", [("a@x",)], "7"), ("2", "pic.png", "image/png", None, "abc", 9, "bad", None, None), ("3", "Dir", "application/vnd.google-apps.folder", None, None, None, None, [], None)]
    got = {r["file_id"]: r for r in listing.drive_files(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"]["name"] == "Plan.docx" and got["1"]["extra"]["headRevisionId"] == "7" and "exportMimeType" in got["1"]["extra"] and got["1"]["mtime"] == 1704067200 and got["1"]["owner"] == "a@x"
    assert got["2"]["name"] == "pic.png" and got["2"]["extra"] == {"mimeType": "image/png"} and got["2"]["mtime"] == 0 and got["3"]["type"] == "folder"


def test_delta_items_below_a_root(spark):
    schema = "id string, name string, size long, lastModifiedDateTime string, file struct<m:string>, folder struct<n:int>, package struct<type:string>, deleted struct<state:string>, parentReference struct<id:string,path:string>"
    rows = [("1", "a.txt", 3, "2024-01-01T00:00:00Z", ("t",), None, None, None, ("p", "/drive/root:/docs/x")), ("2", "n", 1, None, None, None, ("oneNote",), None, None), ("3", None, None, None, None, None, None, ("deleted",), None), ("4", "docs", 0, None, None, (1,), None, None, ("r", "/drive/root:"))]
    items = listing.graph_files(spark.createDataFrame(rows, schema))
    assert {r["file_id"]: (r["op"], r["path"]) for r in items.collect()} == {"1": ("upsert", "docs/x/a.txt"), "3": ("delete", None), "4": ("upsert", "docs")}
    assert {r["file_id"]: r["path"] for r in listing.below_root(items, "/docs/").collect()} == {"1": "x/a.txt", "3": None}


def test_small_listing_functions(spark):
    maps = spark.createDataFrame([({"user.a": "1", "system.b": "2", "com.apple.provenance": "3"},)], "x map<string,string>")
    assert maps.select(listing.collected_xattrs(F.col("x"), ["user."])).first()[0] == {"user.a": "1"}
    assert set(maps.select(listing.collected_xattrs(F.col("x"))).first()[0]) == {"user.a", "system.b"}
    lines = spark.createDataFrame([("/dev/a /mnt/x\\040y ext4", False), ("/dev/b /mnt/x\\040y/ ext4", True), ("/dev/c / ext4", False)], "value string, portable boolean")
    assert [tuple(r) for r in listing.mounts(lines).collect()] == [("/", False), ("/mnt/x y", True)]
    assert listing.parse_source("sftp://me@host:22/p") == {"scheme": "sftp", "host": "host", "user": "me", "port": "22", "path": "/p"}
    assert listing.parse_source("gdrive://Drive/a")["host"] == "Drive" and listing.parse_source("gdrive")["path"] == "/"
    for bad in ("ftp:x", "local:", "sftp:///x"):
        with pytest.raises(ValueError):
            listing.parse_source(bad)


def test_change_stream_resumes_and_ignores_repeated_batches(spark, tmp_path):
    schema = "key long, op string, seq long, value double"
    feed = str(tmp_path / "feed")
    one = spark.createDataFrame([(1, "upsert", 1, 1.0), (2, "upsert", 2, 2.0)], schema)
    two = spark.createDataFrame([(1, "delete", 4, None), (3, "upsert", 3, 3.0), (2, "upsert", 0, 9.0)], schema)
    state = ChangeState(spark, str(tmp_path / "state"), "key", ["seq"])
    assert state.live() is None
    one.coalesce(1).write.parquet(feed)
    state.run(spark.readStream.schema(schema).parquet(feed))
    assert sorted(r["key"] for r in state.live().collect()) == [1, 2]
    two.coalesce(1).write.mode("append").parquet(feed)
    state.run(spark.readStream.schema(schema).parquet(feed))
    assert sorted((r["key"], r["value"]) for r in state.live().collect()) == [(2, 2.0), (3, 3.0)]
    state.apply(one.withColumn("value", F.lit(-1.0)), state.version())  # the batch is done
    want = versions.apply_changes(one.select("key", "value").limit(0), one.union(two), "key", ["seq"])
    assert sorted(map(tuple, want.collect())) == sorted((r["key"], r["value"]) for r in state.live().collect())


def test_a_batch_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    state = ChangeState(spark, str(tmp_path / "state"), "key", ["seq"], buckets=8)
    rows = lambda keys, seq, op="upsert": spark.createDataFrame([(k, seq, op, float(seq)) for k in keys], "key long, seq long, op string, value double")
    state.apply(rows(range(100), 1), 0)
    first = state._manifest(0)
    assert sorted(first) == list(range(8))
    for number in range(1, 8):
        state.apply(rows([3], number + 1), number)
    at = state._manifest(state.version())
    assert sum(v == 0 for v in at.values()) == 7 and state.live().count() == 100
    assert {r["value"] for r in state.live().where("key = 3").collect()} == {8.0}
    assert sorted(int(p.name) for p in (tmp_path / "state/done").iterdir() if p.name.isdigit()) == [4, 5, 6, 7]
    state.apply(rows([3], 9, "delete"), 8)
    assert state.live().count() == 99 and state.changes().count() == 100
