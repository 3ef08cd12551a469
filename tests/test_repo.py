import pytest
from pyspark.sql import functions as F

from tessera.operators.retention import Policy
from tessera.repo import NeedsFullScan, Repo, RepoLocked

LISTING = "file_id string, name string, type string, parents array<string>, size long, mtime long, content binary"
SOURCE = {"type": "local", "account": "host", "path": "/d"}


def listing(spark, files):
    rows = [("d", "dir", "folder", [], 0, 1, None)] + [(i, f"{i}.txt", "file", ["d"], len(body), 1, body) for i, body in files.items()]
    return spark.createDataFrame(rows, LISTING)


def test_life_of_a_repository(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"), key=b"secret", chunk_sizes=(64, 128, 256)).init()
    with pytest.raises(FileExistsError):
        repo.init()
    with pytest.raises(LookupError):
        repo.resolve()
    body = bytes(range(256)) * 8
    one = repo.backup(listing(spark, {"a": body, "b": b"second", "e": b""}), SOURCE, "2024-01-01", tags=["daily"]).first()
    assert (one["files_new"], one["dirs_new"], one["processed"]) == (3, 1, 4)
    same = repo.backup(listing(spark, {"a": body, "b": b"second", "e": b""}), SOURCE, "2024-01-02").first()
    assert same["ref"] is None and same["files_unmodified"] == 3 and repo.snapshots().count() == 1
    chunks = repo.table("chunks").count()
    two = repo.backup(listing(spark, {"a": body, "b": b"other!", "c": body + b"tail"}), SOURCE, "2024-01-03").first()
    assert (two["files_new"], two["files_changed"], two["files_removed"], two["files_unmodified"]) == (1, 1, 1, 1)
    assert repo.table("chunks").count() < 2 * chunks  # the copy of a shares its chunks
    assert [(r["change"], r["path"]) for r in repo.diff(one["ref"]).collect()] == [("M", "dir/b.txt"), ("A", "dir/c.txt"), ("D", "dir/e.txt")]
    assert [r["path"] for r in repo.tree(one["ref"]).collect()][0] == "dir"
    got = {r["path"]: r["content"] and bytes(r["content"]) for r in repo.restore(path="dir/c.txt").collect()}
    assert got == {"dir": None, "dir/c.txt": body + b"tail"}
    assert {r["path"]: bytes(r["content"] or b"") for r in repo.restore(one["ref"]).collect()} == {"dir": b"", "dir/a.txt": body, "dir/b.txt": b"second", "dir/e.txt": b""}
    assert repo.check(read_data=True).collect() == []
    plan = repo.policy(Policy(last=1))
    assert {r["ref"]: r["kept"] for r in plan.collect()} == {one["ref"]: False, two["ref"]: True}
    assert [r["ref"] for r in repo.policy(Policy(), tags=["daily"]).collect()] == [one["ref"]]
    repo.forget(plan.where("not kept").select("ref"))
    planned, held = repo.prune(dry_run=True).first(), repo._bytes()
    assert planned["deleted"] == 1 and planned["freed_bytes"] == 0 and repo.table("chunks").count() == repo.prune(dry_run=True).first()["scanned"] and held == repo._bytes()
    pruned = repo.prune().first()
    assert pruned["freed_bytes"] == held - repo._bytes()
    assert pruned["deleted"] == 1 and repo.check(read_data=True).collect() == []
    assert repo.prune().first()["deleted"] == 0
    assert {bytes(r["content"]) for r in repo.restore(path="dir/a.txt").where("type = 'file'").collect()} == {body}


def test_check_finds_damage(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"), chunk_sizes=(64, 128, 256)).init()
    repo.backup(listing(spark, {"a": b"hello world"}), SOURCE, "2024-01-01")
    good = repo.table("chunks").collect()
    repo._replace("chunks", spark.createDataFrame(good, repo.table("chunks").schema).withColumn("data", F.lit(bytearray(b"bad"))))
    assert [(r["type"]) for r in repo.check(read_data=True).collect()] == ["corrupt"] and repo.check().collect() == []
    repo._replace("chunks", repo.table("chunks").limit(0))
    (error,) = repo.check().collect()
    assert error["type"] == "missing" and error["key"] == f"chunk/{good[0]['chunk_ref']}"
    assert repo.objects(spark.createDataFrame([(error["key"],)], "key string")).first()["data"] is None


def test_prune_frees_space(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"), chunk_sizes=(1 << 10, 1 << 12, 1 << 14)).init()
    import random

    big = {i: random.Random(i).randbytes(100_000) for i in "abcd"}
    one = repo.backup(listing(spark, big), SOURCE, "2024-01-01").first()["ref"]
    repo.backup(listing(spark, {"a": big["a"]}), SOURCE, "2024-01-02")
    before = repo._bytes()
    repo.forget(spark.createDataFrame([(one,)], "ref string"))
    late = repo.prune(grace_seconds=3600).first()
    assert late["bytes_reclaimed"] == 300_000 and late["freed_bytes"] < 0 and repo.restore(path="dir/a.txt").count() == 2
    assert repo.prune().first()["freed_bytes"] > 300_000 and repo._bytes() < before - 300_000
    assert {bytes(r["content"]) for r in repo.restore().where("type = 'file'").collect()} == {big["a"]}


def test_writers_exclude_each_other(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo")).init()
    with repo._lock(exclusive=False):
        with pytest.raises(RepoLocked):
            repo.prune()
        repo.backup(listing(spark, {"a": b"x"}), SOURCE, "2024-01-01")
    with repo._lock(exclusive=True), pytest.raises(RepoLocked):
        repo.backup(listing(spark, {"a": b"y"}), SOURCE, "2024-01-02")
    assert repo.prune().first()["deleted"] == 0


CHANGES = "op string, seq long, " + LISTING


def test_incremental_backup_equals_a_full_one(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"), chunk_sizes=(64, 128, 256)).init()
    rows = [("upsert", 1, "n", "new.txt", "file", ["late"], 3, 2, b"new"), ("upsert", 2, "late", "later", "folder", [], 0, 2, None), ("delete", 3, "a", *[None] * 6), ("upsert", 4, "b", "b.txt", "file", ["d"], 9, 5, b"was wrong"), ("upsert", 5, "b", "b.txt", "file", ["d"], 6, 6, b"second")]
    changes = spark.createDataFrame(rows, CHANGES)
    with pytest.raises(NeedsFullScan):
        repo.backup_changes(changes, SOURCE, "2024-01-02", "t2")
    repo.backup(listing(spark, {"a": b"first", "b": b"before"}), SOURCE, "2024-01-01", change_token="t1", exclude_hash="x")
    assert repo.change_token(SOURCE, "x") == "t1" and repo.change_token(SOURCE, "y") is None
    with pytest.raises(NeedsFullScan):
        repo.backup_changes(changes, SOURCE, "2024-01-02", "t2", exclude_hash="y")
    got = repo.backup_changes(changes, SOURCE, "2024-01-02", "t2", exclude_hash="x").first()
    assert (got["files_new"], got["dirs_new"], got["files_changed"], got["files_removed"]) == (1, 1, 1, 1)
    assert repo.change_token(SOURCE, "x") == "t2"
    files = {r["path"]: r["content"] and bytes(r["content"]) for r in repo.restore().collect()}
    assert files == {"dir": None, "dir/b.txt": b"second", "later": None, "later/new.txt": b"new"}
    assert repo.backup_changes(changes.where("file_id = 'b'"), SOURCE, "2024-01-03", "t3", exclude_hash="x").first()["ref"] is None
    assert repo.check(read_data=True).collect() == []


def test_restore_streams_parts_and_stamps_folders_last(spark, tmp_path):
    import os

    repo = Repo(spark, str(tmp_path / "repo"), chunk_sizes=(64, 128, 256)).init()
    body = bytes(range(256)) * 40
    repo.backup(listing(spark, {"a": body, "e": b""}), SOURCE, "2024-01-01")
    root = str(tmp_path / "out")
    assert {r["path"]: r["state"] for r in repo.restore_to_folder(root).collect()} == {"dir": "written", "dir/a.txt": "written", "dir/e.txt": "written"}
    assert open(f"{root}/dir/a.txt", "rb").read() == body and open(f"{root}/dir/e.txt", "rb").read() == b"" and os.stat(f"{root}/dir").st_mtime == 1
    assert {r["state"] for r in repo.restore_to_folder(root).collect() if r["path"] != "dir"} == {"skipped"}
