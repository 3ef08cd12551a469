import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, dashboard, exclude, graph, index, retention, snapshots, storage, versions
from tessera.operators.retention import Policy

META = "file_id string, name string, size long, mtime long, type string, mode long, uid long, gid long, btime long, flags long, xattrs map<string,binary>, parents array<string>, content_hash string, content_ref string, extra map<string,string>"


def meta(file_id, **more):
    row = dict(file_id=file_id, name=file_id, size=1, mtime=1, type="file", mode=0, uid=0, gid=0, btime=0, flags=0, xattrs=None, parents=[], content_hash="h", content_ref="c", extra=None) | more
    return tuple(row[f.split()[0]] for f in META.split(", "))


# Versions


def test_diff_both_ways_and_inverse(spark):
    a = spark.createDataFrame([("file1", "x"), ("file2", "y")], "file_id string, ref string")
    b = spark.createDataFrame([("file1", "x"), ("file2", "z"), ("file3", "w")], "file_id string, ref string")
    assert sorted((r["change"], r["file_id"]) for r in versions.diff(a, b).collect()) == [("A", "file3"), ("M", "file2")]
    assert sorted((r["change"], r["file_id"]) for r in versions.diff(b, a).collect()) == [("D", "file3"), ("M", "file2")]
    assert versions.diff(a, a).collect() == [] and versions.diff(a, a.limit(0)).count() == 2


def test_classify_metadata(spark):
    xattrs = {"b": bytearray(b"2"), "a": bytearray(b"1")}
    native = {"mimeType": "application/vnd.google-apps.document", "headRevisionId": "7"}
    old = [meta("same"), meta("grown"), meta("moved", parents=["p"]), meta("attrs", xattrs=xattrs), meta("doc", extra=native), meta("unrevised", extra=native | {"headRevisionId": ""})]
    new = [
        meta("same", content_hash=None, content_ref=None), meta("grown", size=2), meta("moved", parents=["q"], content_hash="h", content_ref=None), meta("attrs", xattrs=dict(reversed(xattrs.items()))),
        meta("doc", size=99, content_hash=None, extra=native), meta("unrevised", extra=native | {"headRevisionId": ""}), meta("added"),
    ]
    got = {r["file_id"]: (r["status"], r["content_ref"]) for r in versions.classify_metadata(spark.createDataFrame(new, META), spark.createDataFrame(old, META)).collect()}
    assert got == {"same": ("unmodified", "c"), "grown": ("changed", "c"), "moved": ("unmodified", "c"), "attrs": ("unmodified", "c"), "doc": ("unmodified", "c"), "unrevised": ("changed", "c"), "added": ("new", "c")}


def test_apply_changes_reproduces_the_new_version(spark):
    rng = random.Random(1)
    state = {i: rng.random() for i in range(20)}
    feed = [(rng.choice(["upsert", "delete"]), rng.randrange(30), seq, rng.random()) for seq in range(100)]
    want = dict(state)
    for op, key, _, value in feed:
        want.pop(key, None)
        if op == "upsert":
            want[key] = value
    changes = spark.createDataFrame(rng.sample(feed, len(feed)), "op string, key long, seq long, value double")
    got = versions.apply_changes(spark.createDataFrame(list(state.items()), "key long, value double"), changes, "key", ["seq"])
    assert dict(map(tuple, got.collect())) == want


def test_scan_strategy():
    assert versions.needs_full_scan(None, "a", "a") and versions.needs_full_scan("t", "a", "b") and not versions.needs_full_scan("t", None, "")


# Retention


def kept(spark, times, policy, **more):
    rows = [(chr(97 + i), dt.datetime.fromisoformat(t), "g") for i, t in enumerate(times)]
    got = retention.apply_policy(spark.createDataFrame(rows, "ref string, created timestamp_ntz, g string"), policy, ["g"], **more).collect()
    return {r["ref"]: list(r["reasons"]) for r in got if r["kept"]}, len(got)


def test_keep_last(spark):
    days = [f"2024-01-0{d}T12:00:00" for d in (5, 4, 3, 2, 1)]
    assert kept(spark, days, Policy(last=3)) == ({r: ["last"] for r in "abc"}, 5)


def test_keep_daily_takes_the_newest_of_a_day(spark):
    times = ["2024-01-03T15:00", "2024-01-03T10:00", "2024-01-02T15:00", "2024-01-02T10:00", "2024-01-01T15:00"]
    assert kept(spark, times, Policy(daily=2))[0] == {"a": ["daily snapshot"], "c": ["daily snapshot"]}


def test_keep_weekly_and_combined(spark):
    assert set(kept(spark, ["2024-01-14T12:00", "2024-01-13T12:00", "2024-01-07T12:00", "2024-01-01T12:00"], Policy(weekly=2))[0]) == {"a", "c"}
    got, _ = kept(spark, [f"2024-01-0{d}T12:00" for d in (5, 4, 3, 2, 1)], Policy(last=1, daily=3))
    assert got == {"a": ["last", "daily snapshot"], "b": ["daily snapshot"], "c": ["daily snapshot"]}


def test_buckets_are_islands_of_wall_time(spark):
    """A label that comes back after another one counts again."""
    rows = [("a", 4, "2024-01-02T00:10", "g"), ("b", 3, "2024-01-01T23:50", "g"), ("c", 2, "2024-01-02T00:05", "g"), ("d", 1, "2024-01-01T12:00", "g")]
    frame = spark.createDataFrame([(r, n, dt.datetime.fromisoformat(t), g) for r, n, t, g in rows], "ref string, created long, wall timestamp_ntz, g string")
    got = retention.apply_policy(frame, Policy(daily=3), ["g"], wall="wall")
    assert {r["ref"] for r in got.where("kept").collect()} == {"a", "b", "c"}


def test_empty_policy(spark):
    frame = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), "g")], "ref string, created timestamp_ntz, g string")
    assert retention.apply_policy(frame, Policy(), ["g"]).first()["kept"] is False
    assert retention.forget(frame, Policy(), ["g"], F.lit(True)).first()["kept"] is False
    with pytest.raises(ValueError):
        retention.forget(frame, Policy(), ["g"])


# Snapshots

SNAP = "ref string, created timestamp_ntz, seq long, tags array<string>, source struct<type:string,account:string,path:string,identity:string,path_id:string,drive_name:string>"


def snap(ref, day, seq=1, tags=None, **source):
    full = {k: source.get(k) for k in ("type", "account", "path", "identity", "path_id", "drive_name")} if source else None
    return (ref, dt.datetime(2024, 1, day), seq, tags, full)


def test_groups_by_identity(spark):
    rows = [snap("a", 1, type="local", account="host1", path="/d", identity="uuid1"), snap("b", 2, type="local", account="host2", path="/d", identity="uuid1"), snap("c", 3, type="local", account="host1", path="/d", identity="uuid2"), snap("d", 4)]
    got = {r["group"]: r["snapshots"] for r in snapshots.group_snapshots(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {"source:local, account:uuid1, path:/d": 2, "source:local, account:uuid2, path:/d": 1, "(all)": 1}
    assert snapshots.group_snapshots(spark.createDataFrame(rows, SNAP), "").first()["snapshots"] == 4


def test_filters(spark):
    frame = spark.createDataFrame([snap("a", 1, tags=["daily", "important"], type="local", account="h", path="/d", path_id="pid"), snap("b", 2)], SNAP)
    match = lambda **f: [r["ref"] for r in frame.where(snapshots.matches(**f)).collect()]
    assert match(tags=["daily"]) == ["a"] and match(tags=["daily", "missing"]) == [] and match(path="pid") == match(path="/d") == match(account="h") == ["a"] and match() == ["a", "b"]


def test_previous_prefers_identity(spark):
    have = [snap("legacy", 9, type="local", account="h", path="/d"), snap("bridge", 8, type="local", account="x", path="/d", identity="i"), snap("exact", 1, type="local", account="y", path="/z", identity="i", path_id="p"), snap("older", 1, type="local", account="h", path="/d")]
    wanted = spark.createDataFrame([("1", "local", "h", "/d", "i", "p"), ("2", "local", "h", "/d", "i", "other"), ("3", "local", "h", "/d", "", ""), ("4", "sftp", "h", "/d", "", "")], "id string, type string, account string, path string, identity string, path_id string")
    got = {r["id"]: r["ref"] for r in snapshots.previous(spark.createDataFrame(have, SNAP), wanted).collect()}
    assert got == {"1": "exact", "2": "bridge", "3": "legacy", "4": None}


def test_catalog(spark):
    refs = lambda *r: spark.createDataFrame([(x, i) for i, x in enumerate(r)], "ref string, seq long")
    assert {tuple(r) for r in snapshots.reconcile(refs("a", "b"), refs("b", "c")).collect()} == {("a", "missing"), ("b", "present"), ("c", "stale")}
    assert sorted(r["ref"] for r in snapshots.append_summaries(refs("a", "b"), refs("b", "c")).collect()) == ["a", "b", "c"]
    assert sorted(r["ref"] for r in snapshots.remove_summaries(refs("a", "b"), refs("b")).collect()) == ["a"]
    frame = spark.createDataFrame([snap("b", 2, seq=3), snap("a", 2, seq=3), snap("c", 9, seq=1)], SNAP)
    assert tuple(snapshots.latest(frame).first()) == ("a", 3) and snapshots.latest(frame.limit(0)).collect() == []
    assert snapshots.next_sequence(frame).first()[0] == 4 and snapshots.next_sequence(frame.limit(0)).first()[0] == 1
    numbered = snapshots.number_snapshots(frame.select("ref", "created", "seq"), frame)
    assert {r["ref"]: r["seq"] for r in numbered.collect()} == {"a": 4, "b": 5, "c": 6}


# Exclude rules


@pytest.mark.parametrize(
    ("patterns", "path", "folder", "want"),
    [
        ([".git/"], ".git", True, True), ([".git/"], ".git", False, False), ([".git/"], "sub/.git", True, True), (["node_modules/"], "src/node_modules", True, True),
        (["**/*.log"], "app.log", False, True), (["**/*.log"], "a/b/c/app.log", False, True), (["**/*.log"], "app.txt", False, False), (["docs/**/*.pdf"], "docs/guide.pdf", False, True),
        (["docs/**/*.pdf"], "docs/v2/sub/guide.pdf", False, True), (["docs/**/*.pdf"], "src/guide.pdf", False, False), (["*.log", "!important.log"], "sub/important.log", False, False), (["*.log", "!important.log"], "sub/debug.log", False, True),
        (["build/output"], "build/output", True, True), (["build/output"], "src/build/output", False, False), (["# note", "", "*.tmp"], "x.tmp", False, True), (["/foo"], "a/foo", False, True),
        (["a/**"], "a", True, True), (["a/**"], "a/b/c", False, True), (["a/**"], "ab", False, False), (["**"], "any/thing", False, True), (["a/**/x/**/z"], "a/1/x/2/3/z", False, True),
        (["a/**/x/**/z"], "a/1/2/z", False, False), (["a?c"], "abc", False, True), (["a?c"], "a/c", False, False), (["[ab].txt"], "b.txt", False, True), (["[^ab].txt"], "b.txt", False, False), (["[^ab].txt"], "c.txt", False, True),
        (["[x"], "[x", False, False), (["*.l.g"], "xxlxg", False, False), (["a/**/*"], "a", False, True), (["\\*"], "*", False, True), (["\\*"], "x", False, False),
    ],
)
def test_exclude_rules(spark, patterns, path, folder, want):
    column = exclude.excluded(exclude.parse_rules(patterns), F.col("path"), F.col("folder"))
    assert spark.createDataFrame([(path, folder)], "path string, folder boolean").select(column).first()[0] is want


def test_excluded_folders_hide_all_below(spark):
    rows = [("a", True), ("a/x", True), ("a/x/keep.txt", False), ("b.txt", False), ("ax", False)]
    left = exclude.exclude(spark.createDataFrame(rows, "path string, is_folder boolean"), exclude.parse_rules(["x/", "!keep.txt"]))
    assert sorted(r["path"] for r in left.collect()) == ["a", "ax", "b.txt"]


# Graphs

FILES = "file_id string, name string, type string, parents array<string>, size long, content_hash string"


def tree(spark):
    rows = [("r", "restore_me.txt", "file", [], 5, "h"), ("s", "subdir", "folder", [], 0, ""), ("n", "nested.txt", "file", ["s"], 7, "h"), ("d", "deep", "folder", ["s"], 0, ""), ("f", "file.txt", "file", ["d"], 9, "h"), ("o", "orphan", "file", ["gone"], 1, "")]
    return spark.createDataFrame(rows, FILES)


def test_paths_and_order(spark):
    got = {r["file_id"]: (r["path"], r["depth"]) for r in graph.paths(tree(spark)).collect()}
    assert got == {"r": ("restore_me.txt", 0), "s": ("subdir", 0), "n": ("subdir/nested.txt", 1), "d": ("subdir/deep", 1), "f": ("subdir/deep/file.txt", 2), "o": ("orphan", 0)}
    order = [r["file_id"] for r in graph.topological(tree(spark)).collect()]
    assert order.index("s") < order.index("d") < order.index("f")


def test_paths_have_at_most_fifty_parents(spark):
    rows = [(str(i), f"n{i}", [str(i - 1)] if i else [], None) for i in range(70)]
    got = {r["file_id"]: (r["path"], r["depth"]) for r in graph.paths(spark.createDataFrame(rows, "file_id string, name string, parents array<string>, paths array<string>")).collect()}
    for i in range(70):
        assert got[str(i)] == ("/".join(f"n{j}" for j in range(max(0, i - 50), i + 1)), min(i, 50))


def test_stored_paths_and_cycles(spark):
    rows = [("d", "docs", [], ["work\\docs/"]), ("f", "guide.txt", ["d"], None), ("x", "x", ["y"], None), ("y", "y", ["x"], None)]
    got = {r["file_id"]: r["path"] for r in graph.paths(spark.createDataFrame(rows, "file_id string, name string, parents array<string>, paths array<string>")).collect()}
    assert got["d"] == "work/docs" and got["f"] == "work/docs/guide.txt" and got["x"].startswith(("x/", "y/"))


@pytest.mark.parametrize(("wanted", "want"), [("subdir/", {"s", "n", "d", "f"}), ("subdir/deep", {"s", "d", "f"}), ("subdir/nested.txt", {"s", "n"}), ("nothing", set()), ("", set("rsndfo"))])
def test_restore_selection(spark, wanted, want):
    assert {r["file_id"] for r in graph.restore_selection(tree(spark), wanted).collect()} == want


def test_closures_totals_and_resolution(spark):
    files = tree(spark)
    assert {r["file_id"] for r in graph.descendants_of(files, "s").collect()} == {"n", "d", "f"}
    assert {r["file_id"] for r in graph.ancestors_of(files, spark.createDataFrame([("f",), ("d",)], "file_id string")).collect()} == {"d", "s"}
    assert tuple(graph.restore_totals(files).first()) == (2, 3, 21)
    rooted = files.withColumn("parents", F.when(F.col("file_id") == "s", F.array(F.lit("root"))).otherwise(F.col("parents")))
    assert graph.resolve_path(rooted, "/subdir/deep", "root") == "d"
    with pytest.raises(LookupError):
        graph.resolve_path(rooted, "subdir/nothing", "root")


def test_prune_deletes_the_three_that_are_unreachable(spark):
    edges = spark.createDataFrame([("snapshot/1", "node/1"), ("node/1", "filemeta/1"), ("filemeta/1", "content/1"), ("content/1", "chunk/1"), ("content/9", "chunk/9"), ("node/1", "snapshot/1")], "src string, dst string")
    keys = ["snapshot/1", "node/1", "filemeta/1", "content/1", "chunk/1", "chunk/9", "content/9", "node/9"]
    objects = spark.createDataFrame([(k, 10) for k in keys], "key string, size long")
    live = graph.reachable(edges, spark.createDataFrame([("snapshot/1",)], "key string"))
    assert {r["key"] for r in graph.unreachable(objects, live).collect()} == {"chunk/9", "content/9", "node/9"}
    assert tuple(graph.prune_totals(objects, live).first()) == (8, 3, 30)


def test_integrity(spark):
    import hashlib

    good = "chunk/" + hashlib.sha256(b"hello world").hexdigest()
    objects = spark.createDataFrame([(good, b"hello world"), ("chunk/0", b"x")], "key string, data binary")
    assert [r["key"] for r in graph.corrupt(objects).collect()] == ["chunk/0"]
    edges = spark.createDataFrame([("content/1", good), ("content/1", "chunk/2"), ("content/2", "chunk/2")], "src string, dst string")
    assert [tuple(r)[:2] for r in graph.missing(edges, objects).collect()] == [("chunk/2", "missing")]
    docs = spark.createDataFrame([("a", '{"size": 1}'), ("b", "not json"), ("c", None)], "key string, data string")
    assert sorted(r["key"] for r in graph.unparsable(docs, "size long").collect()) == ["b", "c"]


# Storage


def test_packs(spark):
    catalog = spark.createDataFrame([("k", "p1", 0, 5), ("m", "p2", 0, 90)], "key string, pack_ref string, offset long, length long")
    packs = spark.createDataFrame([("p1", 1029), ("p2", 100), ("p3", 50)], "pack_ref string, size long")
    frag = storage.fragmentation(catalog, packs)
    assert {r["pack_ref"]: r["action"] for r in frag.collect()} == {"p1": "repack", "p2": "keep", "p3": "delete"}
    assert tuple(storage.repack_totals(frag).first()) == (2, 1074)
    assert [r["key"] for r in storage.repacked_objects(catalog, frag).collect()] == ["k"]


def test_greedy_packs_reset_when_full(spark):
    objects = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate([40, 70, 10, 200, 5, 0])], "key string, size long")
    got = sorted((r["key"], r["pack"], r["offset"]) for r in storage.greedy_packs(objects, 1, 100).collect())
    assert got == [("k0", 0, 0), ("k1", 0, 40), ("k2", 1, 0), ("k3", 1, 10), ("k4", 2, 0), ("k5", 2, 5)]


def test_quota_and_lookup(spark):
    writes = spark.createDataFrame([(i, 10) for i in range(6)], "id long, size long")
    got = {r["id"]: (r["total"], r["allowed"]) for r in storage.quota_cutoff(writes, 30, ["id"]).collect()}
    assert got == {i: (10 * i + 10, i < 3) for i in range(6)}
    stored = spark.createDataFrame([("a", b"1")], "key string, data binary")
    assert {r["key"]: r["data"] for r in storage.objects(stored, spark.createDataFrame([("a",), ("b",)], "key string")).collect()} == {"a": bytearray(b"1"), "b": None}
    assert [r["key"] for r in storage.new_objects(spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), stored).collect()] == ["b"]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_restore_the_file_and_survive_an_insertion(seed):
    rng = random.Random(seed)
    data = rng.randbytes(rng.randrange(20_000, 60_000))
    sizes = (256, 1024, 4096)
    ends = chunking.cut_points(data, *sizes)
    parts = [data[s:e] for s, e in zip([0, *ends], ends)]
    assert b"".join(parts) == data and all(sizes[0] <= len(p) <= sizes[2] for p in parts[:-1])
    moved = b"inserted" + data
    more = chunking.cut_points(moved, *sizes)
    other = {moved[s:e] for s, e in zip([0, *more], more)}
    assert len(other - set(parts)) <= 4
    hashes = chunking.gear_hashes(data[:200])
    for i in (0, 63, 64, 150):
        assert int(hashes[i]) == sum(int(chunking._GEAR[data[j]]) << (i - j) for j in range(max(0, i - 63), i + 1)) % (1 << 64)
    assert chunking.cut_points(b"", *sizes) == [] and chunking.cut_points(b"x", *sizes) == [1]


def test_index_shares_what_does_not_change(spark):
    from tessera.functions.hashes import affinity_key

    rows = spark.range(1000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("file_id"), F.concat(F.lit("dir"), (F.col("id") % 10).cast("string")).alias("parent"), F.lit("v").alias("ref"))
    before = rows.withColumn("path_key", affinity_key(F.col("parent"), F.col("file_id")))
    nodes = index.nodes(before)
    assert nodes.where("kind = 'leaf'").agg(F.sum("entries")).first()[0] == 1000 and nodes.where("level = 0").first()["entries"] == 1000
    assert index.placed(before).count() == 1000
    after = before.withColumn("ref", F.when(F.col("parent") == "dir3", "w").otherwise(F.col("ref")))
    a, b = index.node_refs(before), index.node_refs(after)
    assert a.count() == nodes.count()
    changed = index.rewritten(a, b).agg(F.sum("new_nodes"), F.sum("nodes")).first()
    assert 0 < changed[0] < changed[1] / 3  # one folder's nodes
    assert index.rewritten(a, index.node_refs(before.orderBy("ref"))).agg(F.sum("new_nodes")).first()[0] == 0


# Dashboard


def test_source_addresses(spark):
    want = {"local:/d": ("local", "/d", ""), "sftp:h/x": ("sftp", "h/x", ""), "gdrive": ("gdrive", "/", ""), "gdrive://My Drive/a/b": ("gdrive", "/a/b", "My Drive"), "onedrive:x": ("onedrive", "/x", ""), "ftp:x": ("", "", ""), "local": ("", "", "")}
    got = spark.createDataFrame([(k,) for k in want], "u string").select("u", dashboard.source_key(F.col("u")).alias("k")).collect()
    assert {r["u"]: tuple(r["k"]) for r in got} == want


def test_profile_status(spark):
    rows = [("off", "local:/d", "s", "", False), ("nostore", "local:/d", "", "", None), ("lost", "local:/d", "zz", "", True), ("unsigned", "gdrive", "s", "", True), ("other", "gdrive", "s", "one", True), ("badref", "local:/d", "s", "zz", True), ("fine", "local:/d", "s", "", True), ("down", "local:/d", "t", "", True), ("new", "local:/d", "u", "", True), ("never", "local:/e", "s", "", True)]
    profiles = spark.createDataFrame(rows, "name string, source string, store string, auth_ref string, enabled boolean")
    stores = spark.createDataFrame([("s",), ("t",), ("u",)], "name string")
    auth = spark.createDataFrame([("one", "onedrive")], "name string, provider string")
    probes = spark.createDataFrame([("s", "ok", None), ("t", "error", "dial: refused"), ("u", "error", "repository not initialized")], "store string, status string, error string")
    have = spark.createDataFrame([snap("a", 1, type="local", path="/d"), snap("b", 3, type="local", path="/d")], SNAP)
    got = {r["name"]: r for r in dashboard.profile_status(profiles, stores, auth, probes, have, F.lit(dt.datetime(2024, 1, 8)).cast("timestamp_ntz")).collect()}
    assert {n: (r["status"], r["note"]) for n, r in got.items()} == {
        "off": ("disabled", "profile disabled"), "nostore": ("error", "no store ref"), "lost": ("error", "missing store"), "unsigned": ("error", "missing auth"), "other": ("error", "provider mismatch"),
        "badref": ("error", "missing auth ref"), "fine": ("ready", ""), "down": ("warning", "refused"), "new": ("warning", "repository not initialized"), "never": ("ready", "never backed up"),
    }
    assert got["fine"]["last_ref"] == "b" and got["fine"]["freshness"] == "recent" and got["new"]["actions"] == "init" and got["lost"]["actions"] == ""


def test_health_tables(spark):
    auth = spark.createDataFrame([("a", "google", "f", None, None, None), ("b", "onedrive", None, "", None, None), ("c", "box", None, None, None, None)], "name string, provider string, google_token_file string, google_token_ref string, onedrive_token_file string, onedrive_token_ref string")
    assert [r["status"] for r in dashboard.credential_health(auth).orderBy("name").collect()] == ["ready", "warning", "error"]
    stores = spark.createDataFrame([("a", "local:/x"), ("b", ""), ("c", "ftp://x")], "name string, uri string")
    assert [r["note"] for r in dashboard.store_health(stores).orderBy("name").collect()] == ["", "missing uri", "invalid uri"]


def test_all_snapshots_newest_first_has_every_snapshot(spark, tmp_path):
    import duckdb
    from tessera.plans.registry import QUERIES, SQL

    spark.range(1000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7919 % 300) AS ts", "'view' AS event_type", "id % 9 AS user_id", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    events = duckdb.read_parquet(f"{tmp_path}/events.parquet/*.parquet")  # noqa: F841
    got = sorted((r["ref"], r["position"]) for r in QUERIES["all_snapshots_newest_first"](spark, str(tmp_path)).collect())
    assert len(got) == 1000 and got == sorted(duckdb.sql(SQL["all_snapshots_newest_first"]).fetchall())


def test_repack_moves_live_objects_and_drops_dead_packs(spark):
    packs = spark.createDataFrame([("p1", bytearray(b"aaaaDDDDDDDDDDDD")), ("p2", bytearray(b"bbbbcc")), ("p3", bytearray(b"EEEE")), ("p4", bytearray(b"XXXXXXXXdd"))], "pack_ref string, data binary")
    catalog = spark.createDataFrame([("a", "p1", 0, 4), ("b", "p2", 0, 4), ("c", "p2", 4, 2), ("d", "p4", 8, 2)], "key string, pack_ref string, offset long, length long")
    after, left = storage.repack(catalog, packs, pack_size=8)
    read = {r["key"]: bytes(r["data"]) for r in storage.read_packed(catalog.select("key"), after, left).collect()}
    assert read == {"a": b"aaaa", "b": b"bbbb", "c": b"cc", "d": b"dd"}
    kept = {r["pack_ref"]: bytes(r["data"]) for r in left.collect()}
    assert kept.pop("p2") == b"bbbbcc" and list(kept.values()) == [b"aaaadd"] and all(len(x) == 64 for x in kept)


def test_values_given_for_a_run_go_before_the_profile(spark):
    profiles = spark.createDataFrame([("p", "local:/a", "s", "x"), ("q", "", None, None), ("r", "local:/c", "gone", None)], "name string, source string, store string, auth_ref string")
    stores = spark.createDataFrame([("s", "s3:bucket")], "name string, uri string")
    auth = spark.createDataFrame([("y", "google")], "name string, provider string")
    run = lambda given: {r["name"]: (r["source"], r["store_uri"], r["provider"], r["error"]) for r in dashboard.effective_profiles(profiles, stores, auth, given).collect()}
    assert run(None) == {"p": ("local:/a", "s3:bucket", "", "unknown auth"), "q": ("", "", "", "empty source"), "r": ("local:/c", "", "", "unknown store")}
    assert run({"source": "local:/z", "auth_ref": "y"})["p"] == ("local:/z", "s3:bucket", "google", "")
