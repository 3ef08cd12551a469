"""Documents as files: the previous listing has no Spanish ones yet, the current one no German ones, and changed French ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import versions
from tessera.plans.registry import query, table

_VERSIONS = """
WITH prev AS (SELECT doc_id AS file_id, sha256(text) AS ref, lang || '/' || source || '/' || doc_id AS path, source FROM documents WHERE lang <> 'es'),
     cur AS (SELECT doc_id AS file_id, sha256(CASE WHEN lang = 'fr' THEN text || 'x' ELSE text END) AS ref, lang || '/' || source || '/' || doc_id AS path, source FROM documents WHERE lang <> 'de'),
     d AS (SELECT coalesce(c.file_id, p.file_id) AS file_id, CASE WHEN p.file_id IS NULL THEN 'A' WHEN c.file_id IS NULL THEN 'D' ELSE 'M' END AS change, coalesce(c.path, p.path) AS path
           FROM prev p FULL OUTER JOIN cur c ON p.file_id = c.file_id WHERE p.ref IS DISTINCT FROM c.ref)
"""


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """previous, current: file_id, ref, path, type, size."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path")

    def version(rows: DataFrame, text: Column) -> DataFrame:
        return rows.select(F.col("doc_id").alias("file_id"), F.sha2(text.cast("binary"), 256).alias("ref"), path, F.when(F.col("source") == "src0", "folder").otherwise("file").alias("type"), F.col("n_chars").alias("size"))

    text = F.col("text")
    return version(docs.where("lang <> 'es'"), text), version(docs.where("lang <> 'de'"), F.when(F.col("lang") == "fr", F.concat(text, F.lit("x"))).otherwise(text))


@query(_VERSIONS + "SELECT file_id, change, path FROM d")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = listings(spark, sf_dir)
    paths = prev.select("file_id", "path").union(cur.select("file_id", "path")).distinct()
    return versions.diff(prev, cur).join(paths, "file_id").select("file_id", "change", "path").orderBy("path")


@query(_VERSIONS + "SELECT change, count(*) AS entries FROM d GROUP BY change")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = listings(spark, sf_dir)
    return versions.diff(prev, cur).groupBy("change").agg(F.count("*").alias("entries"))


@query(_VERSIONS + "SELECT c.file_id, CASE WHEN p.file_id IS NULL THEN 'new' WHEN p.ref = c.ref THEN 'unmodified' ELSE 'changed' END AS status FROM cur c LEFT JOIN prev p ON p.file_id = c.file_id")
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = listings(spark, sf_dir)
    return versions.classify(cur, prev).select("file_id", "status")


@query(_VERSIONS + "SELECT file_id, path FROM prev WHERE file_id NOT IN (SELECT file_id FROM cur)")
def removed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = listings(spark, sf_dir)
    return versions.removed(cur, prev).select("file_id", "path")


@query(
    _VERSIONS
    + """, s AS (SELECT c.source, CASE WHEN p.file_id IS NULL THEN 'new' WHEN p.ref = c.ref THEN 'unmodified' ELSE 'changed' END AS status FROM cur c LEFT JOIN prev p ON p.file_id = c.file_id
      UNION ALL SELECT source, 'removed' FROM prev WHERE file_id NOT IN (SELECT file_id FROM cur))
SELECT count(*) FILTER (source <> 'src0' AND status = 'new') AS files_new, count(*) FILTER (source <> 'src0' AND status = 'changed') AS files_changed,
  count(*) FILTER (source <> 'src0' AND status = 'unmodified') AS files_unmodified, count(*) FILTER (source <> 'src0' AND status = 'removed') AS files_removed,
  count(*) FILTER (source = 'src0' AND status = 'new') AS dirs_new, count(*) FILTER (source = 'src0' AND status = 'changed') AS dirs_changed,
  count(*) FILTER (source = 'src0' AND status = 'unmodified') AS dirs_unmodified, count(*) FILTER (source = 'src0' AND status = 'removed') AS dirs_removed,
  count(*) FILTER (status <> 'removed') AS processed FROM s"""
)
def backup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = listings(spark, sf_dir)
    return versions.backup_stats(versions.classify(cur, prev), versions.removed(cur, prev))


def _metadata(rows: DataFrame, size: Column, content_hash: Column, owner: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.select(
        F.col("doc_id").cast("string").alias("file_id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"), size.alias("size"), zero.alias("mtime"), F.lit("file").alias("type"), zero.alias("mode"), zero.alias("uid"), zero.alias("gid"),
        zero.alias("btime"), zero.alias("flags"), F.create_map(F.lit("user.source"), F.col("source").cast("binary"), F.lit("user.owner"), owner.cast("binary")).alias("xattrs"), F.array("source").alias("parents"), content_hash.alias("content_hash"), F.lit(None).cast("string").alias("content_ref"), F.lit(None).cast("map<string,string>").alias("extra"),
    )


@query(
    """SELECT doc_id::VARCHAR AS file_id, CASE WHEN lang = 'es' THEN 'new' WHEN lang IN ('fr', 'de') THEN 'changed' ELSE 'unmodified' END AS status,
  CASE WHEN lang IN ('es', 'fr', 'de') THEN NULL ELSE sha256(text) END AS content_hash FROM documents"""
)
def metadata_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing without content hashes takes them over where metadata is equal; French documents have grown, German ones have another extended attribute."""
    docs = table(spark, sf_dir, "documents")
    prev = _metadata(docs.where("lang <> 'es'"), F.col("n_chars"), F.sha2(F.col("text").cast("binary"), 256), F.col("lang"))
    cur = _metadata(docs, F.col("n_chars") + F.when(F.col("lang") == "fr", 1).otherwise(0), F.lit(None).cast("string"), F.when(F.col("lang") == "de", "other").otherwise(F.col("lang")))
    return versions.classify_metadata(cur, prev).select("file_id", "status", "content_hash")


_FEED = "SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value, event_id, ts FROM events"


def feed(events: DataFrame) -> DataFrame:
    op = versions.cdc_operation(F.col("event_type") == "error", F.col("event_type"), F.lit(False))
    return events.select(F.col("user_id").alias("key"), op.alias("op"), "value", "event_id", "ts")


@query("SELECT op, count(*) AS changes FROM (" + _FEED + ") GROUP BY op")
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events")).groupBy("op").agg(F.count("*").alias("changes"))


_APPLIED = "WITH f AS (" + _FEED + "), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM f) "


@query(
    _APPLIED
    + """, s AS (SELECT DISTINCT c_custkey AS key, c_acctbal AS value FROM customer)
SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM f WHERE key IS NOT NULL) UNION ALL SELECT key, value FROM l WHERE r = 1 AND op <> 'delete'"""
)
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by customer, after a feed that sets or deletes them."""
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")).distinct()
    return versions.apply_changes(state, feed(table(spark, sf_dir, "events")), "key", ["ts", "event_id"])


@query(_APPLIED + "SELECT key, op, event_id FROM l WHERE r = 1")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_changes(feed(table(spark, sf_dir, "events")), "key", ["ts", "event_id"]).select("key", "op", "event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def change_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.resequence(feed(table(spark, sf_dir, "events")), "key", ["ts", "event_id"]).select("event_id", "seq")


@query(_VERSIONS + "SELECT (SELECT count(*) FROM d) = 0 AS unchanged, (SELECT count(*) FROM prev) AS previous_entries, (SELECT count(*) FROM cur) AS entries")
def skip_empty_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a commit can be skipped, by the fingerprints of both versions."""
    prev, cur = listings(spark, sf_dir)
    a = versions.version_fingerprint(prev).select(F.col("entries").alias("previous_entries"), F.col("digest").alias("before"))
    return a.join(F.broadcast(versions.version_fingerprint(cur))).select((F.col("before") == F.col("digest")).alias("unchanged"), "previous_entries", "entries")


@query(_APPLIED + "SELECT key, value, event_id FROM l WHERE r = 1 AND op <> 'delete'")
def apply_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream of files, applied in micro-batches to versioned state."""
    import uuid

    from tessera.lineage import shared_dir
    from tessera.streaming.changes import ChangeState

    path = f"{sf_dir}/events.parquet"
    kind = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(kind).option("pathGlobFilter", name).option("maxFilesPerTrigger", 4).parquet(folder)
    if spark.read.option("pathGlobFilter", name).schema(kind).parquet(folder).isEmpty():  # a folder of files
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(path)
    state = ChangeState(spark, f"{shared_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}", "key", ["ts", "event_id"])
    state.run(feed(stream))
    live = state.live()
    return live.select("key", "value", "event_id") if live is not None else feed(spark.read.parquet(path)).select("key", "value", "event_id").limit(0)
