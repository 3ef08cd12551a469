"""Listings of sources, and the text functions that they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashes, text
from tessera.plans.registry import query, table
from tessera.sources import listing


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashes.sha256_hex(F.col("text")).alias("digest"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/' || c_name WHEN 1 THEN '/' || c_name WHEN 2 THEN '/' ELSE '/' END AS path FROM customer")
def leading_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("c_custkey") % 4
    path = F.when(at == 0, F.col("c_name")).when(at == 1, F.concat(F.lit("/"), "c_name")).when(at == 2, "")
    return table(spark, sf_dir, "customer").select("c_custkey", text.leading_slash(path).alias("path"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'docs/' || c_name WHEN 1 THEN '' ELSE c_name END AS path FROM customer")
def drive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the root of a cloud drive."""
    at = F.col("c_custkey") % 3
    path = F.when(at == 0, F.concat(F.lit("/drives/b!x/root:/docs/"), "c_name")).when(at == 1, "/drive/root:").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_drive_root(path).alias("path"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE '' END AS value FROM customer")
def first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag, else the environment, else the profile."""
    at = F.col("c_custkey") % 3
    values = (F.when(at == 0, F.col("c_name")).otherwise("  "), F.when(at == 1, F.col("c_mktsegment")), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.first_non_empty(*values).alias("value"))


@query("SELECT o_orderkey, 'snapshot/' || CASE o_orderkey % 4 WHEN 0 THEN 'newest' WHEN 1 THEN 'newest' ELSE o_orderkey::VARCHAR END AS key FROM orders")
def snapshot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as users give them: latest, none, bare and with the prefix."""
    at, own = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    given = F.when(at == 0, "latest").when(at == 1, "").when(at == 2, own).otherwise(F.concat(F.lit("snapshot/"), own))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.snapshot_key(given, F.lit("snapshot/newest")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(epoch(date_trunc('second', ts)))::BIGINT - 7200 END AS seconds FROM events")
def rfc3339_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with an offset of two hours; some don't parse."""
    shown = F.when(F.col("event_id") % 5 == 0, "yesterday").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return table(spark, sf_dir, "events").select("event_id", text.epoch_seconds(shown).alias("seconds"))


@query("SELECT '/mnt/' || n_name || ' é' AS mount, bool_or(n_regionkey % 2 = 1) AS portable FROM nation GROUP BY 1")
def mount_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mount points with octal escapes, of which one is two bytes of a letter."""
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("/dev/x /mnt/"), F.replace("n_name", F.lit(" "), F.lit("\\040")), F.lit("\\040\\303\\251 ext4 rw")).alias("value"), (F.col("n_regionkey") % 2 == 1).alias("portable"))
    return listing.mounts(lines)


_ITEMS = "SELECT o_orderkey AS k, o_orderstatus AS s, 'order ' || o_orderkey AS n FROM orders"


@query(
    f"""SELECT k::VARCHAR AS file_id, n || CASE s WHEN 'F' THEN '.docx' ELSE '' END AS name, CASE s WHEN 'P' THEN 'folder' ELSE 'file' END AS type, (k % 10)::VARCHAR AS parent,
  CASE s WHEN 'O' THEN k ELSE 0 END::BIGINT AS size, CASE WHEN k % 2 = 0 THEN 1704067200 ELSE 0 END::BIGINT AS mtime, s = 'F' AS native FROM ({_ITEMS})"""
)
def drive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive items as files: native documents under their export names, folders, and files with a size."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    items = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("order "), k).alias("name"), F.when(s == "F", "application/vnd.google-apps.document").when(s == "P", "application/vnd.google-apps.folder").otherwise("text/plain").alias("mimeType"),
        F.array((k % 10).cast("string")).alias("parents"), F.lit(None).cast("string").alias("sha256Checksum"), F.when(s == "O", k).alias("size"), F.when(k % 2 == 0, "2024-01-01T00:00:00Z").otherwise("?").alias("modifiedTime"),
        F.lit(None).cast("array<struct<emailAddress:string>>").alias("owners"), F.lit(None).cast("string").alias("headRevisionId"),
    )
    return listing.drive_files(items).select("file_id", "name", "type", F.get("parents", F.lit(0)).alias("parent"), "size", "mtime", "native")


@query(
    f"""SELECT CASE WHEN k % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, k::VARCHAR AS file_id, CASE WHEN k % 5 <> 0 THEN CASE s WHEN 'P' THEN 'folder' ELSE 'file' END END AS type,
  CASE WHEN k % 5 <> 0 THEN n END AS path FROM ({_ITEMS}) WHERE k % 5 = 0 OR (k % 3 = 0 AND k % 7 <> 0)"""
)
def delta_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta items below a folder: deletes, files and folders; packages and what lies elsewhere are left out."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    live, folder = k % 5 != 0, F.col("o_orderstatus") == "P"
    items = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("order "), k).alias("name"), k.alias("size"), F.lit("2024-01-01T00:00:00Z").alias("lastModifiedDateTime"),
        F.when(live & (s != "P"), F.struct(F.lit("t").alias("mimeType"))).alias("file"), F.when(live & folder, F.struct(F.lit(1).alias("childCount"))).alias("folder"), F.when(live & (k % 7 == 0), F.struct(F.lit("oneNote").alias("type"))).alias("package"),
        F.when(~live, F.struct(F.lit("deleted").alias("state"))).alias("deleted"), F.struct(F.lit("p").alias("id"), F.when(k % 3 == 0, "/drive/root:/work/docs").otherwise("/drive/root:/else").alias("path")).alias("parentReference"),
    )
    return listing.below_root(listing.graph_files(items), "/work/docs").select("op", "file_id", "type", "path")
