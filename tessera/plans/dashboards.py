"""Nations as backup profiles of regions' stores, events as their snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dashboard
from tessera.plans.registry import query, table

_SQL = """
WITH p AS (SELECT n_name AS name, n_nationkey AS k, 'region-' || n_regionkey AS store, CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' ELSE 'nothing' END AS kind FROM nation),
l AS (SELECT p.name, e.event_id::VARCHAR AS ref, e.ts FROM p JOIN events e ON e.event_type = p.kind QUALIFY row_number() OVER (PARTITION BY p.name ORDER BY e.ts DESC, e.event_id::VARCHAR) = 1)
"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kind = F.element_at(F.array(*map(F.lit, ("click", "view", "signup", "purchase", "nothing"))), F.col("n_nationkey") % 5 + 1)
    profiles = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("local:/"), kind).alias("source"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("store"), F.lit("").alias("auth_ref"), (F.col("n_nationkey") != 7).alias("enabled")
    )
    have = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ref"), F.col("ts").alias("created"), F.struct(F.lit("local").alias("type"), F.concat(F.lit("/"), "event_type").alias("path"), F.lit("").alias("drive_name")).alias("source"))
    return profiles, have


@query(_SQL + "SELECT p.name, l.ref AS last_ref, l.ts AS last_created FROM p LEFT JOIN l USING (name)")
def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.latest_backups(*_inputs(spark, sf_dir))


@query(_SQL + "SELECT p.name, e.event_id::VARCHAR AS ref FROM p JOIN events e ON e.event_type = p.kind")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.history(*_inputs(spark, sf_dir)).select("name", "ref")


@query(
    _SQL
    + """SELECT p.name, CASE WHEN k = 7 THEN 'disabled' WHEN store = 'region-4' THEN 'error' WHEN store = 'region-3' THEN 'warning' ELSE 'ready' END AS status,
  CASE WHEN k = 7 THEN 'profile disabled' WHEN store = 'region-4' THEN 'missing store' WHEN store = 'region-3' THEN 'repository not initialized' WHEN store IN ('region-0', 'region-1') AND l.ref IS NULL THEN 'never backed up' ELSE '' END AS note,
  CASE WHEN k = 7 THEN 'disabled' WHEN store = 'region-4' THEN 'missing_store' WHEN store = 'region-3' THEN 'not_initialized' WHEN store = 'region-2' THEN 'pending' ELSE 'ready' END AS store_health,
  CASE WHEN k <> 7 AND store = 'region-2' THEN 'pending' ELSE 'reachable' END AS reachability,
  CASE WHEN k <> 7 AND store = 'region-3' THEN 'not_initialized' WHEN store IN ('region-0', 'region-1') THEN 'initialized' ELSE 'unknown' END AS repository,
  CASE WHEN l.ts IS NULL THEN 'never' WHEN l.ts + INTERVAL 7 DAY >= TIMESTAMP '2024-02-05' THEN 'recent' ELSE 'stale' END AS freshness, l.ref AS last_ref, k <> 7 AS enabled,
  CASE WHEN k = 7 OR store = 'region-4' THEN '' WHEN store = 'region-3' THEN 'init' ELSE 'backup,check' END AS actions FROM p LEFT JOIN l USING (name)"""
)
def profile_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, have = _inputs(spark, sf_dir)
    region = F.concat(F.lit("region-"), F.col("r_regionkey").cast("string"))
    regions = table(spark, sf_dir, "region")
    stores = regions.where("r_regionkey <> 4").select(region.alias("name"))
    probes = regions.where("r_regionkey in (0, 1, 3)").select(region.alias("store"), F.when(F.col("r_regionkey") == 3, "error").otherwise("ok").alias("status"), F.when(F.col("r_regionkey") == 3, "open: repository not initialized yet").alias("error"))
    credentials = regions.limit(0).select(F.lit("").alias("name"), F.lit("").alias("provider"))
    return dashboard.profile_status(profiles, stores, credentials, probes, have, F.lit("2024-02-05 00:00:00").cast("timestamp_ntz"))


@query(
    """SELECT n_name AS name, CASE WHEN n_nationkey % 9 = 0 THEN '' ELSE 'gdrive:/' || n_name END AS source, 'region-' || n_regionkey AS store, CASE WHEN n_regionkey <> 4 THEN 's3:bucket-' || n_regionkey ELSE '' END AS store_uri,
  CASE WHEN n_nationkey % 5 = 0 THEN 'lost' WHEN n_nationkey % 5 = 1 THEN '' ELSE 'drive' END AS auth_ref, CASE WHEN n_nationkey % 5 > 1 THEN 'google' ELSE '' END AS provider,
  CASE WHEN n_nationkey % 9 = 0 THEN 'empty source' WHEN n_regionkey = 4 THEN 'unknown store' WHEN n_nationkey % 5 = 0 THEN 'unknown auth' ELSE '' END AS error FROM nation"""
)
def effective_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with their stores and credentials, of which some aren't known."""
    key, region = F.col("n_nationkey"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))
    profiles = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.when(key % 9 != 0, F.concat(F.lit("gdrive:/"), "n_name")).alias("source"), region.alias("store"), F.when(key % 5 == 0, "lost").when(key % 5 == 1, "").otherwise("drive").alias("auth_ref")
    )
    stores = table(spark, sf_dir, "region").where("r_regionkey <> 4").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("name"), F.concat(F.lit("s3:bucket-"), F.col("r_regionkey").cast("string")).alias("uri"))
    credentials = spark.range(1).select(F.lit("drive").alias("name"), F.lit("google").alias("provider"))
    return dashboard.effective_profiles(profiles, stores, credentials)
