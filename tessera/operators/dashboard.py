"""Profiles against their stores, credentials and snapshots: health, states, history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import leading_slash, probe_error
from tessera.operators.snapshots import freshness

#: Source schemes with a drive, by the provider that signs in to them.
PROVIDERS = {"gdrive": "google", "gdrive-changes": "google", "onedrive": "onedrive", "onedrive-changes": "onedrive"}
#: Providers whose credentials need a stored token.
TOKEN_COLUMNS = {"google": ("google_token_file", "google_token_ref"), "onedrive": ("onedrive_token_file", "onedrive_token_ref")}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def source_key(uri: Column) -> Column:
    """struct(type, path, drive) of a source address; empty type where the scheme is unknown."""
    scheme = F.when(uri.contains(":"), F.substring_index(uri, ":", 1)).otherwise(uri)
    rest = F.when(uri.contains(":"), F.regexp_extract(uri, r"(?s)^[^:]*:(.*)$", 1)).otherwise("")
    cloud, disk = scheme.isin(*PROVIDERS), scheme.isin("local", "sftp") & uri.contains(":")
    named = rest.startswith("//")
    host = F.regexp_extract(rest, r"(?s)^//([^/]*)", 1)
    below = F.regexp_extract(rest, r"(?s)^//[^/]*/?(.*)$", 1)
    path = F.when(disk, rest).when(cloud & named, leading_slash(below)).when(cloud, leading_slash(rest)).otherwise("")
    kind = F.when(cloud | disk, scheme).otherwise("")
    return F.struct(F.coalesce(kind, F.lit("")).alias("type"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.when(cloud & named, host), F.lit("")).alias("drive"))


def provider(uri: Column) -> Column:
    """The provider that a source signs in to; empty for local ones."""
    kind, out = source_key(uri)["type"], F.lit("")
    for scheme, name in PROVIDERS.items():
        out = F.when(kind == scheme, name).otherwise(out)
    return out


def source_snapshots(profiles: DataFrame, snapshots: DataFrame) -> DataFrame:
    """name, ref, created of the snapshots of each profile's source.

    profiles: name, source. snapshots: ref, created, source (struct). One equi-join on type, and on path where the profile
    has one; drive names are compared only when both are set.
    """
    asked = profiles.select("name", source_key(F.col("source")).alias("k")).where("k.type <> ''")
    have = snapshots.select("ref", "created", F.col("source.type").alias("_type"), F.coalesce("source.path", F.lit("")).alias("_path"), F.coalesce("source.drive_name", F.lit("")).alias("_drive"))
    drives = (F.col("k.drive") == "") | (F.col("_drive") == "") | (F.col("k.drive") == F.col("_drive"))
    with_path = asked.where("k.path <> ''").join(have, (F.col("k.type") == F.col("_type")) & (F.col("k.path") == F.col("_path")) & drives)
    any_path = asked.where("k.path = ''").join(have, (F.col("k.type") == F.col("_type")) & drives)
    return with_path.union(any_path).select("name", "ref", "created")


def latest_backups(profiles: DataFrame, snapshots: DataFrame) -> DataFrame:
    """name, last_ref, last_created: the newest snapshot of each profile's source, ties by the smallest ref; nulls without any."""
    found = source_snapshots(profiles, snapshots)
    newest = found.groupBy("name").agg(F.max("created").alias("last_created"))
    first = found.join(newest, "name").where("created = last_created").groupBy("name", "last_created").agg(F.min("ref").alias("last_ref"))
    return profiles.select("name").join(first, "name", "left").select("name", "last_ref", "last_created")


def history(profiles: DataFrame, snapshots: DataFrame) -> DataFrame:
    """source_snapshots(), newest first inside each profile."""
    return source_snapshots(profiles, snapshots).orderBy("name", F.col("created").desc(), "ref")


def credential_health(credentials: DataFrame) -> DataFrame:
    """credentials with status and note: unknown providers are errors, missing tokens warnings."""
    known, token = F.lit(False), F.lit(False)
    for name, columns in TOKEN_COLUMNS.items():
        here = F.col("provider") == name
        known = known | here
        token = token | (here & ((_text(columns[0]) != "") | (_text(columns[1]) != "")))
    status = F.when(~F.coalesce(known, F.lit(False)), "error").when(token, "ready").otherwise("warning")
    note = F.when(status == "error", "unknown provider").when(status == "warning", "missing token storage").otherwise("")
    return credentials.withColumn("status", status).withColumn("note", note)


def store_health(stores: DataFrame) -> DataFrame:
    """stores with status and note: an address is missing, has no known scheme, or is fine."""
    uri = _text("uri")
    valid = uri.rlike(r"^(local:.+|s3:.+|b2:.+|sftp://.+)$")
    status = F.when(valid, "ready").otherwise("error")
    return stores.withColumn("status", status).withColumn("note", F.when(uri == "", "missing uri").when(~valid, "invalid uri").otherwise(""))


def profile_status(profiles: DataFrame, stores: DataFrame, credentials: DataFrame, probes: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """One row per profile: status, note, store_health, reachability, repository, freshness, last_ref, enabled.

    The first fault decides. probes: store, status, error. Ordered by name.
    """
    base = profiles.select("name", "source", _text("store").alias("store"), _text("auth_ref").alias("auth_ref"), F.coalesce("enabled", F.lit(True)).alias("enabled"))
    joined = (
        base.join(stores.select(F.col("name").alias("_store"), F.lit(True).alias("_has_store")), F.col("store") == F.col("_store"), "left")
        .join(credentials.select(F.col("name").alias("_auth"), _text("provider").alias("_provider")), F.col("auth_ref") == F.col("_auth"), "left")
        .join(probes.select(F.col("store").alias("_probe"), F.col("status").alias("_status"), probe_error(F.coalesce("error", F.lit(""))).alias("_error")), F.col("store") == F.col("_probe"), "left")
        .join(latest_backups(profiles, snapshots), "name", "left")
    )
    wants, has_auth = provider(F.col("source")), F.col("_auth").isNotNull()
    no_store = F.col("_has_store").isNull()
    lost = (F.col("auth_ref") != "") & ~has_auth
    other = has_auth & (wants != "") & (F.col("_provider") != "") & (F.col("_provider") != wants)
    unsigned = (wants != "") & (F.col("auth_ref") == "")
    fault = (
        F.when(~F.col("enabled"), "profile disabled").when(F.col("store") == "", "no store ref").when(no_store, "missing store").when(lost, "missing auth ref").when(other, "provider mismatch").when(unsigned, "missing auth")
    )
    failed, fine = F.col("_status") == "error", F.col("_status") == "ok"
    status = F.when(~F.col("enabled"), "disabled").when(fault.isNotNull(), "error").when(failed, "warning").otherwise("ready")
    note = F.coalesce(fault, F.when(failed, F.when(F.col("_error") != "", F.col("_error")).otherwise("store unavailable")).when(fine & F.col("last_ref").isNull(), "never backed up"), F.lit(""))
    health = (
        F.when(~F.col("enabled"), "disabled").when((F.col("store") == "") | no_store, "missing_store").when(unsigned | lost, "missing_auth").when(other, "provider_mismatch")
        .when(failed & (F.col("_error") == "repository not initialized"), "not_initialized").when(failed, "unavailable").when(fine, "ready").otherwise("pending")
    )
    reach = F.when(health.isin("pending", "unavailable"), health).otherwise("reachable")
    repository = F.when(health == "not_initialized", "not_initialized").when(health.isin("unavailable", "pending"), "unknown").when(fine, "initialized").otherwise("unknown")
    out = joined.select("name", status.alias("status"), note.alias("note"), health.alias("store_health"), reach.alias("reachability"), repository.alias("repository"), freshness(F.col("last_created"), as_of).alias("freshness"), "last_ref", "enabled")
    return out.withColumn("actions", actions(F.col("status"), F.col("store_health"))).orderBy("name")


def effective_profiles(profiles: DataFrame, stores: DataFrame, credentials: DataFrame, given: Mapping[str, str] | None = None) -> DataFrame:
    """name, source, store, store_uri, auth_ref, provider, error: what a run of each profile uses.

    given: values that the user sets for this run (source, store_uri, auth_ref); they go before the profile's, and those
    of its store. A source that is empty, or a store or credential that is named but not known, is an error.
    """
    given = given or {}
    chosen = lambda name: F.lit(given[name]) if name in given else _text(name)
    base = profiles.select("name", chosen("source").alias("source"), _text("store").alias("store"), chosen("auth_ref").alias("auth_ref"))
    known_stores = stores.select(F.col("name").alias("_store"), _text("uri").alias("_uri"), F.lit(True).alias("_has_store"))
    known_auth = credentials.select(F.col("name").alias("_auth"), _text("provider").alias("provider"), F.lit(True).alias("_has_auth"))
    joined = base.join(known_stores, F.col("store") == F.col("_store"), "left").join(known_auth, F.col("auth_ref") == F.col("_auth"), "left")
    error = (
        F.when(F.col("source") == "", "empty source").when((F.col("store") != "") & F.col("_has_store").isNull(), "unknown store")
        .when((F.col("auth_ref") != "") & F.col("_has_auth").isNull(), "unknown auth").otherwise("")
    )
    uri = F.lit(given["store_uri"]) if "store_uri" in given else F.coalesce("_uri", F.lit(""))
    return joined.select("name", "source", "store", uri.alias("store_uri"), "auth_ref", F.coalesce("provider", F.lit("")).alias("provider"), error.alias("error"))


def actions(status: Column, health: Column) -> Column:
    """What may be run on a profile: init, or backup and check, or nothing."""
    return F.when(status.isin("disabled", "error"), "").when(health == "not_initialized", "init").otherwise("backup,check")


def used_by(profiles: DataFrame, column: str) -> DataFrame:
    """Names of the profiles that refer to each store (column store) or credential (column auth_ref), sorted."""
    return profiles.where(_text(column) != "").groupBy(column).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("profiles"))
