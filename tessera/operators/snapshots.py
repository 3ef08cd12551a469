"""The snapshot catalog: filters, groups, latest and previous snapshots, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import group_label

_EMPTY = ""


def _source(field: str) -> Column:
    return F.coalesce(F.col(f"source.{field}"), F.lit(_EMPTY))


def matches(source: str | None = None, account: str | None = None, path: str | None = None, tags: list[str] | None = None) -> Column:
    """Snapshots of a source type, of an account or identity, of a path or path id, with all of the tags."""
    out = F.lit(True)
    if source:
        out = out & (_source("type") == source)
    if account:
        out = out & ((_source("account") == account) | (_source("identity") == account))
    if path:
        out = out & ((_source("path") == path) | ((_source("path_id") == path) & (_source("path_id") != _EMPTY)))
    if tags:
        out = out & (F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return F.coalesce(out, F.lit(False))


def group_columns(by: str | None = None) -> dict[str, Column]:
    """Columns of the group named by a comma list of source, account, path, tags; unknown names are ignored.

    None is source,account,path; the empty list is one group. Identity and path id come before account and path.
    """
    names = {"source", "account", "path"} if by is None else {x.strip() for x in by.split(",")}
    tags = F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ",")
    every = {
        "source": _source("type"),
        "account": F.coalesce(F.nullif(_source("identity"), F.lit(_EMPTY)), _source("account")),
        "path": F.coalesce(F.nullif(_source("path_id"), F.lit(_EMPTY)), _source("path")),
        "tags": tags,
    }
    return {n: c if n in names else F.lit(_EMPTY) for n, c in every.items()}


def group_snapshots(snapshots: DataFrame, by: str | None = None) -> DataFrame:
    """Groups with their label, number of snapshots and newest time, newest first."""
    keys = group_columns(by)
    grouped = snapshots.groupBy(*[c.alias(f"group_{n}") for n, c in keys.items()]).agg(F.count("*").alias("snapshots"), F.max("created").alias("newest"))
    label = group_label(*[F.col(f"group_{n}") for n in keys])
    return grouped.withColumn("group", label).orderBy(F.col("newest").desc(), "group")


def latest(snapshots: DataFrame) -> DataFrame:
    """One row, ref and seq: the highest sequence, then the newest, then the smallest ref. None for an empty catalog."""
    best = snapshots.agg(F.max(F.struct("seq", "created")).alias("top"))
    ref = snapshots.join(F.broadcast(best), F.struct("seq", "created") == F.col("top"))  # one row
    return ref.groupBy("seq").agg(F.min("ref").alias("ref")).select("ref", "seq")


def next_sequence(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def number_snapshots(new: DataFrame, snapshots: DataFrame) -> DataFrame:
    """new with seq after those of snapshots, by created then ref. A batch of commits is small: its ranks are one window."""
    base = next_sequence(snapshots)
    ranked = new.drop("seq").withColumn("_rank", F.row_number().over(Window.orderBy("created", "ref")))
    return ranked.join(F.broadcast(base)).withColumn("seq", (F.col("next_seq") + F.col("_rank") - 1).cast("long")).drop("_rank", "next_seq")


def previous(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row of wanted (id, type, account, path, identity, path_id) the ref of the snapshot to compare with.

    First by identity and path id, then by identity and path, then by account and path; the newest inside a tier, ties by
    ref. Each tier is an equi-join of its own, so no pair beyond those that match is made.
    """
    s = snapshots.select("ref", "created", *[_source(f).alias(f"_{f}") for f in ("type", "account", "path", "identity", "path_id")])
    w = wanted.select("id", *[F.coalesce(f, F.lit(_EMPTY)).alias(f) for f in ("type", "account", "path", "identity", "path_id")])
    tiers = ((("identity", "path_id"), ("identity", "path_id")), (("identity", "path"), ("identity",)), (("account", "path"), ()))
    found = None
    for tier, (fields, filled) in enumerate(tiers):
        keys = ("type", *fields)
        newest = s.groupBy(*[f"_{k}" for k in keys]).agg(F.min(F.struct((-F.unix_micros(F.col("created").cast("timestamp"))).alias("age"), "ref")).alias("best"))
        asked = w
        for f in filled:
            asked = asked.where(F.col(f) != _EMPTY)
        on = [F.col(k) == F.col(f"_{k}") for k in keys]
        hit = asked.join(newest, on).select("id", F.lit(tier).alias("tier"), F.col("best.ref").alias("ref"))
        found = hit if found is None else found.union(hit)
    best = found.groupBy("id").agg(F.min(F.struct("tier", "ref")).alias("best"))
    return w.select("id").join(best, "id", "left").select("id", F.col("best.ref").alias("ref"), F.col("best.tier").alias("tier"))


def reconcile(live: DataFrame, catalog: DataFrame) -> DataFrame:
    """ref, state: present, missing (stored, not in the catalog: to be fetched) or stale (to be dropped)."""
    a = live.select("ref", F.lit(1).alias("_live")).distinct()
    b = catalog.select("ref", F.lit(1).alias("_listed")).distinct()
    state = F.when(F.col("_listed").isNull(), "missing").when(F.col("_live").isNull(), "stale").otherwise("present")
    return a.join(b, "ref", "full_outer").select("ref", state.alias("state"))


def append_summaries(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """catalog with new summaries; a ref that is there already is replaced."""
    return catalog.join(new.select("ref"), "ref", "left_anti").unionByName(new.select(*catalog.columns))


def remove_summaries(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    return catalog.join(refs.select("ref"), "ref", "left_anti")


def summary(snapshots: DataFrame) -> DataFrame:
    """The columns that a listing needs."""
    return snapshots.select("ref", "seq", "created", "root", "source", "tags", "change_token", "exclude_hash")


def freshness(created: Column, as_of: Column, days: int = 7) -> Column:
    """never (null), recent or stale at an explicit time."""
    return F.when(created.isNull(), "never").when(created + F.make_dt_interval(F.lit(days)) >= as_of, "recent").otherwise("stale")


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.col("created").desc(), "ref")
