"""Events and orders as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import materialise
from tessera.operators import retention, snapshots
from tessera.operators.retention import Policy
from tessera.plans.registry import QUERIES, SQL, query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots: the type is the source's; signups have an identity, purchases a path id too."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("ref"), F.col("ts").alias("created"), F.col("event_id").alias("seq"),
        F.struct(
            F.col("event_type").alias("type"), F.concat(F.lit("u"), user).alias("account"), F.concat(F.lit("/"), "event_type").alias("path"),
            F.when(F.col("event_type").isin("signup", "purchase"), F.concat(F.lit("id"), user)).otherwise("").alias("identity"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), user)).otherwise("").alias("path_id"),
        ).alias("source"),
        F.array(F.col("event_type"), F.when(F.col("value") > 50, "large").otherwise("small")).alias("tags"), F.col("event_type"), F.col("user_id"),
    )


_EVENTS = """
WITH s AS (SELECT event_id::VARCHAR AS ref, ts AS created, event_id AS seq, event_type AS type, 'u' || user_id AS account, '/' || event_type AS path,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'id' || user_id ELSE '' END AS identity, CASE WHEN event_type = 'purchase' THEN 'p' || user_id ELSE '' END AS path_id, value, user_id FROM events)
"""


def _kept_sql(source: str, rules: dict[str, int], last: int = 0) -> str:
    """Islands of equal labels, per rule."""
    labels = {"hourly": "%Y-%m-%d %H", "daily": "%Y-%m-%d", "weekly": "%G-W%V", "monthly": "%Y-%m", "yearly": "%Y"}
    fresh = ", ".join(f"strftime(created, '{labels[r]}') IS DISTINCT FROM lag(strftime(created, '{labels[r]}')) OVER w AS new_{r}" for r in rules)
    seen = ", ".join(f"sum(new_{r}::INT) OVER (PARTITION BY g ORDER BY created DESC, ref ROWS UNBOUNDED PRECEDING) AS seen_{r}" for r in rules)
    reasons = ([f"CASE WHEN n <= {last} THEN 'last' END"] if last else []) + [f"CASE WHEN new_{r} AND seen_{r} <= {n} THEN '{r} snapshot' END" for r, n in rules.items()]
    any_kept = " OR ".join(([f"n <= {last}"] if last else []) + [f"(new_{r} AND seen_{r} <= {n})" for r, n in rules.items()]) or "false"
    return f"""
WITH base AS ({source}),
a AS (SELECT *, row_number() OVER w AS n{", " + fresh if fresh else ""} FROM base WINDOW w AS (PARTITION BY g ORDER BY created DESC, ref)),
b AS (SELECT *{", " + seen if seen else ""} FROM a)
SELECT ref, {any_kept} AS kept, concat_ws(', ', {", ".join(reasons) or "NULL"}) AS reasons FROM b"""


_EVENT_GROUPS = "SELECT event_id::VARCHAR AS ref, ts AS created, event_type AS g FROM events"
_ORDER_GROUPS = "SELECT o_orderkey::VARCHAR AS ref, o_orderdate AS created, o_orderpriority AS g FROM orders"


def _keep(name: str, policy: Policy, orders: bool) -> None:
    rules = {r: n for r in ("hourly", "daily", "weekly", "monthly", "yearly") if (n := getattr(policy, r))}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if orders:
            rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("ref"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("g"))
        else:
            rows = events(spark, sf_dir).select("ref", "created", F.col("event_type").alias("g"))
        return retention.apply_policy(rows, policy, ["g"]).select("ref", "kept", F.array_join("reasons", ", ").alias("reasons"))

    QUERIES[name] = run
    SQL[name] = _kept_sql(_ORDER_GROUPS if orders else _EVENT_GROUPS, rules, policy.last)


for _name, _policy, _orders in (
    ("keep_last", Policy(last=5), False), ("keep_hourly", Policy(hourly=24), False), ("keep_daily", Policy(daily=7), False), ("keep_weekly", Policy(weekly=4), False),
    ("keep_monthly", Policy(monthly=12), True), ("keep_yearly", Policy(yearly=3), True), ("keep_policy_reasons", Policy(last=3, hourly=6, daily=7, weekly=4, monthly=6, yearly=2), True),
):
    _keep(_name, _policy, _orders)


@query("SELECT event_id::VARCHAR AS ref, false AS kept FROM events WHERE event_type = 'error'")
def forget_filter_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter without a policy removes every match."""
    return retention.forget(events(spark, sf_dir), Policy(), ["event_type"], snapshots.matches(source="error")).select("ref", "kept")


@query(
    _EVENTS
    + "SELECT 'source:' || type || ', account:' || CASE WHEN identity <> '' THEN identity ELSE account END || ', path:' || CASE WHEN path_id <> '' THEN path_id ELSE path END AS \"group\", count(*) AS snapshots, max(created) AS newest FROM s GROUP BY 1"
)
def group_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.group_snapshots(events(spark, sf_dir)).select("group", "snapshots", "newest")


@query(_EVENTS + "SELECT 'source:' || type || ', tags:' || array_to_string(list_sort([type, CASE WHEN value > 50 THEN 'large' ELSE 'small' END]), ',') AS \"group\", count(*) AS snapshots FROM s GROUP BY 1")
def group_snapshots_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.group_snapshots(events(spark, sf_dir), "source,tags").select("group", "snapshots")


@query(_EVENTS + "SELECT ref FROM s WHERE type = 'click' AND value > 50")
def snapshot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(snapshots.matches(source="click", path="/click", tags=["click", "large"])).select("ref")


@query(_EVENTS + "SELECT ref, seq FROM s ORDER BY seq DESC, created DESC, ref LIMIT 1")
def latest_by_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest(events(spark, sf_dir))


@query(_EVENTS + "SELECT (max(seq) + 1)::BIGINT AS next_seq FROM s")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.next_sequence(events(spark, sf_dir))


@query(
    _EVENTS
    + """, w AS (SELECT DISTINCT user_id || ':' || type AS id, type, account, path, 'id' || user_id AS identity, 'p' || user_id AS path_id FROM s),
m AS (SELECT w.id, s.ref, s.created, CASE WHEN s.identity = w.identity AND s.path_id = w.path_id THEN 0 WHEN s.identity = w.identity AND s.path = w.path THEN 1 ELSE 2 END AS tier
  FROM w JOIN s ON s.type = w.type AND ((s.identity = w.identity AND (s.path_id = w.path_id OR s.path = w.path)) OR (s.account = w.account AND s.path = w.path)))
SELECT id, ref, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, created DESC, ref) AS r FROM m) WHERE r = 1"""
)
def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    user = F.col("user_id").cast("string")
    wanted = rows.select(F.concat_ws(":", user, "event_type").alias("id"), "source.type", "source.account", "source.path", F.concat(F.lit("id"), user).alias("identity"), F.concat(F.lit("p"), user).alias("path_id")).distinct()
    return snapshots.previous(rows, wanted)


_CATALOG = ", live AS (SELECT ref FROM s WHERE type <> 'error'), listed AS (SELECT ref FROM s WHERE type <> 'signup') "


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir)
    return rows.where("event_type <> 'error'"), rows.where("event_type <> 'signup'")


@query(_EVENTS + _CATALOG + "SELECT coalesce(l.ref, c.ref) AS ref, CASE WHEN c.ref IS NULL THEN 'missing' WHEN l.ref IS NULL THEN 'stale' ELSE 'present' END AS state FROM live l FULL OUTER JOIN listed c ON l.ref = c.ref")
def catalog_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.reconcile(*_catalog(spark, sf_dir))


@query(_EVENTS + _CATALOG + "SELECT count(*) AS summaries, count(DISTINCT ref) AS refs FROM (SELECT ref FROM listed UNION SELECT ref FROM live)")
def catalog_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, listed = _catalog(spark, sf_dir)
    return snapshots.append_summaries(listed.select("ref", "seq"), live.select("ref", "seq")).agg(F.count("*").alias("summaries"), F.countDistinct("ref").alias("refs"))


@query(_EVENTS + _CATALOG + "SELECT ref FROM listed WHERE ref NOT IN (SELECT ref FROM s WHERE type = 'error')")
def catalog_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, listed = _catalog(spark, sf_dir)
    return snapshots.remove_summaries(listed.select("ref"), listed.where("event_type = 'error'"))


@query(_EVENTS + "SELECT ref, row_number() OVER (ORDER BY created DESC, ref) AS position FROM s QUALIFY position <= 100")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-100 report."""
    from pyspark.sql import Window

    top = snapshots.newest_first(events(spark, sf_dir)).limit(100)
    return top.select("ref", F.row_number().over(Window.orderBy(F.col("created").desc(), "ref")).cast("long").alias("position"))


@query(_EVENTS + "SELECT ref, row_number() OVER (ORDER BY created DESC, ref) AS position FROM s")
def all_snapshots_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of all snapshots. Ranges are sorted apart, and each is numbered from the rows before it."""
    from pyspark.sql import Window

    rows = materialise(snapshots.newest_first(events(spark, sf_dir)).select("ref", F.monotonically_increasing_id().alias("id")))
    part = F.shiftright("id", 33)
    before = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), part == F.col("part")).select("ref", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1).alias("position"))


@query(
    _EVENTS
    + """, l AS (SELECT type, max(created) AS created FROM s GROUP BY type)
SELECT type, created AS newest, CASE WHEN created + INTERVAL 7 DAY >= TIMESTAMP '2024-02-05 00:00:00' THEN 'recent' ELSE 'stale' END AS freshness FROM l"""
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = events(spark, sf_dir).groupBy("source.type").agg(F.max("created").alias("newest"))
    return newest.select("type", "newest", snapshots.freshness(F.col("newest"), F.lit("2024-02-05 00:00:00").cast("timestamp_ntz")).alias("freshness"))
