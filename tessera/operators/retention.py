"""Retention: which snapshots a policy keeps, and why.

All rules of a policy are windows over one ordering, so a policy of any number of rules costs one shuffle by group. A
time bucket is new where it differs from the bucket of the snapshot just before it in that order (islands, not distinct
labels): wall times of mixed offsets may show a label twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    last: int = 0
    hourly: int = 0
    daily: int = 0
    weekly: int = 0
    monthly: int = 0
    yearly: int = 0

    def empty(self) -> bool:
        return not any((self.last, self.hourly, self.daily, self.weekly, self.monthly, self.yearly))


def bucket(rule: str, wall: Column) -> Column:
    """The label of a wall time in hourly, daily, weekly (ISO), monthly or yearly buckets."""
    patterns = {"hourly": "yyyy-MM-dd HH", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
    if rule == "weekly":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), wall), F.weekofyear(wall))
    return F.date_format(wall, patterns[rule])


def apply_policy(snapshots: DataFrame, policy: Policy, group: list[str], created: str = "created", ref: str = "ref", wall: str | None = None) -> DataFrame:
    """snapshots with kept (boolean) and reasons (array, in rule order); newest first inside a group, ties by ref.

    created orders by instant, wall (created if not given) is the time that buckets show. An empty policy keeps nothing.
    """
    order = Window.partitionBy(*group).orderBy(F.col(created).desc(), ref)
    time = F.col(wall or created)
    out, found = snapshots, []
    if policy.last > 0:
        out = out.withColumn("_last", F.row_number().over(order))
        found.append(F.when(F.col("_last") <= policy.last, "last"))
    rules = [(r, n) for r in ("hourly", "daily", "weekly", "monthly", "yearly") if (n := getattr(policy, r)) > 0]
    for rule, _ in rules:
        out = out.withColumn(f"_{rule}", bucket(rule, time))
    for rule, _ in rules:
        out = out.withColumn(f"_{rule}_new", ~F.lag(f"_{rule}").over(order).eqNullSafe(F.col(f"_{rule}")))
    for rule, n in rules:
        out = out.withColumn(f"_{rule}_seen", F.sum(F.col(f"_{rule}_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        found.append(F.when(F.col(f"_{rule}_new") & (F.col(f"_{rule}_seen") <= n), f"{rule} snapshot"))
    reasons = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return out.select(*snapshots.columns, (F.size(reasons) > 0).alias("kept"), reasons.alias("reasons"))


def forget(snapshots: DataFrame, policy: Policy, group: list[str], keep_filter: Column | None = None, **names: str) -> DataFrame:
    """apply_policy() on the snapshots that the filter matches. A filter without a policy removes all matches; neither is an error."""
    if policy.empty() and keep_filter is None:
        raise ValueError("neither a policy nor a filter is given")
    return apply_policy(snapshots if keep_filter is None else snapshots.where(keep_filter), policy, group, **names)
