"""Runs for many targets at once: each user, group, project, OST or pool stops at its own limit.

The order is by target and, in it, by the run's own order. Rows are dealt into ranges of that order, so a target of half
of all rows spreads over many tasks, and small ones share a task. A range carries in what its first target has had in
the ranges before; that is one row a range, from the sums of each range's first and last target. All sums inside a range
use a window over (range, target).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .ruleset import PolicyText, Trigger


def _dealt(df: DataFrame, target: str, order: Sequence[str], amounts: Sequence[str], parts: int | None) -> DataFrame:
    """row, target, own_a and keys of the order, written once in ranges of (target, order) with their number."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = df.select(
        F.struct(*df.columns).alias("row"), F.col(target).alias("target"), *[F.col(o.lstrip("-")).alias(f"key_{i}") for i, o in enumerate(order)],
        *[F.coalesce(F.col(a), F.lit(0)).alias(f"own_{a}") for a in amounts],
    )
    return materialize(plain.repartitionByRange(n, F.asc("target"), *_sort(order)).withColumn("range_no", F.spark_partition_id()))


def _sort(order: Sequence[str]) -> list[Column]:
    return [F.desc(f"key_{i}") if o[0] == "-" else F.asc(f"key_{i}") for i, o in enumerate(order)]


def running_by_target(df: DataFrame, target: str, order: Sequence[str], amounts: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` as one struct column ``row`` with its ``target`` and, for each amount a, ``before_a``: the sum over the
    target's rows before it in ``order`` (names with a minus where descending). Null amounts count as 0."""
    ranged, sort = _dealt(df, target, order, amounts, parts), _sort(order)
    sums = ranged.groupBy("range_no", "target").agg(*[F.sum(f"own_{a}").alias(f"sum_{a}") for a in amounts])
    edges = ranged.groupBy("range_no").agg(F.min(F.struct("target")).alias("first"), F.max(F.struct("target")).alias("last"))
    at_edge = sums.join(F.broadcast(edges), "range_no").filter(F.col("target").eqNullSafe(F.col("first.target")) | F.col("target").eqNullSafe(F.col("last.target")))
    before = Window.partitionBy("target").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = at_edge.select("range_no", "target", "first", *[F.coalesce(F.sum(f"sum_{a}").over(before), F.lit(0)).alias(f"carry_{a}") for a in amounts])
    heads = carried.filter(F.col("target").eqNullSafe(F.col("first.target"))).select(F.col("range_no").alias("head_no"), F.col("target").alias("head_target"), *[f"carry_{a}" for a in amounts])
    own = Window.partitionBy("range_no", "target").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(heads), F.col("range_no") == F.col("head_no"))
    carry = lambda a: F.when(F.col("target").eqNullSafe(F.col("head_target")), F.col(f"carry_{a}")).otherwise(0)
    return joined.select("row", "target", *[(carry(a) + F.coalesce(F.sum(f"own_{a}").over(own), F.lit(0))).alias(f"before_{a}") for a in amounts])


def until_limits(df: DataFrame, target: str, order: Sequence[str], amounts: Sequence[str], limits: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of each target of ``limits`` (target and, by the amounts' names, how much; null or 0 is no limit) in ``order``
    while all that was taken before is below the limits: the row that crosses is in."""
    limit = limits.select(F.col("target").alias("limit_target"), *[F.coalesce(F.col(a), F.lit(0)).alias(f"limit_{a}") for a in amounts])
    wanted = df.join(limit, F.col(target) == F.col("limit_target"), "left_semi")
    rows = running_by_target(wanted, target, order, amounts, parts)
    below = reduce(lambda a, b: a & b, [(F.col(f"limit_{a}") == 0) | (F.col(f"before_{a}") < F.col(f"limit_{a}")) for a in amounts])
    return rows.join(limit, F.col("target") == F.col("limit_target")).filter(below).select("row.*")


def usage_targets(usage: DataFrame, high: float, low: float) -> DataFrame:
    """Of targets with ``used`` and ``total`` blocks, those at or above ``high`` percent and the blocks to free down to
    ``low`` percent. Taken fullest first (``rank`` from 1), one under the threshold ends the list."""
    pct = 100 * F.col("used") / F.col("total")
    above = usage.filter(pct >= high).select("target", pct.alias("used_pct"), F.greatest(F.lit(0), F.col("used") - F.floor(F.col("total") * low / 100)).cast("long").alias("blocks"))
    return above.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("used_pct"), "target")))


def owner_targets(entries: DataFrame, key: str, measure: str, high: float, low: float, listed: Sequence[str] = (), total: int | None = None) -> DataFrame:
    """Users or groups strictly above ``high``, with how much they have over ``low``, of ``blocks`` or ``count``. ``total``
    makes both limits percentages of it; ``listed`` names the only ones that count. Biggest first in ``rank``."""
    value = F.count(F.lit(1)) if measure == "count" else F.sum(measure)
    most, least = [F.lit(x) if total is None else F.lit(total) * x / 100 for x in (high, low)]
    rows = entries.filter(F.col(key).isin(*listed)) if listed else entries
    found = rows.groupBy(F.col(key).alias("target")).agg(value.alias("value")).filter(F.col("value") > most)
    return found.select("target", "value", (F.col("value") - F.floor(least)).cast("long").alias(measure)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "target")))


def once(df: DataFrame, key: str, targets: DataFrame, target: str = "target") -> DataFrame:
    """Of rows of entries on several targets, the one on the target of the least ``rank``: an entry is acted on once, for
    the fullest of its targets. Rows on targets that aren't listed go."""
    ranks = targets.select(F.col("target").alias("rank_target"), F.col("rank").alias("rank_no"))
    ranked = df.join(ranks, F.col(target) == F.col("rank_target"))
    best = ranked.groupBy(F.col(key).alias("best_key")).agg(F.min("rank_no").alias("best_no"))
    return ranked.join(best, (F.col(key) == F.col("best_key")) & (F.col("rank_no") == F.col("best_no"))).select(*df.columns)


def triggered(entries: DataFrame, trigger: Trigger, usage: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """The targets that a trigger read from text acts on, with their amounts. ``usage`` has used and total blocks of
    each target for triggers on OSTs and pools; ``total`` is what users' and groups' percentages are of."""
    if trigger.watched in ("ost_usage", "pool_usage", "global_usage"):
        if trigger.unit != "pct":
            raise ValueError(f"{trigger.watched} takes percentages")
        rows = usage.filter(F.col("target").isin(*trigger.targets)) if trigger.targets else usage
        return usage_targets(rows, trigger.high, trigger.low)
    if trigger.watched in ("user_usage", "group_usage", "user_count", "group_count"):
        key = "uid" if trigger.watched.startswith("user") else "gid"
        measure = "count" if trigger.watched.endswith("count") else "blocks"
        share = trigger.unit in ("pct", "cntpct")
        if share and total is None:
            raise ValueError("percentages need a total")
        scale = 1 / 512 if trigger.unit == "vol" else 1
        return owner_targets(entries, key, measure, trigger.high * scale, trigger.low * scale, trigger.targets, total if share else None)
    raise ValueError(f"a {trigger.watched} trigger has no targets")


def run_plan(candidates: DataFrame, policy: PolicyText, targets: DataFrame, target: str, amount: str, key: str = "id") -> DataFrame:
    """What a policy does for all targets of a trigger: in its order, until each target's amount is reached."""
    some = candidates.withColumn("count", F.lit(1)) if amount == "count" and "count" not in candidates.columns else candidates
    return until_limits(some, target, [*policy.order, key], [amount], targets).select(*candidates.columns)

