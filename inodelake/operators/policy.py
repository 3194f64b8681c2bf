"""Policies as set operations: classes, scopes, ignore rules, first matching rule, ordered selection, triggers.

A policy run is a plan table (id, rule, order, period ...); nothing is executed on a live filesystem.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions.scalar import wide
from ..storage import fitted, materialize


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Column
    target: Column | None = None
    params: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    """Scope, ignore conditions, ordered rules and an optional default rule."""

    name: str
    scope: Column
    rules: Sequence[Rule]
    ignore: Sequence[Column] = ()
    default: Rule | None = None

    def __post_init__(self) -> None:
        names = [r.name.lower() for r in self.rules]
        if len(set(names)) < len(names):
            raise ValueError(f"rule names repeat in policy {self.name}")


def classes(definitions: dict[str, Column]) -> Column:
    """Names of all classes that match, in order of declaration; null if none of them could be evaluated."""
    known = reduce(lambda a, b: a | b, [d.isNotNull() for d in definitions.values()])
    found = F.filter(F.array(*[F.when(d, F.lit(n)) for n, d in definitions.items()]), lambda x: x.isNotNull())
    return F.when(known, found)


def algebra(definitions: dict[str, Column], term: str | tuple) -> Column:
    """A class made of others: a name, or (``union`` | ``inter`` | ``not``, terms ...), evaluated in three values."""
    if isinstance(term, str):
        if term not in definitions:
            raise ValueError(f"unknown class {term}")
        return definitions[term]
    kind, *terms = term
    parts = [algebra(definitions, t) for t in terms]
    return ~parts[0] if kind == "not" else {"union": X.or_, "inter": X.and_}[kind](*parts)


def check_classes(defined: Sequence[str], targets: Sequence[tuple[str, Sequence[str]]], ignored: Sequence[str] = ()) -> None:
    """Raise where rules (name, classes) aren't clear: an unknown class, one of two rules, or one that is ignored too."""
    owner: dict[str, str] = {}
    known = {c.lower() for c in defined}
    for rule, names in [*targets, ("ignore", ignored)]:
        for name in map(str.lower, names):
            if name not in known:
                raise ValueError(f"{rule}: unknown class {name}")
            if owner.setdefault(name, rule) != rule:
                raise ValueError(f"class {name} is in {owner[name]} and in {rule}")


def whitelisted(ignore: Sequence[Column]) -> Column:
    """True if any ignore condition matches; else unknown if any of them is; else false."""
    if not ignore:
        return F.lit(False)
    any_match = reduce(lambda a, b: a | b, [F.coalesce(i, F.lit(False)) for i in ignore])
    unknown = reduce(lambda a, b: a | b, [i.isNull() for i in ignore])
    return F.when(any_match, F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def matching_rule(policy: Policy) -> Column:
    """The first rule whose target matches decides by its condition; a false condition does not fall through to the
    default. Unknown conditions and ignored entries match no rule."""
    out = F.when(~F.coalesce(policy.scope, F.lit(False)), F.lit(None).cast("string"))
    white = whitelisted(policy.ignore)
    out = out.when(white.isNull() | white, F.lit(None).cast("string"))
    for r in policy.rules:
        target = F.coalesce(r.target, F.lit(False)) if r.target is not None else F.lit(True)
        out = out.when(target, F.when(r.condition, F.lit(r.name)))
    return out.otherwise(F.when(policy.default.condition, F.lit(policy.default.name)) if policy.default else F.lit(None).cast("string"))


def candidates(entries: DataFrame, policy: Policy, target: Column | None = None) -> DataFrame:
    """Entries that the policy acts on, with their rule: valid, in scope, on the target."""
    rows = entries.filter(~F.coalesce(F.col("invalid"), F.lit(False)))
    if target is not None:
        rows = rows.filter(target)
    return rows.withColumn("rule", matching_rule(policy)).filter(F.col("rule").isNotNull())


def running(df: DataFrame, order: Sequence[str], amounts: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` as one struct column ``row`` with the sums of ``amounts`` over all rows before it in ``order`` (names of
    columns, with a minus where descending).

    The order is global but no task sees all rows: rows are dealt into ranges of the order and written once with their
    range, so that the ranges' sums and the rows agree; sums of longs are decimals, which have room for all of them; sums of the ranges before a range come from one small table (one
    row a range), and only sums inside a range use a window. There are as many ranges as shuffle partitions, which a
    cluster sets by its input's size, or ``parts``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"key_{i}" for i in range(len(order))]
    sort = [F.desc(k) if o[0] == "-" else F.asc(k) for k, o in zip(keys, order, strict=True)]
    plain = df.select(F.struct(*df.columns).alias("row"), *[F.col(o.lstrip("-")).alias(k) for o, k in zip(order, keys, strict=True)], *[v.alias(f"own_{a}") for a, v in amounts.items()])
    ranged = materialize(plain.repartitionByRange(n, *sort).withColumn("range_no", F.spark_partition_id()))
    amount = {a: wide(f"own_{a}", ranged.schema) for a in amounts}
    own = Window.partitionBy("range_no").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range_no").agg(*[F.sum(c).alias(f"sum_{a}") for a, c in amount.items()])
    heads = sums.select(F.col("range_no").alias("head_no"), *[F.coalesce(F.sum(f"sum_{a}").over(before), F.lit(0)).alias(f"head_{a}") for a in amounts])
    joined = ranged.join(F.broadcast(heads), F.col("range_no") == F.col("head_no"))
    return joined.select("row", *[F.col(f"own_{a}") for a in amounts], *[(F.col(f"head_{a}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"before_{a}") for a, c in amount.items()])


def until_limit(df: DataFrame, order: Sequence[str], amounts: dict[str, int], parts: int | None = None) -> DataFrame:
    """Rows in ``order`` while every running amount before the row is below its
    limit: the row that crosses is in."""
    keep = reduce(lambda a, b: a & b, [F.col(f"before_{a}") < limit for a, limit in amounts.items()])
    return running(df, order, {a: F.col(a) for a in amounts}, parts).filter(keep).select("row.*")


def effective_limit(*limits: int) -> int:
    """The least of those set (0 is unlimited)."""
    return min((x for x in limits if x > 0), default=0)


def effective_limits(*limits: Column) -> Column:
    """``effective_limit`` by row; null counts as unlimited."""
    set_ = [F.when(x > 0, x) for x in limits]
    return F.coalesce(F.least(*set_) if len(set_) > 1 else set_[0], F.lit(0))


def max_per_run(df: DataFrame, order: Sequence[str], max_count: int = 0, max_volume: int = 0, size: str = "size") -> DataFrame:
    """A run's share of the candidates: by count, by volume, or both (0 is no limit)."""
    limits = {"one": max_count, "volume": max_volume}
    if not any(limits.values()):
        return df
    keep = reduce(lambda a, b: a & b, [F.col(f"before_{a}") < limit for a, limit in limits.items() if limit])
    return running(df, order, {"one": F.lit(1), "volume": F.col(size)}).filter(keep).select("row.*")


def until_suspended(df: DataFrame, order: Sequence[str], failed: Column, least: int, percent: float) -> DataFrame:
    """The actions (in ``order``) that run before errors suspend the run: from the first action after which there are
    ``least`` errors and they make ``percent`` of all so far, that action included."""
    rows = running(df, order, {"errors": failed.cast("int"), "all": F.lit(1)})
    errors, every = F.col("before_errors") + F.col("own_errors"), F.col("before_all") + 1
    first = rows.filter((errors >= least) & (100 * errors >= percent * every)).agg(F.min("before_all").alias("stop"))
    return rows.join(F.broadcast(first), F.col("stop").isNull() | (F.col("before_all") <= F.col("stop"))).select("row.*")


def token_periods(df: DataFrame, order: Sequence[str], per_period: int | None = None, bytes_per_period: int | None = None, size: str = "size", by: Sequence[str] = ()) -> DataFrame:
    """The period in which a rate limit lets each action go (the later of both limits). By count: every N rows. By size:
    by the bytes before (the bucket may go into debt, so the one that crosses still goes). ``by`` limits each of its
    groups; without it the order is global, dealt into ranges."""
    limits = {a: n for a, n in (("one", per_period), ("volume", bytes_per_period)) if n}
    amounts = {"one": F.lit(1), "volume": F.col(size) if bytes_per_period else F.lit(0)}
    if by:
        w = Window.partitionBy(*by).orderBy(*[F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
        own = {"one": amounts["one"], "volume": wide(size, df.schema) if bytes_per_period else F.lit(0)}
        before = {a: F.coalesce(F.sum(own[a]).over(w), F.lit(0)) for a in limits}
        rows = df
    else:
        rows, before = running(df, order, amounts), {a: F.col(f"before_{a}") for a in limits}
    periods = [F.call_function("div", before[a], F.lit(n)) for a, n in limits.items()]
    period = F.greatest(*periods) if len(periods) > 1 else periods[0]
    return rows.withColumn("period", period) if by else rows.select("row.*", period.alias("period"))


def token_plan(df: DataFrame, by: str, order: Sequence[str], per_period: int = 0, bytes_per_period: int = 0, max_wait: int = 0, size: str = "size") -> DataFrame:
    """``df`` with the period in which a token bucket lets each action go, and whether it was forced out of its turn.

    Each group of ``by`` (a policy) has a bucket of both limits (0 is none). A period refills it up to its capacity and
    keeps its debt of bytes; an action goes while both have tokens. One that waited ``max_wait`` periods (0: no end) goes
    at the next refill whatever the tokens. The bucket goes from action to action, so a group is one sorted pass that
    keeps no rows; ``token_periods`` has the unbounded case of one limit without it."""
    schema = T.StructType([*df.schema.fields, T.StructField("period", T.LongType()), T.StructField("forced", T.BooleanType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner: object = object()
        period = count = volume = 0
        for part in batches:
            periods, forced = [], []
            for key, own in zip(part.column(by).to_pylist(), part.column(size).to_pylist(), strict=True):
                if key != owner:
                    owner, period, count, volume = key, 0, per_period, bytes_per_period
                need = 1 if per_period and count <= 0 else 0
                if bytes_per_period and volume <= 0:
                    need = max(need, -volume // bytes_per_period + 1)
                waits = min(need, max_wait) if max_wait else need
                if waits:
                    period, count = period + waits, per_period
                    volume = min(volume + waits * bytes_per_period, bytes_per_period)
                periods.append(period)
                forced.append(waits < need)
                count, volume = count - 1, volume - (own or 0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(periods, pa.int64()), pa.array(forced, pa.bool_())], names=[*part.schema.names, "period", "forced"])

    keys = [F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order]
    return df.repartition(by).sortWithinPartitions(by, *keys).mapInArrow(read, schema)


def capacity_trigger(capacity: DataFrame, high: float, low: float) -> DataFrame:
    """Targets whose used share is at or above ``high`` percent, with the blocks to free down to ``low`` percent."""
    total = F.col("f_blocks") + F.col("f_bavail") - F.col("f_bfree")
    used = F.col("f_blocks") - F.col("f_bfree")
    pct = 100 * used / total
    return capacity.withColumns({"used_pct": pct, "amount": F.greatest(F.lit(0), used - F.floor(total * low / 100)).cast("long")}).filter(F.col("used_pct") >= high)


def quota_trigger(entries: DataFrame, key: str, high: int, low: int, measure: str = "blocks") -> DataFrame:
    """Users or groups strictly above ``high``, biggest first, with the amount down to ``low``."""
    total = F.count(F.lit(1)) if measure == "count" else F.sum(measure)
    return entries.groupBy(key).agg(total.alias("value")).filter(F.col("value") > high).withColumn("amount", F.col("value") - low).orderBy(F.desc("value"), key)


def adaptive_interval(max_usage: Column, least: float, most: float) -> Column:
    return least + (100 - max_usage) / 100 * (most - least)


def maintenance_factor(now: int, at: int, window: int) -> float:
    """Share of the pre-maintenance window that is left; 1 outside it, without a window and without a date (0)."""
    return (at - now) / window if window and at > 0 and at - window <= now <= at else 1.0


def alert_digest(alerts: DataFrame, most: int = 100) -> DataFrame:
    """Alerts by title: count and at most ``most`` entries, taken without gathering a title's alerts in one place."""
    w = Window.partitionBy("title", "salt").orderBy("id")
    some = alerts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    lists = some.groupBy("title").agg(F.slice(F.sort_array(F.collect_list("id")), 1, most).alias("entries"))
    return alerts.groupBy("title").agg(F.count(F.lit(1)).alias("count")).join(lists, "title")


def outcome(planned: DataFrame, fresh: DataFrame, watched: Sequence[str] = ("size",)) -> DataFrame:
    """Planned entries with what a run would do: gone, accessed (a watched attribute changed since it was planned) or ok."""
    now = fresh.select(F.col("id").alias("f_id"), *[F.col(c).alias(f"f_{c}") for c in watched])
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in watched])
    result = F.when(F.col("f_id").isNull(), "gone").when(changed, "accessed").otherwise("ok")
    return planned.join(now, F.col("id") == F.col("f_id"), "left").withColumn("outcome", result).drop(*now.columns)


def on_target(kind: str, value: str | int) -> Column:
    """Entries of one target of a run: ``fs`` (all), ``ost`` (an index in column osts), ``pool``, ``project``, ``user``,
    ``group``, ``class`` or ``file`` (an id). Names of pools, users, groups and classes may be globs."""
    if kind == "fs":
        return F.lit(True)
    if kind == "ost":
        return X.ost_index(F.col("osts"), int(value))
    if kind == "class":
        return X.has_class(F.col("fileclass"), str(value))
    if kind in ("project", "file"):
        return F.col("projid") == int(value) if kind == "project" else F.col("id") == str(value)
    return X.like_glob(F.col({"pool": "ost_pool", "user": "uid", "group": "gid"}[kind]), str(value))


def action(policy: Policy, default: str, rule: str = "rule") -> Column:
    """The action of the row's rule, or the policy's own where the rule names none."""
    own = F.lit(None).cast("string")
    for r in (*policy.rules, *([policy.default] if policy.default else [])):
        if "action" in r.params:
            own = F.when(F.col(rule) == r.name, r.params["action"]).otherwise(own)
    return F.coalesce(own, F.lit(default))


def inode_trigger(capacity: DataFrame, high: float, low: float, percent: bool = False) -> DataFrame:
    """Targets whose used inodes are at or above ``high`` (a count or a percentage), with how many to free down to ``low``."""
    used = F.col("f_files") - F.col("f_ffree")
    most, least = [F.col("f_files") * x / 100 if percent else F.lit(x) for x in (high, low)]
    return capacity.withColumn("used_inodes", used).filter(used >= most).withColumn("amount", (used - F.floor(least)).cast("long"))


def class_rule(policy: Policy, classes_: Column, targets: dict[str, str], ignored: Sequence[str] = ()) -> Column:
    """The rule of an entry by the names of its classes: that of the first class in ``targets`` (class -> rule) which the
    entry has; none if it has an ignored class; the default rule if none of its classes has one."""
    out = F.when(F.arrays_overlap(classes_, F.array(*map(F.lit, ignored))), F.lit(None).cast("string")) if ignored else None
    for name, rule in targets.items():
        has = F.array_contains(classes_, name)
        out = F.when(has, F.lit(rule)) if out is None else out.when(has, F.lit(rule))
    other = F.lit(policy.default.name if policy.default else None).cast("string")
    return other if out is None else out.otherwise(other)


def parameters(*levels: dict[str, str]) -> dict[str, str]:
    """Action parameters merged: policy, trigger, rule and class, the later ones over the earlier."""
    return {k: v for level in levels for k, v in level.items()}


def target_usage(capacity: DataFrame, members: DataFrame | None = None, target: str = "ost") -> DataFrame:
    """target, used, total, used_pct of OSTs, or of pools (``members``: pool, ost) as sums over their OSTs; fullest first."""
    rows = capacity if members is None else members.join(capacity, "ost")
    key = target if members is None else "pool"
    sums = rows.groupBy(F.col(key).alias("target")).agg(F.sum(F.col("f_blocks") - F.col("f_bfree")).alias("used"), F.sum(F.col("f_blocks") + F.col("f_bavail") - F.col("f_bfree")).alias("total"))
    return sums.withColumn("used_pct", 100 * F.col("used") / F.col("total")).orderBy(F.desc("used_pct"), "target")


def due_triggers(triggers: DataFrame, now: int) -> DataFrame:
    """Triggers (name, last_check, check_interval) whose check is due; one that was never checked is. A check that failed
    (column failed) leaves last_check as it was."""
    due = F.coalesce(now - F.col("last_check") >= F.col("check_interval"), F.lit(True))
    return triggers.filter(due).withColumn("next_check", F.when(F.coalesce("failed", F.lit(False)), F.col("last_check")).otherwise(now))


def manual_run(candidates_: DataFrame, order: Sequence[str], capacity: DataFrame | None = None, percent: float | None = None, max_count: int = 0, max_volume: int = 0, blocks: str = "blocks") -> DataFrame:
    """What an explicit run acts on: up to a count, a volume, or (by ``percent``) the blocks that bring the one target of
    ``capacity`` down to that usage; nothing if it is below already."""
    if percent is None:
        return max_per_run(candidates_, order, max_count, max_volume)
    amount = capacity_trigger(capacity, percent, percent).agg(F.coalesce(F.max("amount"), F.lit(0)).alias("amount"))
    rows = running(candidates_, order, {"blocks": F.col(blocks)})
    return rows.join(F.broadcast(amount), F.col("before_blocks") < F.col("amount")).select("row.*")


def alerts(entries: DataFrame, rules: dict[str, Column], now: int) -> DataFrame:
    """id, title, alert_status, last_check, last_alert of every valid entry: the first rule that matches alerts."""
    title = F.coalesce(*[F.when(X.matched(rule), F.lit(name)) for name, rule in rules.items()])
    rows = entries.filter(~F.coalesce(F.col("invalid"), F.lit(False))).select("id", title.alias("title"))
    return rows.select("id", "title", F.when(F.col("title").isNull(), "clear").otherwise("alert").alias("alert_status"), F.lit(now).alias("last_check"), F.when(F.col("title").isNotNull(), now).alias("last_alert"))


def removable_directories(names: DataFrame, entries: DataFrame, age: Column) -> DataFrame:
    """Empty directories whose ``age`` condition matches: what a clean-up may remove."""
    parents = names.select(F.col("parent_id").alias("id"))
    return entries.filter((F.col("type") == "dir") & X.matched(age)).join(parents, "id", "left_anti")


def run_summary(outcomes: DataFrame, policy: str, start: int, end: int, trigger: str) -> DataFrame:
    """One row for a run: what it was, and its actions, volume, skipped and failed ones (outcome, size)."""
    when = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    summary = outcomes.agg(
        F.lit(policy).alias("policy"), F.lit(trigger).alias("trigger_kind"), F.lit(start).alias("run_start"), F.lit(end).alias("run_end"), when("ok").alias("ok"),
        F.sum(F.when(F.col("outcome") == "ok", wide("size", outcomes.schema))).alias("volume"), when("gone").alias("gone"), when("accessed").alias("accessed"),
    )
    return fitted(summary)


def match_source(cached: DataFrame, fresh: DataFrame, mode: str, required: Sequence[str] = ()) -> DataFrame:
    """Attributes that rules are matched on: ``cache`` as catalogued; ``auto`` cached ones, filled where missing, with
    those ``required`` fresh; ``force`` fresh ones where there are any."""
    if mode == "cache":
        return cached
    new = fresh.withColumnsRenamed({c: f"f_{c}" for c in fresh.columns})
    j = cached.join(new, cached["id"] == new["f_id"], "left")

    def pick(c: str) -> Column:
        if c == "id" or f"f_{c}" not in new.columns:
            return F.col(c)
        first = (f"f_{c}", c) if mode == "force" or c in required else (c, f"f_{c}")
        return F.coalesce(*first).alias(c)

    return j.select(*[pick(c) for c in cached.columns])
