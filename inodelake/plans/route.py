"""Reports that choose what to read: the accounting cube where it can answer, the entries otherwise.

A report's condition is a rule text's tree, so what it looks at is known. The cube answers where all keys and all criteria
of the condition are its keys and every measure derives from its sums: counts, sums, averages (sum over number of
known values) and the size profile. Least, greatest and distinct values need the entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions.expr import all_of, compare, matched
from ..functions.ruletext import And, Node, Not, Or, Test
from ..operators.report import PROFILE, profile_columns
from . import cube as K

#: Known sizes and blocks, beside the cube's own measures: what averages divide by.
KNOWN = ("known_size", "known_blocks")


@dataclass(frozen=True)
class Report:
    """``measures``: count, profile, or sum, avg, min, max or distinct with a column, as in ``sum_size``. ``having`` are
    (measure, comparator, value), ``order`` names with a minus where descending."""

    keys: tuple[str, ...]
    measures: tuple[str, ...]
    where: Node | None = None
    having: tuple[tuple[str, str, float], ...] = ()
    order: tuple[str, ...] = ()
    limit: int | None = None


def build(entries: DataFrame, keys: Sequence[str] = K.KEYS) -> DataFrame:
    """The cube with numbers of known values, so that it answers averages exactly."""
    return entries.groupBy(*keys).agg(
        F.sum("size").alias("size"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("count"), *profile_columns(F.col("size")),
        F.count("size").alias("known_size"), F.count("blocks").alias("known_blocks"),
    )


def criteria(node: Node | None) -> set[str]:
    """The criteria that a condition looks at."""
    if isinstance(node, Test):
        return {node.name.lower()}
    if isinstance(node, And | Or):
        return criteria(node.left) | criteria(node.right)
    return criteria(node.of) if isinstance(node, Not) else set()


def covered(report: Report, context: C.Context, cube: DataFrame, keys: Sequence[str] = K.KEYS) -> bool:
    """Whether the cube (with its columns) answers the report."""
    looked_at = {context.name(c) for c in criteria(report.where)}
    known = {"count", *(f"{kind}_{c}" for kind in ("sum", "avg") for c in ("size", "blocks") if {c, f"known_{c}"} <= set(cube.columns))}
    known |= {"profile"} if set(PROFILE) <= set(cube.columns) else set()
    return set(report.keys) <= set(keys) and looked_at <= set(keys) and set(report.measures) <= known


def _average(total: Column, known: Column) -> Column:
    return F.round(total / F.nullif(known, F.lit(0))).cast("long")


def _of_cube(measure: str) -> list[Column]:
    kind, _, column = measure.partition("_")
    if measure == "count":
        return [F.sum("count").alias("count")]
    if measure == "profile":
        return [F.sum(p).alias(p) for p in PROFILE]
    return [F.sum(column).alias(measure) if kind == "sum" else _average(F.sum(column), F.sum(f"known_{column}")).alias(measure)]


def _of_entries(measure: str) -> list[Column]:
    kind, _, column = measure.partition("_")
    if measure == "count":
        return [F.count(F.lit(1)).alias("count")]
    if measure == "profile":
        return profile_columns(F.col("size"))
    made = {"sum": F.sum, "min": F.min, "max": F.max, "distinct": F.count_distinct, "avg": lambda c: _average(F.sum(c), F.count(c))}
    if kind not in made or not column:
        raise ValueError(f"unknown measure {measure}")
    return [made[kind](column).alias(measure)]


def run(report: Report, entries: DataFrame, cube: DataFrame | None, context: C.Context, keys: Sequence[str] = K.KEYS) -> DataFrame:
    """The report's rows, from the cube where it answers. Both ways give the same rows."""
    small = cube is not None and covered(report, context, cube, keys)
    rows, make = (cube, _of_cube) if small else (entries, _of_entries)
    if report.where is not None:
        rows = rows.filter(matched(C.compiled(report.where, context)))
    measures = [m for name in report.measures for m in make(name)]
    out = rows.groupBy(*report.keys).agg(*measures) if report.keys else rows.agg(*measures)
    if not report.keys and small:  # no row at all counts nothing, as over the entries
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("count",) if c in out.columns})
    if report.having:
        out = out.filter(all_of(*[compare(F.col(m), op, value) for m, op, value in report.having]))
    if report.order:
        out = out.orderBy(*[F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in report.order])
    return out if report.limit is None else out.limit(report.limit)
