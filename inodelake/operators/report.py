"""Reports: grouped aggregates with filters before and after, size profiles, top lists, roll-up from the cube."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import parse_size
from ..functions.scalar import mean, size_bucket, total, wide

# Names of the size profile's columns.
PROFILE = ("sz0", "sz1", "sz32", "sz1K", "sz32K", "sz1M", "sz32M", "sz1G", "sz32G", "sz1T")


def profile_columns(size: Column) -> list[Column]:
    """Counts by size bucket. The last bucket takes everything from 1T on."""
    bucket = size_bucket(size)
    return [F.sum((bucket == i - 1).cast("long")).alias(name) for i, name in enumerate(PROFILE)]


def report(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], where: Column | None = None, having: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Filter, group, aggregate, filter again, sort and cut, in one declarative plan."""
    if where is not None:
        df = df.filter(where)
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    if having is not None:
        out = out.filter(having)
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def usage(size: str = "size", blocks: str | None = "blocks") -> list[Column]:
    """Counts, sums (exact, as decimals: see ``fitted``), bounds and the rounded average of sizes."""
    sums = [total(size).alias("size"), *([total(blocks).alias("blocks")] if blocks else [])]
    return [F.count(F.lit(1)).alias("count"), *sums, F.min(size).alias("min_size"), F.max(size).alias("max_size"), mean(F.col(size)).alias("avg_size")]


def with_total(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Groups and a footer line of totals (null keys, is_total true), in one pass."""
    return df.groupingSets([[df[k] for k in keys], []], *[df[k] for k in keys]).agg(*aggregates, (F.grouping_id() > 0).alias("is_total"))


def ranked(df: DataFrame, order: Sequence[Column], limit: int = 20) -> DataFrame:
    """The first ``limit`` rows with their rank; the rank is taken after the cut, over ``limit`` rows."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def with_others(df: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The top n labels and one line for all others. Only n labels meet the rest in a broadcast."""
    top = df.orderBy(F.desc(value), label).limit(n).select(F.col(label).alias("top_label"))
    marked = df.join(F.broadcast(top), df[label].eqNullSafe(F.col("top_label")), "left")
    return marked.groupBy(F.when(F.col("top_label").isNotNull(), F.col(label)).otherwise(F.lit("Others")).alias(label)).agg(F.sum(wide(value, df.schema)).alias(value))


def native(df: DataFrame, columns: dict[str, str], filters: Sequence[tuple[str, str, object]] = (), order: Sequence[tuple[str, bool]] = (), limit: int | None = None) -> DataFrame:
    """Aggregate builder: column -> group, sum, count, min, max, avg or concat; ``*`` -> count. Filters are (column,
    kind, value) with kinds filter, nfilter (patterns with ``*``), equal, less, bigger; on an aggregate they come after."""
    kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "concat": lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")}
    keys = [c for c, k in columns.items() if k == "group"]
    aggregates = [F.count(F.lit(1)).alias("count") if c == "*" else kinds[k](c).alias(f"{k}_{c}") for c, k in columns.items() if k != "group"]

    def condition(c: str, kind: str, value: object) -> Column:
        like = F.col(c).like(str(value).replace("*", "%"))
        return {"filter": like, "nfilter": ~like, "equal": F.col(c) == value, "less": F.col(c) < value, "bigger": F.col(c) > value}[kind]

    made = {f"{k}_{c}" for c, k in columns.items() if k != "group"} | {"count"}
    for f in filters:
        if f[0] not in made:
            df = df.filter(condition(*f))
    out = df.groupBy(*keys).agg(*aggregates)
    for f in filters:
        if f[0] in made:
            out = out.filter(condition(*f))
    if order:
        out = out.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order])
    return out if limit is None else out.limit(limit)


def size_range(size: Column, literal: str) -> Column:
    """``0``, ``a..b`` (b not included), ``a~b-`` (the same) or ``a..inf``, with units K, M, G, T, P, E."""
    if literal == "0":
        return size == 0
    low, high = literal.replace("~", "..").rstrip("-").split("..")
    inside = size >= parse_size(low)
    return inside if high == "inf" else inside & (size < parse_size(high))


def size_ratio(df: DataFrame, keys: Sequence[str], literal: str) -> DataFrame:
    """The share of each group's files that are in a size range."""
    inside = size_range(F.col("size"), literal)
    return df.groupBy(*keys).agg((F.sum(inside.cast("int")) / F.count(F.lit(1))).alias("ratio"))


def by_size_ratio(df: DataFrame, key: str, literal: str, limit: int = 20) -> DataFrame:
    """Owners by the share of their files in a size range, highest first."""
    return ranked(size_ratio(df, [key], literal), [F.desc("ratio"), F.asc(key)], limit)


def scan_activity(variables: DataFrame) -> DataFrame:
    """One row on the last scan from its variables (name, value): seconds, entries, errors, threads, entries a second."""
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    names = ("scan_start", "scan_end", "entries_scanned", "scan_errors", "scan_threads", "avg_ms_per_entry")
    one = variables.filter(F.col("name").isin(*names)).agg(*[value(n).alias(n) for n in names])
    number = lambda name: F.col(name).cast("long")
    ms = F.col("avg_ms_per_entry").cast("double")
    return one.select(
        (number("scan_end") - number("scan_start")).alias("duration"), number("entries_scanned").alias("entries"), number("scan_errors").alias("errors"),
        number("scan_threads").alias("threads"), F.when(ms > 0, 1000 / ms * number("scan_threads")).otherwise(0.0).alias("speed"),
    )


@dataclass(frozen=True)
class Chart:
    """A saved report: its columns and filters as in ``native``, and what its axes and series show."""

    name: str
    kind: str
    columns: dict[str, str]
    x: str
    y: str
    series: str | None = None
    filters: tuple = ()

    def saved(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loaded(text: str) -> Chart:
        return Chart(**json.loads(text))

    def rows(self, df: DataFrame) -> DataFrame:
        """x, y and series (null if it has none)."""
        out = native(df, self.columns, self.filters)
        return out.select(F.col(self.x).alias("x"), F.col(self.y).alias("y"), (F.col(self.series) if self.series else F.lit(None)).cast("string").alias("series"))


def simple_filters(filters: dict[str, object], aggregates: Sequence[str] = ()) -> tuple[Column, Column]:
    """Conditions before and after aggregation from plain keys: ``min..`` is greater, ``max..`` is less, others are LIKE."""
    before = after = F.lit(True)
    for key, value in filters.items():
        name = key[3:] if key[:3] in ("min", "max") else key
        test = F.col(name) > value if key.startswith("min") else F.col(name) < value if key.startswith("max") else F.col(name).like(str(value).replace("*", "%"))
        if name in aggregates:
            after &= test
        else:
            before &= test
    return before, after
