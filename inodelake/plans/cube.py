"""The accounting cube: built once, kept up to date by signed deltas, and rolled up for reports that it can answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import size_bucket
from ..operators.report import PROFILE, profile_columns

KEYS = ("uid", "gid", "type", "status")
MEASURES = ("size", "blocks", "count", *PROFILE)


def build(entries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return entries.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("count"), *profile_columns(F.col("size")))


def deltas(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What inserting, deleting and updating entries changes in the cube: + the new rows, - the old ones."""
    signed = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    profile = signed.groupBy(*keys, "sign").agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("count"), *profile_columns(F.col("size")))
    return profile.groupBy(*keys).agg(*[F.sum(F.col(m) * F.col("sign")).alias(m) for m in MEASURES])


def signed(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``deltas`` of rows that carry their ``sign``, in one pass."""
    bucket, sign = size_bucket(F.col("size")), F.col("sign")
    profile = [F.sum(F.when(bucket == i - 1, sign).otherwise(0)).alias(name) for i, name in enumerate(PROFILE)]
    return rows.groupBy(*keys).agg(F.sum(F.col("size") * sign).alias("size"), F.sum(F.col("blocks") * sign).alias("blocks"), F.sum(sign).alias("count"), *profile)


def merge(cube: DataFrame, change: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    both = cube.unionByName(change).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return both.filter("count <> 0")


def roll_up(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of sums, counts of counts, rounded averages of both. The cube does not hold MIN and MAX: they are null."""
    sums = [F.sum(m).alias(m) for m in MEASURES]
    out = cube.groupBy(*keys).agg(*sums)
    return out.withColumns({"avg_size": F.round(F.col("size") / F.col("count")).cast("long"), "min_size": F.lit(None).cast("long"), "max_size": F.lit(None).cast("long")})


def answers(keys: Sequence[str], measures: Sequence[str]) -> bool:
    """Whether the cube alone can answer a report."""
    return set(keys) <= set(KEYS) and set(measures) <= {*MEASURES, "avg_size"}
