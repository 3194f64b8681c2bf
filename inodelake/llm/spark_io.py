"""Table reading and small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import counted, materialize, shared_dir

__all__ = ["counted", "let", "materialize", "packed", "shared_dir", "table", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it often while it is computed once."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside columns of the caller's own, whose names then clash with nothing."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in own.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in columns])
