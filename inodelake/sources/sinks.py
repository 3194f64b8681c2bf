"""Where results go: key/value state, CSV reports and dumps of entries."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.policy import running
from .catalog import striping

VARIABLES = "name string, value string, at bigint"


def latest(records: DataFrame) -> DataFrame:
    """name, value of each name's last record (name, value, at); a null value removes the name."""
    return records.groupBy("name").agg(F.max_by("value", "at").alias("value")).filter(F.col("value").isNotNull())


def put_variables(spark: SparkSession, path: str, values: dict[str, str | None]) -> None:
    """Set (or, by None, remove) variables. Every call appends one small file, so that readers never see half of it."""
    rows = [(k, v, time.time_ns()) for k, v in values.items()]
    spark.createDataFrame(rows, VARIABLES).coalesce(1).write.mode("append").parquet(path)


def variables(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.schema(VARIABLES).parquet(path))


def write_report(df: DataFrame, path: str, header: bool = True, order: Sequence[str] = ()) -> None:
    """A report as CSV files. With ``order`` (names with a minus where descending), ranked from 1 in it, by ranges of the order."""
    if order:
        df = running(df, order, {"one": F.lit(1)}).select((F.col("before_one") + 1).alias("rank"), "row.*")
    df.write.option("header", header).csv(path)


def read_report(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def dump(entries: DataFrame, kind: str = "all", value: str | None = None) -> DataFrame:
    """Whole entries of all, one user, one group or one status ('' takes unknown ones too), by fixed columns."""
    if kind != "all":
        column = F.col({"user": "uid", "group": "gid", "status": "status"}[kind])
        entries = entries.filter((column == value) | column.isNull() if kind == "status" and value == "" else column == value)
    return entries.select("id", "type", "status", "size", "uid", "gid", "path")


def dump_osts(entries: DataFrame, stripes: DataFrame, osts: Sequence[int], stripe_size: int) -> DataFrame:
    """Files (id, type, size, path) with a stripe on one of ``osts``, and whether they really hold data there. ``stripes``
    has id, stripe_index, ostidx."""
    wanted = F.array(*map(F.lit, osts))
    on = entries.join(striping(stripes).filter(F.arrays_overlap("osts", wanted)), "id")
    blocks = F.transform("osts", lambda o, i: F.when(o.isin(*osts), S.blocks_on_ost(F.col("blocks") * 512, F.lit(stripe_size), F.size("osts"), i)))
    data = F.coalesce(F.exists(blocks, lambda b: F.coalesce(b, F.lit(0)) > 0), F.lit(False))
    return on.select("id", "type", "size", "path", F.size("osts").alias("stripe_count"), data.alias("data_on_ost"))
