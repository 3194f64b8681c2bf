"""Cutting lineage by tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, one machine alone gets a temporary one; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps depend on files, not on lost executors."""
    path = f"{shared_dir(df.sparkSession)}/inodelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, *measures) -> tuple[DataFrame, dict]:
    """``materialize`` with the number of rows (``n``) and further aggregates, taken while it writes."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *measures))
    return out, seen.get


def fitted(report: DataFrame) -> DataFrame:
    """``report``, written once, with exact sums (its whole decimals) as longs. A column with a value beyond 64 bits stays
    a decimal(38,0), so that no sum is lost; SQL's cast to BIGINT has no result there."""
    sums = [f.name for f in report.schema if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0]
    if not sums:
        return report
    out, seen = counted(report, *[F.max(F.abs(F.col(c))).alias(f"most_{i}") for i, c in enumerate(sums)])
    kinds = {c: "decimal(38,0)" if (seen[f"most_{i}"] or 0) >= 1 << 63 else "long" for i, c in enumerate(sums)}
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})
