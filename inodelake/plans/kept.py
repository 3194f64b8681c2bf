"""An accounting cube that a stream keeps: one version a micro-batch, each applied once.

A version is a folder named by its batch's number; its cube is the one before it and the batch's signed changes added
up. Spark numbers a replayed batch as before, so a version that is there is not written again, and one that was not
finished (it lacks the writer's mark of success) is. Versions older than ``keep`` are left out by ``expired``.

``KeptCube.follow`` takes signed changes, as ``keyed.signed_changes`` has them from a state store, which calls Python for
every id: right where batches are small against the catalog. ``KeptCube.follow_updates`` takes the updates themselves and
joins each batch with a kept table of the last known attributes (``KeptLatest``), all in Spark's own operators; as every
batch writes that table again, it is for batches that touch a fair part of the catalog.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube as C


class _Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The finished versions, by Hadoop's file system, so that any store does."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[8:]) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def latest(self) -> DataFrame | None:
        found = self.versions()
        return self.at(found[-1]) if found else None

    def expired(self, keep: int = 10) -> list[str]:
        """The folders of versions beyond the ``keep`` last ones, for whoever clears the store."""
        return [f"{self.path}/version={v}" for v in self.versions()[:-keep]]


class KeptLatest(_Versions):
    """The last known attributes of every entry. A row of a version has the entry's key, its attributes ``now`` (null once
    it is removed; it is gone from the next version on), whether the batch ``touched`` it, and what it ``was`` before."""

    def __init__(self, spark: SparkSession, path: str, attributes: Sequence[str], key: str = "id") -> None:
        super().__init__(spark, path)
        self.attributes, self.key = list(attributes), key

    def folded(self, updates: DataFrame) -> DataFrame:
        """One row a key: whether its last update removed it, and for each attribute the last update that tells of it:
        one with a value, or a removal, after which it is unknown. Null where no update does."""
        gone = F.coalesce("removed", F.lit(False))
        told = {a: F.max_by(F.struct(F.when(~gone, F.col(a)).alias("value")), F.when(gone | F.col(a).isNotNull(), F.col("idx"))) for a in self.attributes}
        return updates.groupBy(F.col(self.key).alias("key_")).agg(F.max_by(gone, "idx").alias("gone_"), F.lit(True).alias("some_"), *[c.alias(f"told_{a}") for a, c in told.items()])

    def apply(self, updates: DataFrame, batch: int) -> DataFrame:
        """Add a batch of updates (key, idx, removed, attributes), unless it has been added before; its signed changes."""
        found = self.versions()
        if batch not in found:
            new, before = self.folded(updates), [v for v in found if v < batch]
            fields = ", ".join(f"`{a}`: {updates.schema[a].dataType.simpleString()}" for a in self.attributes)
            old = self.at(before[-1]).filter("now IS NOT NULL").select(self.key, F.col("now").alias("was")) if before else self.spark.createDataFrame([], f"`{self.key}` {updates.schema[self.key].dataType.simpleString()}, was struct<{fields}>")
            both = old.join(new, F.col(self.key).eqNullSafe(F.col("key_")), "full")
            latest = F.struct(*[F.when(F.col(f"told_{a}").isNotNull(), F.col(f"told_{a}.value")).otherwise(F.col(f"was.{a}")).alias(a) for a in self.attributes])
            touched = F.col("some_").isNotNull()
            rows = both.select(
                F.when(touched, F.col("key_")).otherwise(F.col(self.key)).alias(self.key), F.when(~touched, F.col("was")).when(~F.col("gone_"), latest).alias("now"),
                touched.alias("touched"), F.when(touched, F.col("was")).alias("was"),
            )
            rows.filter("now IS NOT NULL OR was IS NOT NULL").write.mode("overwrite").parquet(f"{self.path}/version={batch}")
        changed = self.at(batch).filter(F.col("touched") & ~F.col("now").eqNullSafe(F.col("was")))
        each = F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), F.col(side).alias("row")) for sign, side in ((-1, "was"), (1, "now"))]))
        return changed.select(each.alias("change")).filter("change.row IS NOT NULL").select("change.row.*", "change.sign")


class KeptCube(_Versions):
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = C.KEYS) -> None:
        super().__init__(spark, path)
        self.keys = list(keys)

    def apply(self, signed: DataFrame, batch: int) -> bool:
        """Add a batch of signed rows (keys, size, blocks, sign); False if it has been added before."""
        found = self.versions()
        if found and found[-1] >= batch:
            return False
        change = C.signed(signed, self.keys)
        cube = C.merge(self.at(found[-1]), change, self.keys) if found else change.filter("count <> 0")
        cube.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)).write.mode("overwrite").parquet(f"{self.path}/version={batch}")
        return True

    def follow(self, changes: DataFrame, checkpoint: str):
        """A streaming query that applies every micro-batch of signed changes."""
        return changes.writeStream.outputMode("update").foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)

    def follow_updates(self, updates: DataFrame, latest: KeptLatest, checkpoint: str):
        """A streaming query that applies every micro-batch of updates (key, idx, removed, attributes)."""
        return updates.writeStream.outputMode("append").foreachBatch(lambda df, n: self.apply(latest.apply(df, n), n)).option("checkpointLocation", checkpoint)
