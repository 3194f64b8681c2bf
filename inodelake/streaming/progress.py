"""What running streams report, as rows: counts by reader and type of each micro-batch, and Spark's own progress.

``counted`` writes a batch's counts under its number, so that a replayed batch replaces its rows. ``ProgressLog`` is a
listener that keeps each batch's progress until ``save`` appends it to a table. ``rates`` puts both beside the report
before: how many records more, how many a second, how much of the log's own time a second, and how far it is behind.
"""

from __future__ import annotations

import json
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch long, at long, input_rows long, seconds double, state_rows long"
COUNTS = "mdt string, type string, count long, last_idx long, last_time long, batch long"


class ProgressLog(StreamingQueryListener):
    """Progress of all queries of a session that have a name."""

    def __init__(self) -> None:
        self.lock, self.kept = threading.Lock(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).astimezone(timezone.utc)
        state = sum(json.loads(s.json).get("numRowsTotal", 0) for s in p.stateOperators)
        with self.lock:
            self.kept.append((p.name, p.batchId, int(at.timestamp()), p.numInputRows, p.batchDuration / 1000, state))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        """What is kept since the last ``save``."""
        with self.lock:
            return spark.createDataFrame(list(self.kept), PROGRESS)

    def save(self, spark: SparkSession, path: str) -> int:
        """Append to the table at ``path`` what is new; the number of rows."""
        with self.lock:
            some, self.kept = self.kept, []
        if some:
            spark.createDataFrame(some, PROGRESS).coalesce(1).write.mode("append").parquet(path)
        return len(some)


def counts(records: DataFrame) -> DataFrame:
    """Records (mdt, type, idx, time) by reader and type, with the last ones' index and time."""
    return records.groupBy(F.col("mdt").cast("string").alias("mdt"), "type").agg(F.count(F.lit(1)).alias("count"), F.max("idx").alias("last_idx"), F.max("time").alias("last_time"))


def counted(records: DataFrame, batch: int, path: str) -> None:
    """For ``foreachBatch``: a batch's counts, one folder for each batch."""
    counts(records).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def differences(reports: DataFrame, at: str = "at", value: str = "total") -> DataFrame:
    """Reports of totals by mdt and type with what they gained since the report before, and each second."""
    w = Window.partitionBy("mdt", "type").orderBy(at)
    seconds = F.nullif(F.col(at) - F.lag(at).over(w), F.lit(0))
    gained = F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))
    return reports.withColumns({"gained": gained, "speed": gained / seconds})


def rates(counts_: DataFrame, progress: DataFrame) -> DataFrame:
    """Each batch's counts by reader and type (with batch) beside its progress: total, gained, seconds since the report
    before, speed (records a second), ratio (seconds of log a second) and behind (seconds)."""
    times = progress.groupBy("batch").agg(F.max("at").alias("at"))
    w = Window.partitionBy("mdt", "type").orderBy("batch")
    seconds = F.nullif(F.col("at") - F.lag("at").over(w), F.lit(0))
    return counts_.join(times, "batch").select(
        "batch", "at", "mdt", "type", F.sum("count").over(w).alias("total"), F.col("count").alias("gained"), seconds.alias("seconds"), (F.col("count") / seconds).alias("speed"),
        ((F.col("last_time") - F.lag("last_time").over(w)) / seconds).alias("ratio"), (F.col("at") - F.col("last_time")).alias("behind"),
    )
