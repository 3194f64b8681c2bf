"""Change records: compaction of redundant records, cancellation, rename expansion, counters, and a streaming form.

Compaction is an ordered fold over the pending records of one id: a dropped record no longer hides later ones, which no
window expresses. Each reader (mdt) has one queue for all ids, so its records run through one task, sorted by index and
in batches; the queue is all that is kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A record of the key's kind says nothing new while one of these is pending for the same id.
_DATA = frozenset({"TRUNC", "CLOSE", "MTIME", "CREATE"})
_META = frozenset({"CTIME", "SETATTR", "CREATE", "MKNOD", "MKDIR"})
HIDDEN_BY = {"TRUNC": _DATA, "CLOSE": _DATA, "MTIME": _DATA | {"MKNOD", "MKDIR"}, "CTIME": _META, "SETATTR": _META}
UNDOES = {"UNLINK": frozenset({"CREATE", "MKNOD"}), "RMDIR": frozenset({"MKDIR"})}


def fold(kinds: list[str]) -> list[int]:
    """Positions of the records of one id that stay, in order."""
    kept: list[int] = []
    pending: dict[str, int] = {}
    for i, kind in enumerate(kinds):
        if any(pending.get(k) for k in HIDDEN_BY.get(kind, ())):
            continue
        if kept and kinds[kept[-1]] in UNDOES.get(kind, ()):
            pending[kinds[kept.pop()]] -= 1
            continue
        kept.append(i)
        pending[kind] = pending.get(kind, 0) + 1
    return kept


def compact(records: DataFrame, batch: int = 1000) -> DataFrame:
    """The records that stay. A reader's queue is cut to fewer than ``batch`` records before each new one by pushing the
    oldest out; a record is compared with those of its id that are still queued. The queue's age limit (clock time) is
    left out."""
    real = records.filter(~F.col("type").isin("MARK", "IOCTL"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: dict[int, dict] = {}
        pending: dict = defaultdict(list)
        reader, number, schema = None, 0, None
        for part in batches:
            schema, out = part.schema, []
            for row in part.to_pylist():
                if row["mdt"] != reader:
                    out += queue.values()
                    queue.clear()
                    pending.clear()
                    reader = row["mdt"]
                while queue and len(queue) >= batch:
                    oldest = queue.pop(next(iter(queue)))
                    own = pending[oldest["tfid"]]
                    own.pop(0)
                    if not own:
                        del pending[oldest["tfid"]]
                    out.append(oldest)
                own, kind = pending[row["tfid"]], row["type"]
                if any(queue[k]["type"] in HIDDEN_BY.get(kind, ()) for k in own):
                    continue
                if own and queue[own[-1]]["type"] in UNDOES.get(kind, ()):
                    del queue[own.pop()]
                    if not own:
                        del pending[row["tfid"]]
                    continue
                queue[number] = row
                own.append(number)
                number += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if queue:
            yield pa.RecordBatch.from_pylist(list(queue.values()), schema=schema)

    return real.repartition("mdt").sortWithinPartitions("mdt", "idx").mapInArrow(read, real.schema)


def without_old_states(records: DataFrame, max_age: int | None = None) -> DataFrame:
    """Archive records (idx, time, mdt, tfid, is_state) less each state that a later record of its id follows within
    ``max_age`` seconds, while it waits: every record drops the last state before it, so a state stays only as the last."""
    w = Window.partitionBy("mdt", "tfid").orderBy("idx")
    last = F.lead("time").over(w).isNull()
    late = F.lit(False) if max_age is None else F.lead("time").over(w) - F.col("time") > max_age
    return records.withColumn("stays", ~F.col("is_state") | last | late).filter("stays").drop("stays")


def speeds(reports: DataFrame) -> DataFrame:
    """Reports of readers (mdt, report_time, rec_id, rec_time) with records a second, seconds of log a second, and how far
    the log is behind."""
    w = Window.partitionBy("mdt").orderBy("report_time")
    seconds = F.nullif(F.col("report_time") - F.lag("report_time").over(w), F.lit(0))
    gain = lambda c: (F.col(c) - F.lag(c).over(w)) / seconds
    return reports.select("*", gain("rec_id").alias("speed"), gain("rec_time").alias("ratio"), (F.col("report_time") - F.col("rec_time")).alias("behind"))


def expand_renames(records: DataFrame) -> DataFrame:
    """One RENAME becomes: UNLINK of an overwritten target, removal of the old name, creation of the new one; ``sub``
    keeps their order. ``records`` has type, tfid, pfid, name, sfid, spfid, sname."""
    step = lambda n, kind, fid, pfid, name: F.struct(F.lit(n).alias("sub"), F.lit(kind).alias("op"), F.col(fid).alias("fid"), F.col(pfid).alias("parent"), F.col(name).alias("entry"))
    renamed = F.array(F.when(F.col("tfid").isNotNull() & (F.col("tfid") != F.col("sfid")), step(0, "UNLINK", "tfid", "pfid", "name")), step(1, "RM_NAME", "sfid", "spfid", "sname"), step(2, "ADD_NAME", "sfid", "pfid", "name"))
    plain = F.array(F.struct(F.lit(0).alias("sub"), F.col("type").alias("op"), F.col("tfid").alias("fid"), F.col("pfid").alias("parent"), F.col("name").alias("entry")))
    steps = F.filter(F.when(F.col("type") == "RENAME", renamed).otherwise(plain), lambda x: x.isNotNull())
    return records.select("*", F.explode(steps).alias("step_")).select("idx", "step_.*")


def catalog_operation(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """What each record does to the catalog (id, nlink): INSERT, UPDATE, REMOVE, RM_NAME or IGNORE."""
    known = catalog.select(F.col("id").alias("known_id"), F.col("nlink").alias("known_nlink"))
    j = records.join(known, records["tfid"] == known["known_id"], "left")
    last = F.coalesce(F.col("known_nlink"), F.lit(1)) <= 1
    op = (
        F.when(F.col("type").isin("UNLINK", "RMDIR") & F.col("known_id").isNull(), "IGNORE")
        .when((F.col("type") == "RMDIR") | ((F.col("type") == "UNLINK") & last), "REMOVE")
        .when(F.col("type") == "UNLINK", "RM_NAME")
        .when(F.col("known_id").isNull(), "INSERT")
        .otherwise("UPDATE")
    )
    return j.select(*records.columns, op.alias("op"))


def inferred(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """What a record itself tells of its entry, beside the catalog (id, nlink): kind, nlink, creation time (on insert
    only) and dircount of a new directory; null is unknown."""
    known = catalog.select(F.col("id").alias("known_id"), F.col("nlink").alias("known_nlink"))
    j = records.join(known, records["tfid"] == known["known_id"], "left")
    made = F.col("type").isin("CREATE", "MKDIR", "MKNOD", "SOFTLINK")
    kind = F.when(F.col("type").isin("MKDIR", "RMDIR"), "dir").when(F.col("type") == "SOFTLINK", "symlink").when(F.col("type") == "CREATE", "file")
    nlink = F.when(F.col("type") == "CREATE", 1).when(F.col("type") == "HLINK", F.col("known_nlink") + 1)
    return j.select(*records.columns, kind.alias("kind"), nlink.cast("int").alias("nlink"), F.when(made & F.col("known_id").isNull(), F.col("time")).alias("creation_time"), F.when(F.col("type") == "MKDIR", 0).alias("dircount"))


def effective(updates: DataFrame, catalog: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Updates less those of known entries that change nothing (a null says nothing)."""
    old = catalog.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in columns])
    changed = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in columns])
    return updates.join(old, F.col(key) == F.col("old_key"), "left").filter(F.col("old_key").isNull() | changed).select(*updates.columns)


def hsm_status(event: Column, failed: Column, dirty: Column, current: Column) -> Column:
    """Status after an archive event; 'refresh' where it has to be read anew, null where the event says nothing."""
    archive = F.when(~failed, "refresh").when(dirty, "modified")
    restore = F.when(failed, "released").otherwise("synchro")
    return (
        F.when(event == "archive", archive).when(event == "restore", restore).when((event == "release") & ~failed, "released").when(event == "dirty", "modified")
        .when(event.isin("remove", "cancel"), "refresh").when((event == "create") & current.isNull(), "new")
    )


#: Removal actions from the weakest to the strongest.
REMOVALS = ("none", "remove", "soft_remove")


def strongest(*actions: Column) -> Column:
    """The strongest of the removal actions that several status managers ask for (null asks for none)."""
    codes = [F.coalesce(F.array_position(F.array(*map(F.lit, REMOVALS)), a), F.lit(1)) for a in actions]
    return F.get(F.array(*map(F.lit, REMOVALS)), (F.greatest(*codes) if len(codes) > 1 else codes[0]).cast("int") - 1)


def needs_refresh(last, now: int, policy: str, least: int = 0, most: int = 0, on_event=None):
    """Refresh policy on ``now - last``: never, always, on_event, periodic, on_event_periodic. Unknown is refreshed."""
    age = now - last
    event = F.lit(False) if on_event is None else on_event
    due = {"never": F.lit(False), "always": F.lit(True), "on_event": event, "periodic": age >= most, "on_event_periodic": (event & (age >= least)) | (age >= most)}[policy]
    return F.when(last.isNull(), F.lit(policy != "never")).otherwise(due)


def counters(records: DataFrame) -> DataFrame:
    return records.groupBy("mdt", "type").agg(F.count(F.lit(1)).alias("count"), F.max("idx").alias("last_idx"))


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A resumable change stream over record files; the checkpoint of its query is the commit position."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_stream(records: DataFrame, sink: str, checkpoint: str):
    """Compact every micro-batch and append it to ``sink``, one folder for each batch, so that a replay overwrites."""

    def batch(df: DataFrame, number: int) -> None:
        compact(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

