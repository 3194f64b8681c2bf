"""Change records with state by (mdt, id): compaction across micro-batches, and signed changes of entries.

A record waits for ``max_age`` seconds of the log's own time. A redundant one goes while what makes it so waits, and a
removal goes together with the creation right before it while that waits. Whether two records meet depends on their
times only, so the rows that stay are the same whatever the batch size and after a restart: a timer lets a record go
once the watermark is ``max_age`` past it, when no later record can meet it any more. An id's records are folded in the
order of their index; ids are independent of one another, so there is no queue of a whole reader.

Streams need the RocksDB state store (``use_state_store``). A record later than the watermark is dropped by Spark; the
``delay`` says how far out of order records may be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructType

from .changelog import HIDDEN_BY, UNDOES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["mdt", "tfid"]


def use_state_store(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def real(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("type").isin("MARK", "IOCTL"))


def step(waiting: list[dict], record: dict, max_age: int) -> list[dict]:
    """Take one more record of an id into ``waiting``; the records that it lets go, whose time is over."""
    over = next((k for k, w in enumerate(waiting) if w["time"] > record["time"] - max_age), len(waiting))
    gone = waiting[:over]
    del waiting[:over]
    kind = record["type"]
    if any(w["type"] in HIDDEN_BY.get(kind, ()) for w in waiting):
        return gone
    if waiting and waiting[-1]["type"] in UNDOES.get(kind, ()):
        waiting.pop()
        return gone
    waiting.append(record)
    return gone


def compact(records: DataFrame, max_age: int) -> DataFrame:
    """The records (mdt, tfid, idx, time, type and others) that stay of a whole log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, schema = None, [], None
        for part in batches:
            schema, out = part.schema, []
            for row in part.to_pylist():
                if (row["mdt"], row["tfid"]) != key:
                    out += waiting
                    key, waiting = (row["mdt"], row["tfid"]), []
                out += step(waiting, row, max_age)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)

    kept = real(records)
    return kept.repartition(*KEYS).sortWithinPartitions(*KEYS, "idx").mapInArrow(run, kept.schema)


class _Waiting(StatefulProcessor):
    """The waiting records of one (mdt, id)."""

    def __init__(self, schema: StructType, max_age: int) -> None:
        self.schema, self.max_age = schema, max_age

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getListState("waiting", self.schema)

    def _load(self) -> list[dict]:
        return [dict(zip(self.schema.names, r, strict=True)) for r in self.state.get()] if self.state.exists() else []

    def _keep(self, waiting: list[dict], before: list[dict]) -> None:
        if waiting:
            self.state.put([tuple(w[n] for n in self.schema.names) for w in waiting])
        else:
            self.state.clear()
        due = lambda w: (w["time"] + self.max_age) * 1000
        for old in {due(w) for w in before} - {due(w) for w in waiting}:
            self.handle.deleteTimer(old)
        for new in {due(w) for w in waiting} - {due(w) for w in before}:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting = self._load()
        before, gone = list(waiting), []
        for row in sorted((r.asDict() for r in rows), key=lambda r: r["idx"]):
            gone += step(waiting, {n: row[n] for n in self.schema.names}, self.max_age)
        self._keep(waiting, before)
        for g in gone:
            yield Row(**g)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = self._load()
        over = [w for w in waiting if (w["time"] + self.max_age) * 1000 <= expiredTimerInfo.getExpiryTimeInMs()]
        rest = waiting[len(over) :]
        if rest:
            self.state.put([tuple(w[n] for n in self.schema.names) for w in rest])
        else:
            self.state.clear()
        for w in over:
            yield Row(**w)

    def close(self) -> None:
        pass


def compact_stream(records: DataFrame, max_age: int, delay: str = "0 seconds") -> DataFrame:
    """``compact`` of a stream. What still waits when the stream ends stays in the state until the log goes on."""
    kept = real(records)
    timed = kept.withColumn("moment", F.timestamp_seconds("time")).withWatermark("moment", delay)
    return timed.groupBy(*KEYS).transformWithState(statefulProcessor=_Waiting(kept.schema, max_age), outputStructType=kept.schema, outputMode="append", timeMode="eventTime")


class _Latest(StatefulProcessor):
    """The last known attributes of one entry; each change gives the old ones with sign -1 and the new ones with +1."""

    def __init__(self, schema: StructType) -> None:
        self.schema = schema

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = dict(zip(self.schema.names, self.state.get(), strict=True)) if self.state.exists() else None
        first = old
        for row in sorted((r.asDict() for r in rows), key=lambda r: r["idx"]):
            if row["removed"]:
                old = None
            else:  # an unknown attribute says nothing new
                old = {n: row[n] if row[n] is not None or old is None else old[n] for n in self.schema.names}
        if old == first:
            return
        for sign, values in ((-1, first), (1, old)):
            if values is not None:
                yield Row(**values, sign=sign)
        if old is None:
            self.state.clear()
        else:
            self.state.update(tuple(old[n] for n in self.schema.names))

    def close(self) -> None:
        pass


def signed_changes(updates: DataFrame, attributes: Sequence[str], key: str = "id") -> DataFrame:
    """A stream of updates (``key``, idx, removed, attributes) as what it changes: attributes and sign."""
    schema = StructType([updates.schema[a] for a in attributes])
    out = StructType(list(schema)).add("sign", IntegerType())
    return updates.groupBy(key).transformWithState(statefulProcessor=_Latest(schema), outputStructType=out, outputMode="update", timeMode="none")
