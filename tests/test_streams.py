"""Streams: records that meet across micro-batches, the source's positions, the kept cube."""

from __future__ import annotations

import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inodelake import registry
from inodelake.plans import cube as C
from inodelake.plans.kept import KeptCube, KeptLatest
from inodelake.sources import records as S
from inodelake.streaming import keyed as K

SCHEMA = "mdt string, tfid string, idx long, time long, type string"


def log(n=300, seed=1):
    rng, t, out = random.Random(seed), 1000, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 40])
        out.append((rng.choice("ab"), f"f{rng.randrange(6)}", i, t, rng.choice(["CREATE", "UNLINK", "CLOSE", "MTIME", "SETATTR", "MKDIR", "RMDIR", "MARK", "CTIME", "TRUNC"])))
    return out


def brute(rows, max_age):
    """Each record against those of its id that came before it, one after another."""
    hidden = {"TRUNC": {"TRUNC", "CLOSE", "MTIME", "CREATE"}, "CTIME": {"CTIME", "SETATTR", "CREATE", "MKNOD", "MKDIR"}}
    hidden |= {"CLOSE": hidden["TRUNC"], "MTIME": hidden["TRUNC"] | {"MKNOD", "MKDIR"}, "SETATTR": hidden["CTIME"]}
    kept: list[tuple] = []
    for r in rows:
        near = [k for k in kept if k[:2] == r[:2] and k[3] > r[3] - max_age]
        if r[4] in ("MARK", "IOCTL") or any(k[4] in hidden.get(r[4], ()) for k in near):
            continue
        if near and (near[-1][4], r[4]) in {("CREATE", "UNLINK"), ("MKNOD", "UNLINK"), ("MKDIR", "RMDIR")}:
            kept.remove(near[-1])
            continue
        kept.append(r)
    return sorted(kept)


def segments(path, rows, size):
    """The log as segments of ``size`` records a reader."""
    for reader in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == reader]
        os.makedirs(f"{path}/{reader}", exist_ok=True)
        for i in range(0, len(own), size):
            part = own[i : i + size]
            last = own[i + size][2] - 1 if i + size < len(own) else part[-1][2]
            table = pa.table({"tfid": [r[1] for r in part], "idx": [r[2] for r in part], "time": [r[3] for r in part], "type": [r[4] for r in part]})
            pq.write_table(table, f"{path}/{reader}/{part[0][2]}-{max(last, part[-1][2])}.parquet")


@pytest.mark.parametrize("max_age", [1, 30, 10**6])
def test_batch_form(spark, max_age):
    rows = log()
    assert sorted(map(tuple, K.compact(spark.createDataFrame(rows, SCHEMA).repartition(5), max_age).collect())) == brute(rows, max_age)


END = [("a", "end", 10**6, 10**9, "CREATE"), ("b", "end", 10**6, 10**9, "CREATE")]


def follow(spark, source, checkpoint, out, max_age):
    stream = K.compact_stream(source, max_age)
    query = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rows_of(spark, out):
    return sorted(map(tuple, spark.read.parquet(out).select("mdt", "tfid", "idx", "time", "type").filter("tfid <> 'end'").collect()))


@pytest.mark.parametrize("files", [1, 3, 50])
def test_rows_do_not_depend_on_the_batches(spark, tmp_path, files):
    K.use_state_store(spark)
    rows, max_age = log(120), 30
    (tmp_path / "in").mkdir()
    parts = [rows[i : i + 24] for i in range(0, len(rows), 24)]
    for i, part in enumerate([*parts[:3], *parts[3:], END]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        source = next(p for p in (tmp_path / f"t{i}").iterdir() if p.suffix == ".parquet")
        os.rename(source, tmp_path / "in" / f"{i:03}.parquet")
        os.utime(tmp_path / "in" / f"{i:03}.parquet", (1000 + i, 1000 + i))
        if i == 2:  # a first run sees half of the log, another one goes on from its checkpoint
            follow(spark, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in")), str(tmp_path / "check"), str(tmp_path / "out"), max_age)
    follow(spark, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in")), str(tmp_path / "check"), str(tmp_path / "out"), max_age)
    assert rows_of(spark, str(tmp_path / "out")) == brute(rows, max_age)


def read_source(spark, tmp_path, name, **options):
    S.register(spark)
    reader = spark.readStream.format(S.NAME).option("path", str(tmp_path / "log")).option("schema", SCHEMA)
    for k, v in options.items():
        reader = reader.option(k, v)
    out = str(tmp_path / name)
    query = reader.load().writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / f"check-{name}"))
    return query, out


def test_source_resumes_where_it_was(spark, tmp_path):
    rows = log(200)
    segments(tmp_path / "log", rows[:90], 13)
    query, out = read_source(spark, tmp_path, "one", range="17")
    query.trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("mdt", "tfid", "idx", "time", "type").collect()]
    assert sorted(got) == sorted(rows[:90])
    segments(tmp_path / "log", rows[90:], 50)
    query, out = read_source(spark, tmp_path, "one", range="17")
    query.trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("mdt", "tfid", "idx", "time", "type").collect()]
    assert sorted(got) == sorted(rows)


def test_source_after_a_batch_that_failed(spark, tmp_path):
    rows = log(100)
    segments(tmp_path / "log", rows, 10)
    out, state = str(tmp_path / "out"), {"fails": True}
    S.register(spark)

    def once(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if state["fails"]:
            raise RuntimeError("stopped halfway")

    def start():
        frame = spark.readStream.format(S.NAME).option("path", str(tmp_path / "log")).option("schema", SCHEMA).load()
        return frame.writeStream.foreachBatch(once).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="stopped halfway"):
        start().awaitTermination()
    state["fails"] = False
    start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("mdt", "tfid", "idx", "time", "type").collect()]
    assert sorted(got) == sorted(rows)


def test_positions_ranges_and_acknowledgement(tmp_path):
    rows = log(60)
    segments(tmp_path / "log", rows, 7)
    reader = S.ChangeRecordReader(None, {"path": str(tmp_path / "log"), "range": "10", "acknowledged": str(tmp_path / "ack.json")})
    assert reader.initialOffset() == {}
    last = {m: max(r[2] for r in rows if r[0] == m) for m in "ab"}
    assert reader.latestOffset() == last
    ranges = reader.partitions({"a": 20}, last)
    assert all(p.last - p.first < 10 for p in ranges) and min(p.first for p in ranges if p.reader == "a") == 21
    reader.commit(last)
    assert reader.initialOffset() == last == json.loads((tmp_path / "ack.json").read_text())
    assert S.ChangeRecordReader(None, {"path": str(tmp_path / "none")}).latestOffset() == {}


def test_a_plan_lists_the_log_once_and_tasks_do_not(tmp_path, monkeypatch):
    rows = log(200)
    segments(tmp_path / "log", rows, 7)
    listed, segments_of = [], S._Log.segments
    monkeypatch.setattr(S._Log, "segments", lambda self: listed.append(1) or segments_of(self))
    schema = type("Schema", (), {"names": ["mdt", "tfid", "idx", "time", "type"]})
    last = {m: max(r[2] for r in rows if r[0] == m) for m in "ab"}
    for tasks in (None, "3", "1000"):
        reader = S.ChangeRecordReader(schema, {"path": str(tmp_path / "log"), "range": "10", **({"tasks": tasks} if tasks else {})})
        listed.clear()
        plan = reader.partitions({"a": 20}, last)
        assert len(listed) == 1 and (tasks != "3" or len(plan) == 3)
        got = [tuple(r.values()) for p in plan for batch in reader.read(p) for r in batch.to_pylist()]
        assert len(listed) == 1 and sorted(got) == sorted(r for r in rows if r[0] == "b" or r[2] > 20)


UPDATES = "id string, idx long, removed boolean, uid string, gid string, type string, status string, size long, blocks long"


def updates(n=150):
    rng = random.Random(2)
    return [(f"e{rng.randrange(25)}", i, rng.random() < 0.2, rng.choice(["u1", "u2", None]), "g", "file", rng.choice(["new", None]), rng.choice([0, 40, 5000, None]), rng.choice([1, 9])) for i in range(n)]


def test_kept_cube_equals_a_rebuild(spark, tmp_path):
    K.use_state_store(spark)
    rows = updates()
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i : i + 30], UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    latest: dict[str, list] = {}
    for r in rows:
        if r[2]:
            latest.pop(r[0], None)
        else:
            latest[r[0]] = [new if new is not None else old for new, old in zip(r[3:], latest.get(r[0], [None] * 6), strict=True)]
    attributes = ["uid", "gid", "type", "status", "size", "blocks"]
    kept = KeptCube(spark, str(tmp_path / "cube"))
    source = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    kept.follow(K.signed_changes(source, attributes), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    entries = spark.createDataFrame([tuple(v) for v in latest.values()], "uid string, gid string, type string, status string, size long, blocks long")
    ordered = lambda df: sorted(map(repr, df.select("uid", "gid", "type", "status", "count", F.coalesce("size", F.lit(0)), F.coalesce("blocks", F.lit(0)), "sz0", "sz32", "sz1K").collect()))
    assert ordered(kept.latest()) == ordered(C.build(entries))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    kept = KeptCube(spark, str(tmp_path / "cube"))
    signed = lambda *rows: spark.createDataFrame(list(rows), "uid string, gid string, type string, status string, size long, blocks long, sign int")
    assert kept.latest() is None and kept.versions() == []
    assert kept.apply(signed(("u", "g", "file", "new", 40, 1, 1), ("v", "g", "file", "new", 7, 1, 1)), 0)
    assert kept.apply(signed(("u", "g", "file", "new", 40, 1, -1), ("u", "g", "file", None, 41, 1, 1)), 1)
    assert not kept.apply(signed(("u", "g", "file", "new", 40, 1, 1)), 1) and not kept.apply(signed(("u", "g", "file", "new", 40, 1, 1)), 0)
    got = {(r["uid"], r["status"]): (r["count"], r["size"]) for r in kept.latest().collect()}
    assert got == {("u", None): (1, 41), ("v", "new"): (1, 7)} and kept.versions() == [0, 1]
    (tmp_path / "cube" / "version=1" / "_SUCCESS").unlink()  # as if the writer had stopped
    assert kept.apply(signed(("u", "g", "file", "new", 40, 1, -1), ("u", "g", "file", None, 41, 1, 1)), 1)
    assert kept.expired(1) == [f"{tmp_path}/cube/version=0"]


@pytest.mark.parametrize("size", [7, 50, 150])
def test_kept_latest_equals_a_fold(spark, tmp_path, size):
    rows = [(*r[:3], *r[3:]) for r in updates()] + [(None, 150, False, "u1", "g", "file", None, 7, 1), ("gone", 151, True, "u1", "g", "file", None, 7, 1)]
    attributes = ["uid", "gid", "type", "status", "size", "blocks"]
    latest, kept = KeptLatest(spark, str(tmp_path / "latest"), attributes), KeptCube(spark, str(tmp_path / "cube"))
    some = rows if size > 7 else rows[-40:]
    for n, i in enumerate(range(0, len(some), size)):
        df = spark.createDataFrame(some[i : i + size], UPDATES).repartition(3)
        kept.apply(latest.apply(df, n), n)
        kept.apply(latest.apply(df, n), n)  # a replay changes nothing
    want: dict[str, list] = {}
    for r in some:
        if r[2]:
            want.pop(r[0], None)
        else:
            want[r[0]] = [new if new is not None else old for new, old in zip(r[3:], want.get(r[0], [None] * 6), strict=True)]
    assert {r["id"]: list(r["now"]) for r in latest.latest().filter("now IS NOT NULL").collect()} == want
    entries = spark.createDataFrame([tuple(v) for v in want.values()], "uid string, gid string, type string, status string, size long, blocks long")
    ordered = lambda df: sorted(map(repr, df.select("uid", "gid", "type", "status", "count", F.coalesce("size", F.lit(0)), F.coalesce("blocks", F.lit(0)), "sz0", "sz32", "sz1K").collect()))
    assert ordered(kept.latest()) == ordered(C.build(entries))


def test_cube_from_a_stream_calls_no_python_for_an_entry(spark, monkeypatch):
    monkeypatch.setattr(K, "signed_changes", None)
    monkeypatch.setattr(K, "use_state_store", None)
    assert registry.queries()["e04_cube_from_stream"](spark, "/root/testdata/sf0.001").count() > 100
