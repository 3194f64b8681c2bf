"""Removal after scans, paths after moves and progress of streams, against plain Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from inodelake.operators import garbage as G
from inodelake.operators import moves as M
from inodelake.operators import namespace as N
from inodelake.streaming import progress as V


def path_of(names, at, root="0"):
    """The path of one name (id, parent, name) by the least name of each parent above it."""
    best = {}
    for i, parent, name in sorted((i, p, n) for i, p, n, *_ in names):
        best.setdefault(i, (parent, name))
    parent, way = at[1], at[2]
    while parent != root and parent in best:
        parent, name = best[parent]
        way = f"{name}/{way}"
    return f"/{way}" if parent == root else f"{parent}/{way}"


ENTRIES = [("d", 50), ("e", 50), ("f1", 10), ("f2", 10), ("f3", 90), ("f4", 10), ("f5", None), ("g", 10), ("lone", 10), ("fresh_lone", 90)]
NAMES = [
    ("d", "0", "in", 90), ("e", "0", "out", 90), ("f1", "d", "a", 10), ("f2", "d", "b", 10), ("f2", "e", "b2", 10), ("f3", "d", "c", 10), ("f4", "e", "x", 10), ("f5", "d", "n", None), ("g", "d", "sub", 10), ("f1", "g", "deep", 10),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ENTRIES, "id string, md_update long"), spark.createDataFrame(NAMES, "id string, parent_id string, name string, path_update long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_partial_scan(tables):
    got = G.collect(*tables, 60, 1000, "0", "/in")
    # f2 has a name outside, f3 was seen elsewhere, f4 is outside; what has no name at all goes
    assert {(r["id"], r["path"], r["rm_time"]) for r in got.tombstones.collect()} == {("f1", "/in/a", 1000), ("f5", "/in/n", 1000), ("g", "/in/sub", 1000), ("lone", None, 1000)}
    assert rows(got.entries, "id") == [("d",), ("e",), ("f2",), ("f3",), ("f4",), ("fresh_lone",)]
    assert rows(got.names, "id", "name") == [("d", "in"), ("e", "out"), ("f2", "b2"), ("f4", "x")]
    assert got.names.columns == ["id", "parent_id", "name", "path_update"] and got.entries.columns == ["id", "md_update"]


def test_full_scan(tables):
    got = G.collect(*tables, 60, 1000, "0")
    assert {r["id"]: r["path"] for r in got.tombstones.collect()} == {"d": None, "e": None, "f1": "/in/a", "f2": "/in/b", "f4": "/out/x", "f5": "/in/n", "g": "/in/sub", "lone": None}
    assert rows(got.names, "id", "name") == [("d", "in"), ("e", "out")] and rows(got.entries, "id") == [("f3",), ("fresh_lone",)]


def test_the_scanned_directory_itself_stays(tables):
    names = tables[1].withColumn("path_update", F.lit(10).cast("long"))
    assert ("d", "in") in rows(G.collect(tables[0], names, 60, 1000, "0", "/in").names, "id", "name")


def test_tombstones_are_kept_once(spark):
    schema = "id string, size long, path string, rm_time long"
    known = spark.createDataFrame([("a", 1, None, 5), ("b", 2, "/b", 5)], schema)
    new = spark.createDataFrame([("a", 9, "/a", 8), ("b", 9, None, 8), ("c", 3, "/c", 8)], schema)
    assert rows(G.add_tombstones(known, new), "id", "size", "path", "rm_time") == [("a", 1, "/a", 5), ("b", 2, "/b", 5), ("c", 3, "/c", 8)]


def tree(n=120, seed=4):
    rng, out = random.Random(seed), []
    for i in range(1, n):
        out.append((str(i), str(rng.randrange(max(0, i - 12), i)), f"n{i}"))
    return out


@pytest.mark.parametrize(("n_moves", "filtered"), [(0, 100), (1, 100), (9, 100), (9, 3)])
def test_moves_equal_a_rebuild(spark, monkeypatch, n_moves, filtered):
    monkeypatch.setattr(M, "FILTERED", filtered)
    names, rng = tree(), random.Random(n_moves)
    moved = {}
    for i in rng.sample(range(2, 119), n_moves):  # to an older directory, so no ring comes about
        moved[str(i)] = (str(i), str(rng.randrange(0, i)), f"m{i}")
    later = [moved.get(r[0], r) for r in names]
    stored = N.all_paths(spark.createDataFrame(names, "id string, parent_id string, name string"), "0").select("id", "path")
    moves = spark.createDataFrame(list(moved.values()), "id string, parent_id string, name string")
    got = dict(map(tuple, M.after_moves(stored, moves, "0").collect()))
    assert got == {r[0]: path_of(later, r) for r in later}


def test_only_what_lies_below_is_joined(spark, tmp_path):
    names = tree()
    N.all_paths(spark.createDataFrame(names, "id string, parent_id string, name string"), "0").select("id", "path").write.parquet(str(tmp_path / "paths"))
    moves = spark.createDataFrame([("13", "0", "far")], "id string, parent_id string, name string")
    out = M.after_moves(spark.read.parquet(str(tmp_path / "paths")), moves, "0")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path" in plan and "Union" in plan


def test_progress_of_a_running_stream(spark, tmp_path):
    schema = "mdt string, type string, idx long, time long"
    log = V.ProgressLog()
    spark.streams.addListener(log)
    try:
        for k in range(3):
            spark.createDataFrame([("a", "CREATE", 10 * k + i, 100 * k + i) for i in range(k + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.queryName("reader").foreachBatch(lambda df, n: V.counted(df, n, str(tmp_path / "counts")))
            query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if len(log.kept) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert log.save(spark, str(tmp_path / "progress")) >= 3 and log.rows(spark).count() == 0
    progress, counts = spark.read.parquet(str(tmp_path / "progress")), spark.read.schema(V.COUNTS).parquet(str(tmp_path / "counts"))
    assert progress.filter("query = 'reader'").agg(F.sum("input_rows")).first()[0] == 6
    got = V.rates(counts, progress).orderBy("batch").collect()
    assert [(r["total"], r["gained"]) for r in got] == [(1, 1), (3, 2), (6, 3)] and got[0]["speed"] is None
    assert all(r["behind"] == r["at"] - t for r, t in zip(got, (0, 101, 202), strict=True))


def test_differences(spark):
    df = spark.createDataFrame([("a", "x", 0, 5), ("a", "x", 10, 25), ("b", "x", 10, 3)], "mdt string, type string, at long, total long")
    assert rows(V.differences(df), "mdt", "at", "gained", "speed") == [("a", 0, 5, None), ("a", 10, 20, 2.0), ("b", 10, 3, None)]
