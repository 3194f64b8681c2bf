"""Find and du over roots, checks over time, stale actions, presets, filter blocks, reversed diffs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inodelake.functions import expr as X
from inodelake.operators import checks as H
from inodelake.operators import diff as D
from inodelake.operators import find as I

NAMES = [("d", "0", "d"), ("e", "0", "e"), ("s", "d", "sub"), ("f1", "d", "a"), ("f2", "s", "b"), ("f2", "e", "b_link"), ("f2", "s", "b_too"), ("t", "s", "deeper"), ("f3", "t", "c"), ("x", "0", "x")]
ENTRIES = [("d", "dir", "u1", 8, 4096), ("e", "dir", "u1", 8, 4096), ("s", "dir", "u2", 8, 4096), ("t", "dir", None, 8, 4096), ("f1", "file", "u1", 1, 100), ("f2", "file", "u2", 2, 900), ("f3", "file", "u1", 3, 1500), ("x", None, "u1", 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ENTRIES, "id string, type string, uid string, blocks long, size long"), spark.createDataFrame(NAMES, "id string, parent_id string, name string")


def found(df):
    return sorted((r["root"], r["path"], r["id"]) for r in df.collect())


def test_below_roots(tables):
    got = found(I.find(*tables, "0", ["/d/sub", "/e", "/nowhere", "/d/sub/none"]))
    assert got == [("/d/sub", p, i) for p, i in [("/d/sub", "s"), ("/d/sub/b", "f2"), ("/d/sub/b_too", "f2"), ("/d/sub/deeper", "t"), ("/d/sub/deeper/c", "f3")]] + [("/e", "/e", "e"), ("/e", "/e/b_link", "f2")]
    assert found(I.find(*tables, "0", ["/nowhere"])) == []
    assert I.resolve(tables[1], ["/d/sub/deeper", "/x", "/d/no"], "0") == {"/d/sub/deeper": "t", "/x": "x"}


def test_everything_at_the_file_systems_root(tables):
    everything = found(I.find(*tables, "0", ["/"], root_entry={"type": "dir"}))
    assert len(everything) == len(NAMES) + 1 and ("/", "/", "0") in everything
    assert [p for _, p, _ in found(I.find(*tables, "0", ["/"], F.col("size") < 1000, "no_dirs"))] == ["/d/a", "/d/sub/b", "/d/sub/b_too", "/e/b_link", "/x"]
    assert [p for _, p, _ in found(I.find(*tables, "0", kinds="dirs"))] == ["/d", "/d/sub", "/d/sub/deeper", "/e"]


def test_unknown_does_not_match(tables):
    assert "t" not in {i for *_, i in found(I.find(*tables, "0", ["/"], F.col("uid") != "u2"))}


def test_a_ring_ends(spark, tables):
    ring = spark.createDataFrame([("a", "0", "a"), ("b", "a", "b"), ("a", "b", "again")], "id string, parent_id string, name string")
    entries = spark.createDataFrame([("a", "dir", "u", 1, 1), ("b", "dir", "u", 1, 1)], tables[0].schema)
    assert [p for _, p, _ in found(I.find(entries, ring, "0", ["/a"]))] == ["/a", "/a/b", "/a/b/again"]


def test_du_counts_a_hard_link_once_for_each_root(tables):
    got = {(r["root"], r["type"]): (r["count"], r["blocks"], r["size"], r["used"]) for r in I.du(*tables, "0", ["/d", "/e"], F.col("type") == "file").collect()}
    assert got == {("/d", "file"): (3, 6, 2500, 3072), ("/e", "file"): (1, 2, 900, 1024)}
    assert tuple(I.du(*tables, "0", ["/d", "/e"], total=True).first()) == (3 + 3 + 1 + 1, 6 + 24 + 2 + 8, 2500 + 3 * 4096 + 900 + 4096, 40 * 512)


def test_checks(spark):
    state = spark.createDataFrame([("same", "ok", "h", 5, 5), ("changed", "ok", "h", 5, 5), ("error", "ok", "h", 5, 5), ("again", "failed", "h", 5, 2), ("kept", "failed", None, 5, None)], "id string, check_status string, output string, last_check long, last_success long")
    outputs = spark.createDataFrame([("same", "h"), ("changed", "g"), ("error", None), ("again", "h"), ("first", "x" * 300)], "id string, output string")
    got = {r["id"]: tuple(r)[1:] for r in H.check(outputs, state, 9).collect()}
    assert got == {
        "same": ("ok", "h", 9, 9, "same"), "changed": ("failed", "h", 9, 5, "changed"), "error": ("failed", "h", 9, 5, "error"), "again": ("ok", "h", 9, 9, "same"), "kept": ("failed", None, 5, None, None),
        "first": ("ok", "x" * 255, 9, 9, "first"),
    }


def test_stale_actions(spark):
    rows = [("old", "run", 10, False), ("never", "run", None, None), ("young", "run", 95, False), ("bad", "run", 10, True), ("other", "done", 10, False), ("lost", "run", 1, False), ("edge", "run", 90, False)]
    entries = spark.createDataFrame(rows, "id string, status string, md_update long, invalid boolean")
    fresh = spark.createDataFrame([("old", "done"), ("never", "run"), ("edge", None), ("young", "run")], "id string, status string")
    got = {r["id"]: r["state"] for r in H.stale_actions(entries, fresh, "run", 100, 10).collect()}
    assert got == {"old": "reset", "never": "running", "lost": "gone", "edge": "reset"}


def test_lifecycle(spark):
    rows = [("a", "file", "new", False, "u"), ("b", "file", "modified", None, "u"), ("c", "file", "new", False, "keep"), ("d", "file", "synchro", False, "keep"), ("e", "dir", "new", False, "u"), ("f", "file", "new", True, "u"), ("g", "file", None, False, "u")]
    entries = spark.createDataFrame(rows, "id string, type string, status string, invalid boolean, uid string")
    tombs = spark.createDataFrame([("t1", "file", 10), ("t2", "file", 96), ("t3", "dir", 1)], "id string, type string, rm_time long")
    assert sorted(map(tuple, H.lifecycle(entries, tombs, 100, 5, F.col("uid") == "keep").collect())) == [("a", "archive"), ("b", "archive"), ("d", "release"), ("t1", "remove")]


def test_filter_blocks(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 50, None), (4, 500, "a")], "id int, size long, tag string")
    ids = lambda f: [r["id"] for r in df.filter(f.column()).orderBy("id").collect()]
    assert ids(X.Filters()) == [1, 2, 3, 4]
    assert ids(X.Filters().add("size", ">", 10)) == [2, 3, 4]  # unknown numbers pass
    assert ids(X.Filters().add("tag", "==", "a", text=True)) == [1, 4] and ids(X.Filters().add("tag", "!=", "a", text=True)) == [2, 3]
    f = X.Filters().add("size", ">", 100)
    assert ids(f.replace("size", ">", 10).add_if_absent("size", "<", 60)) == [2, 3, 4] and ids(f.add_if_absent("id", "<", 4)) == [2, 3]
    g = X.Filters(any_of=True)
    g.block().add("size", ">", 100).add("tag", "==", "a", text=True)
    g.add("id", "==", 1).block(any_of=True)
    assert ids(g) == [1, 4]


def test_reversed_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, x string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "id string, x string")
    got = {(r["id"], r["op"], r["old"], r["new"]) for r in D.reversed_diff(D.diff(old, new, ["x"])).collect()}
    assert got == {("a", "++", None, None), ("c", "--", None, None), ("b", "-+", "2", "1")}
