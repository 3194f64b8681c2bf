"""Runs for many targets and reports that choose cube or entries, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inodelake.functions import criteria as C
from inodelake.functions import ruletext as T
from inodelake.operators import targets as G
from inodelake.operators.ruleset import RuleSet
from inodelake.plans import cube as K
from inodelake.plans import route as W
from inodelake.storage import materialize

CONTEXT = C.Context(now=1_000_000, statuses=("new", "synchro"))


def files(n=600, seed=1):
    rng = random.Random(seed)
    owners = ["hot"] * 5 + ["a", "b", "c", None]
    return [(str(i), rng.choice(owners), rng.choice(["g1", "g2"]), rng.choice(["file", "dir"]), rng.choice([0, 3, 7, 50, None]), rng.randrange(40), rng.choice(["new", None, "synchro"])) for i in range(n)]


SCHEMA = "id string, uid string, gid string, type string, blocks long, last_access long, status string"


def taken(rows, limits, key):
    """Rows by target in order while what was taken is below the limit."""
    out = set()
    for target, limit in limits.items():
        had = 0
        for r in sorted((r for r in rows if r[1] == target), key=key):
            if limit and had >= limit:
                break
            out.add(r[0])
            had += r[4] or 0
    return out


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_each_target_stops_at_its_own_limit(spark, parts):
    rows, limits = files(), {"hot": 900, "a": 1, "b": 10**9, "gone": 5, "c": None}
    df = spark.createDataFrame(rows, SCHEMA)
    limit = spark.createDataFrame(list(limits.items()), "target string, blocks long")
    got = G.until_limits(df, "uid", ["-last_access", "id"], ["blocks"], limit, parts)
    assert {r["id"] for r in got.collect()} == taken(rows, limits, lambda r: (-r[5], r[0]))
    assert got.columns == df.columns


def test_a_large_target_is_in_many_tasks(spark):
    df = spark.createDataFrame(files(4000), SCHEMA).filter("uid = 'hot'")
    sizes = [r["count"] for r in G._dealt(df, "uid", ["last_access", "id"], ["blocks"], 8).groupBy("range_no").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    rows = G.running_by_target(df, "uid", ["last_access", "id"], ["blocks"], 8)
    total = sum(r[4] or 0 for r in files(4000) if r[1] == "hot")
    last = rows.orderBy(F.desc("row.last_access"), F.desc("row.id")).first()
    assert last["before_blocks"] + (last["row"]["blocks"] or 0) == total


def test_empty_candidates_and_several_amounts(spark):
    df = spark.createDataFrame([], SCHEMA)
    limit = spark.createDataFrame([("a", 5, 2)], "target string, blocks long, one long")
    assert G.until_limits(df.withColumn("one", F.lit(1)), "uid", ["id"], ["blocks", "one"], limit).collect() == []
    some = spark.createDataFrame([(str(i), "a", "g", "file", 1, i, None) for i in range(9)], SCHEMA).withColumn("one", F.lit(1))
    assert G.until_limits(some, "uid", ["id"], ["blocks", "one"], limit).count() == 2


def test_an_entry_on_several_targets_is_taken_once_for_the_fullest(spark):
    usage = spark.createDataFrame([("o1", 90, 100), ("o2", 95, 100), ("o3", 10, 100), ("o4", 80, 100)], "target string, used long, total long")
    full = G.usage_targets(usage, 80, 70)
    assert [(r["target"], r["blocks"], r["rank"]) for r in full.orderBy("rank").collect()] == [("o2", 25, 1), ("o1", 20, 2), ("o4", 10, 3)]
    placed = spark.createDataFrame([("f", "o1"), ("f", "o2"), ("f", "o3"), ("g", "o3"), ("h", "o4"), ("h", "o1")], "id string, target string")
    assert sorted(map(tuple, G.once(placed, "id", full).collect())) == [("f", "o2"), ("h", "o1")]


def test_owner_targets(spark):
    df = spark.createDataFrame(files(), SCHEMA)
    value = lambda owner: sum(r[4] or 0 for r in files() if r[1] == owner)
    high = value("a")
    got = {r["target"]: (r["value"], r["blocks"], r["rank"]) for r in G.owner_targets(df.filter("uid is not null"), "uid", "blocks", high, high - 10).collect()}
    want = sorted((o for o in ("hot", "a", "b", "c") if value(o) > high), key=lambda o: -value(o))
    assert got == {o: (value(o), value(o) - high + 10, i + 1) for i, o in enumerate(want)} and "a" not in got  # strictly above
    listed = G.owner_targets(df, "uid", "count", 10, 5, ["b"], total=600)
    assert [(r["target"], r["count"]) for r in listed.collect()] == ([("b", sum(r[1] == "b" for r in files()) - 30)] if sum(r[1] == "b" for r in files()) > 60 else [])


def test_triggers_from_text(spark):
    rules = RuleSet.read("define_policy p { scope = all; default_lru_sort_attr = last_access; }\np_trigger { trigger_on = user_usage(hot); high_threshold_pct = 10%; low_threshold_pct = 5%; check_interval = 1h; }\np_trigger { trigger_on = periodic; check_interval = 1h; }")
    p, rows = rules.policies["p"], files()
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(r[4] or 0 for r in rows)
    limits = G.triggered(df, p.triggers[0], total=total)
    own = sum(r[4] or 0 for r in rows if r[1] == "hot")
    assert [(r["target"], r["blocks"]) for r in limits.collect()] == [("hot", own - int(total * 5 / 100))]
    plan = G.run_plan(df, p, limits, "uid", "blocks")
    assert {r["id"] for r in plan.collect()} == taken(rows, {"hot": own - int(total * 5 / 100)}, lambda r: (r[5], r[0]))
    with pytest.raises(ValueError, match="no targets"):
        G.triggered(df, p.triggers[1])


def entries(spark, rows=None):
    return spark.createDataFrame([(*r[:4], r[4] * 512 if r[4] is not None else None, r[4], r[6]) for r in (rows or files())], "id string, uid string, gid string, type string, size long, blocks long, status string")


REPORTS = [
    W.Report(("uid",), ("count", "sum_size", "avg_size", "profile"), T.condition("type == file")),
    W.Report(("gid", "status"), ("avg_blocks", "sum_blocks"), T.condition("not (owner == hot or status == new)"), (("sum_blocks", ">", 100),), ("-sum_blocks", "gid", "status"), 3),
    W.Report((), ("count", "avg_size")),
    W.Report((), ("count", "sum_size"), T.condition("owner == nobody")),
]


@pytest.mark.parametrize("report", REPORTS)
def test_cube_and_entries_agree_and_the_cube_is_enough(spark, report):
    e = entries(spark)
    cube = materialize(W.build(e))
    assert W.covered(report, CONTEXT, cube)
    routed, base = W.run(report, e, cube, CONTEXT), W.run(report, e, None, CONTEXT)
    ordered = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert ordered(routed) == ordered(base)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "known_size" in plan and "LogicalRDD" not in plan  # the cube's files, not the entries' rows


@pytest.mark.parametrize(
    "report",
    [
        W.Report(("uid",), ("min_size",)), W.Report(("uid",), ("distinct_gid",)), W.Report(("last_mod",), ("count",)), W.Report(("uid",), ("count",), T.condition("type == file and size > 1")),
        W.Report(("uid",), ("sum_nlink",)),
    ],
)
def test_what_the_cube_cannot_answer(spark, report):
    assert not W.covered(report, CONTEXT, W.build(entries(spark)))


def test_a_plain_cube_answers_no_average(spark):
    cube = K.build(entries(spark))
    assert not W.covered(W.Report(("uid",), ("avg_size",)), CONTEXT, cube)
    with pytest.raises(ValueError, match="unknown measure"):
        W.run(W.Report(("uid",), ("median_size",)), entries(spark), None, CONTEXT)
