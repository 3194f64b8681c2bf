"""Every registered query against its SQL, and the parts that SQL does not express against plain Python."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inodelake import registry
from inodelake.functions import expr as X
from inodelake.functions import scalar as S
from inodelake.operators import diff as D
from inodelake.operators import namespace as N
from inodelake.operators import policy as P
from inodelake.plans import cube as C
from inodelake.sources import catalog as K
from inodelake.sources import sinks as O
from inodelake.streaming import changelog as L

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert shown(got) == shown(want)


def plain_fold(kinds):
    """The same rules over a list of pending records, written out."""
    pending = []
    for i, k in enumerate(kinds):
        have = {kinds[j] for j in pending}
        data, meta = {"TRUNC", "CLOSE", "MTIME", "CREATE"}, {"CTIME", "SETATTR", "CREATE", "MKNOD", "MKDIR"}
        if k in ("TRUNC", "CLOSE") and have & data or k == "MTIME" and have & (data | {"MKNOD", "MKDIR"}) or k in ("CTIME", "SETATTR") and have & meta:
            continue
        last = kinds[pending[-1]] if pending else None
        if (k, last) in (("UNLINK", "CREATE"), ("UNLINK", "MKNOD"), ("RMDIR", "MKDIR")):
            pending.pop()
            continue
        pending.append(i)
    return pending


def test_fold_rules():
    assert L.fold(["MKDIR", "MTIME", "CLOSE"]) == [0, 2]
    assert L.fold(["CREATE", "UNLINK"]) == []
    assert L.fold(["CREATE", "SETATTR", "UNLINK"]) == []
    assert L.fold(["CREATE", "HLINK", "UNLINK"]) == [0, 1, 2]
    r = random.Random(1)
    kinds = "CREATE MKNOD MKDIR TRUNC CLOSE MTIME CTIME SETATTR UNLINK RMDIR HLINK".split()
    for _ in range(3000):
        some = [r.choice(kinds) for _ in range(r.randint(0, 9))]
        assert L.fold(some) == plain_fold(some)


def test_compaction(spark):
    got = {r["idx"] for r in registry.queries()["i02_compaction"](spark, SF).collect()}
    records = sorted(K.changelog(spark, SF).collect(), key=lambda r: r["idx"])
    want = set()
    for _, group in itertools.groupby(sorted(records, key=lambda r: (r["tfid"], r["idx"] // 1000, r["idx"])), key=lambda r: (r["tfid"], r["idx"] // 1000)):
        rows = list(group)
        want |= {rows[i]["idx"] for i in plain_fold([r["type"] for r in rows])}
    assert got == want


def test_compaction_with_a_sliding_queue(spark):
    rows = [(999, "CREATE", 1, "a"), (1001, "UNLINK", 1, "a"), (998, "CLOSE", 1, "b"), (1000, "CLOSE", 1, "b"), (997, "MARK", 1, "b"), (5, "CLOSE", 2, "b")]
    records = spark.createDataFrame(rows, "idx long, type string, mdt long, tfid string")
    assert {r["idx"] for r in L.compact(records).collect()} == {998, 5}
    records = K.changelog(spark, SF)
    queues, want = {}, set()
    for r in sorted(records.collect(), key=lambda r: r["idx"]):
        queue = queues.setdefault(r["mdt"], [])
        while len(queue) >= 20:
            want.add(queue.pop(0)["idx"])
        own = [q for q in queue if q["tfid"] == r["tfid"]]
        kept = plain_fold([q["type"] for q in own] + [r["type"]])
        if len(kept) < len(own):
            queue.remove(own[-1])
        elif len(kept) > len(own):
            queue.append(r)
    want |= {r["idx"] for queue in queues.values() for r in queue}
    assert {r["idx"] for r in L.compact(records, 20).collect()} == want


def test_deep_trees(spark):
    """A chain of 21 directories: no level is left out, and every path starts at the root."""
    names = spark.createDataFrame([(f"i{k}", f"i{k - 1}" if k else "top", f"n{k}") for k in range(21)], "id string, parent_id string, name string")
    levels = {r["id"]: r["level"] for r in N.subtree_ids(names, spark.createDataFrame([("i0",)], "id string")).collect()}
    assert levels == {f"i{k}": k for k in range(21)}
    paths = {r["id"]: r["path"] for r in N.all_paths(names, "top").collect()}
    assert paths == {f"i{k}": "/" + "/".join(f"n{j}" for j in range(k + 1)) for k in range(21)}


def test_stream_equals_batch(spark, tmp_path):
    records = K.changelog(spark, SF)
    records.filter("idx < 1000").write.parquet(str(tmp_path / "in"))
    source = L.stream(spark, str(tmp_path / "in"), records.schema, 100)
    L.apply_stream(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["idx"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["idx"] for r in L.compact(records.filter("idx < 1000")).collect()}


@pytest.mark.parametrize(("glob", "path", "yes", "no"), [
    ("a*b", False, ["ab", "a/b", "axxb"], ["abc", "ba"]),
    ("a?c", False, ["abc"], ["ac", "abbc"]),
    ("[!a]x.y", False, ["bx.y"], ["ax.y", "bxzy"]),
    ("/a/*/c", True, ["/a/b/c"], ["/a/b/b/c", "/a/c"]),
    ("/a/**/c", True, ["/a/b/c", "/a/b/b/c"], ["/b/c"]),
    (r"a\*", False, ["a*"], ["ab"]),
])
def test_globs(spark, glob, path, yes, no):
    rows = spark.createDataFrame([(s,) for s in yes + no], "s string")
    got = {r["s"] for r in rows.filter(X.like_glob(F.col("s"), glob, path=path)).collect()}
    assert got == set(yes)


def test_mixed_stars_are_refused():
    with pytest.raises(ValueError):
        X.glob_regex("/a/**/*.c", path=True)


def test_three_valued_tables(spark):
    values = [True, False, None]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    for r in rows.select("a", "b", X.or_(F.col("a"), F.col("b")).alias("o"), X.and_(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["o"] == (None if r["a"] is None else True if r["a"] else r["b"])
        assert r["n"] == (None if r["a"] is None else False if not r["a"] else r["b"])


def test_size_bounds(spark):
    sizes = [0, 1, 31, 32, 1023, 1024, 32767, 32768, *[(1 << k) + d for k in (20, 25, 30, 35, 40) for d in (-1, 0, 1)], 1 << 45]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", S.sz_range(F.col("size")).alias("r")).collect()
    for r in rows:
        assert r["r"] == (-1 if not r["size"] else (r["size"].bit_length() - 1) // 5)


def test_literals():
    assert X.parse_size("3M") == 3 << 20 and X.parse_size("10") == 10 and X.parse_duration("2h") == 7200 and X.parse_duration("1w") == 604800
    assert X.int_set("3,5-8") == [3, 5, 6, 7, 8] and X.time_modify(100, 0.5, 30) == 50 and X.time_modify(20, 0.5, 30) == 20
    assert P.effective_limit(0, 5, 3) == 3 and P.effective_limit(0, 0) == 0 and P.maintenance_factor(90, 100, 20) == 0.5


def test_cube_deltas_equal_a_rebuild(spark):
    old = K.entries(spark, SF)
    new = old.filter("num % 7 <> 0").withColumn("size", F.when(F.col("num") % 5 == 0, F.col("size") + 5).otherwise(F.col("size")))
    want, got = C.build(new), C.merge(C.build(old), C.deltas(old, new))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_diff_of_equal_snapshots_is_empty(spark):
    e = K.entries(spark, SF)
    assert D.diff(e, e, ["uid", "size", "status"]).isEmpty()


def test_rule_names_must_differ():
    with pytest.raises(ValueError):
        P.Policy("p", F.lit(True), [P.Rule("a", F.lit(True)), P.Rule("A", F.lit(True))])


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_limits_against_one_window(spark, parts):
    """Whatever the number of ranges and of extra columns, rows agree with one global window."""
    files = K.entries(spark, "/root/testdata/sf0.01").filter("type = 'file'")
    w = Window.orderBy("last_access", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r["id"] for r in files.withColumn("b", F.coalesce(F.sum("size").over(w), F.lit(0))).filter("b < 3000000000000000").select("id").collect()}
    for columns in (["id", "size", "last_access"], files.columns):
        got = [r["id"] for r in P.until_limit(files.select(*columns), ["last_access", "id"], {"size": 3_000_000_000_000_000}, parts).collect()]
        assert 500 < len(got) == len(want) and set(got) == want


def test_durations_are_strict():
    assert X.parse_duration("2 hours") == 7200 and X.parse_duration("3min") == 180 and X.parse_duration("1 year") == 31536000 and X.parse_duration("5") == 5
    for wrong in ("3months", "2x", "1 fortnight", ""):
        with pytest.raises(ValueError):
            X.parse_duration(wrong)


def test_recovery_ends_only_when_all_is_done(spark):
    table = spark.createDataFrame([("a", 1, "todo"), ("b", 2, "todo")], "id string, size long, recov_state string")
    with pytest.raises(ValueError):
        D.complete_recovery(D.set_recovery_state(table, spark.createDataFrame([("a", True)], "id string, ok boolean")))
    D.complete_recovery(D.set_recovery_state(table, spark.createDataFrame([("a", True), ("b", False)], "id string, ok boolean")))


@pytest.mark.parametrize(("count", "volume", "most"), [(3, 100, 0), (0, 50, 2), (4, 0, 1), (2, 30, 4)])
def test_token_plan_against_a_clock(spark, count, volume, most):
    """One period after the other, trying the next action until the bucket refuses it."""
    draw = random.Random(count + most)
    rows = [(p, i, draw.choice([0, 5, 20, 90, 400, None])) for p in ("a", "b") for i in range(60)]
    want = {}
    for policy in ("a", "b"):
        queue = [r for r in rows if r[0] == policy]
        period, tokens, left, patience = 0, count, volume, most
        while queue:
            forced = False
            if period:
                tokens, left, forced = count, min(left + volume, volume), bool(most) and patience <= 0
            while queue:
                short = count and tokens <= 0 or volume and left <= 0
                if short and not forced:
                    patience -= 1
                    break
                _, number, own = queue.pop(0)
                want[policy, number] = (period, bool(short))
                tokens, left, patience, forced = tokens - 1, left - (own or 0), most, False
            period += 1
    plan = P.token_plan(spark.createDataFrame(rows, "policy string, n int, size bigint"), "policy", ["n"], count, volume, most)
    assert {(r.policy, r.n): (r.period, r.forced) for r in plan.collect()} == want


def test_class_sets_are_checked():
    P.check_classes(["a", "b"], [("one", ["a"])], ["b"])
    for rules, ignored in ([("one", ["c"])], []), ([("one", ["a"]), ("two", ["A"])], []), ([("one", ["a"])], ["a"]):
        with pytest.raises(ValueError, match="class"):
            P.check_classes(["a", "b"], rules, ignored)


def test_variables_are_replaced_and_removed(spark, tmp_path):
    for values in {"a": "1", "b": "2"}, {"a": "3"}, {"b": None, "c": "4"}:
        O.put_variables(spark, f"{tmp_path}/vars", values)
    assert {r.name: r.value for r in O.variables(spark, f"{tmp_path}/vars").collect()} == {"a": "3", "c": "4"}


def test_maintenance_window():
    assert [P.maintenance_factor(n, 100, 40) for n in (59, 60, 80, 100, 101)] == [1.0, 1.0, 0.5, 0.0, 1.0]
    assert P.maintenance_factor(5, 0, 40) == P.maintenance_factor(5, 9, 0) == 1.0


def test_placeholders(spark):
    row = spark.createDataFrame([("n1", None)], "name string, pool string")
    shown_ = row.select(S.placeholders("mv {name} /p{pool}/x", {"name": F.col("name"), "pool": F.col("pool")})).first()[0]
    assert shown_ == "mv n1 /p/x"
    with pytest.raises(ValueError):
        S.placeholders("{nothing}", {"name": F.col("name")})


def test_outcomes(spark):
    planned = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "id string, size long")
    fresh = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "id string, size long")
    assert {r["id"]: r["outcome"] for r in P.outcome(planned, fresh).collect()} == {"a": "ok", "b": "accessed", "c": "ok", "d": "gone"}


def test_printed_directives(spark):
    row = spark.createDataFrame([(None, 7)], "a string, n long")
    got = row.select(S.printed(r"%a|%5n|%-3n|%03n|%T{%s}\101\\%%", {"a": F.col("a"), "n": F.col("n"), "T": F.lit(None).cast("long")}).alias("x")).first()["x"]
    assert got == "|    7|7  |007|A\\%"
    for bad in ("%q", "100%", r"\q", "%T{%q}"):
        with pytest.raises(ValueError, match="unknown"):
            S.printed(bad, {"T": F.col("n")})
