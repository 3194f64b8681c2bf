"""Rules read from text: grammar, errors by line, exact conditions against plain Python, pre-filters."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inodelake.functions import criteria as C
from inodelake.functions import ruletext as T
from inodelake.functions.ruletext import And, Named, Not, Or, RuleError, Test
from inodelake.operators import policy as P
from inodelake.operators.ruleset import PolicyText, RuleSet

NOW = 1_000_000
CONTEXT = C.Context(now=NOW, root="/fs", statuses=("new", "synchro"), infos={"last_archive": C.Info("last_archive", "moment"), "tag": C.Info("tag", "text"), "copies": C.Info("copies", "number")})


def shape(node):
    """A condition as text with all parentheses."""
    if isinstance(node, Test):
        return f"{node.name}{node.op}{node.value}"
    if isinstance(node, Named):
        return node.name
    if isinstance(node, Not):
        return f"!{shape(node.of)}"
    return f"({shape(node.left)}{'&' if isinstance(node, And) else '|'}{shape(node.right)})"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("size > 1GB", "size>1GB"),
        ("a == 1 and b == 2 or c == 3", "(a==1&(b==2|c==3))"),
        ("a == 1 or b == 2 and c == 3", "(a==1|(b==2&c==3))"),
        ("(a == 1 or b == 2) and c == 3", "((a==1|b==2)&c==3)"),
        ("not a == 1 and b <> 2", "(!a==1&b!=2)"),
        ("NOT (a == 1 AND not b == 2)", "!(a==1&!b==2)"),
        ("name == \"a b\\\"c\" or name == '#x;'", "(name==a b\"c|name==#x;)"),
        ("path == /a/*/b // the rest\n and # more\n size>=10M", "(path==/a/*/b&size>=10M)"),
    ],
)
def test_conditions(text, want):
    assert shape(T.condition(text)) == want


@pytest.mark.parametrize(("text", "want"), [("a union b inter c", "(a|(b&c))"), ("not a union b", "!(a|b)"), ("(not a) union b", "(!a|b)"), ("a inter not b", "(a&!b)"), ("a", "a")])
def test_class_algebra(text, want):
    block = T.read(f"fileclass x {{ definition {{ {text} }} }}")[0]
    assert shape(block.blocks("definition")[0].node) == want


def test_settings_includes_and_variables():
    texts = {"one": "a { x = $V; %include \"two\" }", "two": "y = 5%(p, 'q r');"}
    block = T.read('%include "one"\nb {}', texts.__getitem__, {"V": "z"})
    assert [b.kind for b in block] == ["a", "b"] and block[0].setting("x") == "z"
    assert block[0].settings("y")[0].args == ("p", "q r") and block[0].settings("y")[0].value == "5%"
    with pytest.raises(RuleError, match="includes itself"):
        T.read('%include "loop"', lambda n: '%include "loop"')


@pytest.mark.parametrize(
    ("text", "line", "message"),
    [
        ("a {\n x = 1\n}", 3, "; expected"),
        ("a {\n\n x = 'y\n; }", 3, "closing quote"),
        ("fileclass f { definition {\n sise > 1 } }\ndefine_policy p { scope = all; }\np_rules { rule r { target_fileclass = f; condition = true; } }", 2, "unknown criterion"),
        ("fileclass f { definition { size > big } }", 1, "a size expected"),
        ("fileclass f { definition { name == 'a/b' } }", 1, "no slash"),
        ("fileclass f { definition { name > 'a' } }", 1, "== or != only"),
        ("fileclass f { definition { path == '/a/**b' } }", 1, "between slashes"),
        ("fileclass f { definition { rm_time > 1d } }", 1, "deleted entries"),
        ("fileclass f { definition { status == gone } }", 1, "unknown here"),
        ("fileclass f { definition { cmd(\"x\") } }", 1, "runs a command"),
        ("fileclass f { definition { a } }", 1, "unknown class a"),
        ("fileclass f { definition { size > 1 } }\nfileclass F { definition { size > 2 } }", 2, "defined twice"),
        ("x_rules { }", 1, "policy x is not defined"),
        ("define_policy p { scope = all; }\np_rules {\n rule r { condition = true; } }", 3, "targets no class"),
        ("define_policy p { scope = all; }\np_rules {\n rule r { target_fileclass = q; condition = true; } }", 3, "unknown class q"),
        ("fileclass q { definition { size > 1 } }\ndefine_policy p { scope = all; }\np_rules { ignore_fileclass = q;\n rule r { target_fileclass = q; condition = true; } }", 4, "already"),
        ("fileclass q { definition { size > 1 } }\ndefine_policy p { scope = all; }\np_rules { rule r { target_fileclass = q; condition = true; }\nrule s { target_fileclass = Q; condition = true; } }", 4, "already"),
        ("fileclass q { definition { size > 1 } }\ndefine_policy p { scope = all; }\np_rules { rule r { target_fileclass = q; condition = true; }\nrule R { target_fileclass = q; condition = true; } }", 4, "given twice"),
        ("define_policy p { scope = all; }\np_rules { rule default { target_fileclass = q; condition = true; } }", 2, "targets no class"),
        ("define_policy p { scope = all; }\np_trigger { trigger_on = user_usage;\n high_threshold_pct = 10%; low_threshold_vol = 1GB; check_interval = 1h; }", 2, "different kinds"),
        ("define_policy p { scope = all; }\np_trigger { trigger_on = periodic; }", 2, "check_interval is missing"),
        ("define_policy p { scope = all; }\np_parameters { lru_sort_attr = owner; }", 2, "can't order"),
    ],
)
def test_errors_name_their_line(text, line, message):
    with pytest.raises(RuleError, match=message) as e:
        rules = RuleSet.read(text)
        for c in rules.classes.values():
            _check(c.definition)
    assert e.value.line == line


def _check(node):
    """All tests of a condition, as compiling it would."""
    if isinstance(node, Test):
        C.checked(node, CONTEXT)
    for part in (node.left, node.right) if isinstance(node, And | Or) else (node.of,) if isinstance(node, Not) else ():
        _check(part)


def test_triggers_and_parameters():
    rules = RuleSet.read(
        "p_parameters { lru_sort_attr = last_archive(desc); max_action_count = 10; max_action_volume = 1TB; action_params { level = 2; } }\n"
        "p_trigger { trigger_on = pool_usage(p1, p2); high_threshold_pct = 85.5%; low_threshold_pct = 80%; check_interval = 15min; }\n"
        "p_trigger { trigger_on = periodic; check_interval = 1d; }",
        policies={"p": PolicyText("p", moments=("last_archive",))},
    )
    p = rules.policies["p"]
    assert p.order == ("-last_archive",) and (p.max_count, p.max_volume) == (10, 1 << 40) and p.params == {"level": "2"}
    assert [(t.watched, t.targets, t.unit, t.high, t.low, t.check_interval) for t in p.triggers] == [("pool_usage", ("p1", "p2"), "pct", 85.5, 80.0, 900), ("periodic", (), None, None, None, 86400)]


def _rows():
    rng = random.Random(7)
    pick = rng.choice
    out = []
    for i in range(400):
        path, kind = pick([("/fs/a/x.log", "file"), ("/fs/a", "dir"), ("/fs/b/c/y", "file"), ("/fs/b/c/Y.LOG", "symlink"), ("/fs", "dir")])
        out.append((i, path, path.rsplit("/", 1)[1], pick([kind, kind, None]), pick(["root", "u1", None, "u22"]), pick([0, 5000, None, 2_000_000, 1 << 31]), pick([NOW - 10, NOW - 100_000, None, NOW - 3600]), pick(["new", None, "synchro", ""]), pick(["p1", None, "q"]),
                    pick([["a"], None, ["b", "ab"], []]), pick([[1, 2], [], None]), pick([NOW - 100, 0, None]), pick(["t1", None, ""]), pick([1, None, 3]), pick([0, 4, None])))
    return out


SCHEMA = "id int, path string, name string, type string, uid string, size long, last_mod long, status string, ost_pool string, fileclass array<string>, osts array<int>, last_archive long, tag string, copies int, dircount int"
TESTS = (
    "size > 4KB", "size == 0", "last_mod > 1h", "last_mod <= 1h", "type == file", "type != directory", "owner == root", "owner != 'u*'", "owner == 'u?'", "name == '*.log'", "iname == '*.LOG'", "path == 'a/*'", "tree == /fs/b", "tree != 'b'",
    "tree == '**/c'", "status == new", "status != synchro", "status == ''", "ost_pool == 'p*'", "ost_pool != q", "fileclass == 'a*'", "fileclass != b", "ost_index == 2", "ost_index != 1", "dircount == 0", "dircount > 2", "last_archive == 0",
    "last_archive != 0", "last_archive > 10s", "tag == ''", "tag != t1", "copies >= 2", "copies != 1",
)


def _random_condition(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(TESTS)
    a, b = (_random_condition(rng, depth - 1) for _ in range(2))
    return rng.choice([f"({a}) and ({b})", f"({a}) or ({b})", f"not ({a})", f"not ({a} and {b})"])


def _value(node, values):
    """The condition's value from the values of its tests, left to right."""
    if isinstance(node, Test):
        return values[f"{node.name}{node.op}{node.value}"]
    if isinstance(node, Not):
        v = _value(node.of, values)
        return None if v is None else not v
    left = _value(node.left, values)
    if left is None or left == isinstance(node, Or):
        return left
    return _value(node.right, values)


def test_conditions_and_prefilters_over_rows(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    rng = random.Random(3)
    nodes = [T.condition(_random_condition(rng, 3)) for _ in range(120)]
    tests = [T.condition(t) for t in TESTS]
    weak = [C.prefilter(n, CONTEXT) for n in [*tests, *nodes]]
    assert sum(w is not None for w in weak) > 40
    columns = [C.compiled(n, CONTEXT).alias(f"c{i}") for i, n in enumerate([*tests, *nodes])]
    columns += [F.coalesce(w, F.lit(False)).alias(f"w{i}") for i, w in enumerate(weak) if w is not None]
    for row in df.select(*columns).collect():
        values = {shape(n): row[f"c{i}"] for i, n in enumerate(tests)}
        for i, n in enumerate(nodes):
            assert row[f"c{len(tests) + i}"] == _value(n, values), shape(n)
        for i, (n, w) in enumerate(zip([*tests, *nodes], weak, strict=True)):
            assert w is None or row[f"w{i}"] or not row[f"c{i}"], shape(n)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tree == /fs/b", {2: True, 4: False, 0: False}), ("path == 'a/*'", {0: True, 1: False}), ("iname == '*.LOG'", {0: True, 3: True, 2: False}), ("status == ''", {1: True, 0: False}), ("size > 4KB", {0: None, 1: True}),
        ("dircount != 7", {1: True, 0: False}), ("ost_pool == p1", {0: True, 1: False, 2: None}), ("fileclass != a", {0: False, 1: True}), ("last_archive == 0", {0: True, 1: False}), ("last_archive > 10s", {0: False, 1: True}), ("tag == ''", {0: True}),
    ],
)
def test_single_tests(spark, text, want):
    rows = [
        (0, "/fs/a/x.log", "x.log", "file", "root", None, 0, "new", "p1", ["a"], [1], None, None, 1, None), (1, "/fs/a", "a", "dir", "root", 5000, 0, None, None, None, [], NOW - 11, "t", 1, 3),
        (2, "/fs/b/c/y", "y", "file", "x", 1, 0, "new", None, [], None, 5, "t", 1, None), (3, "/fs/b/Y.LOG", "Y.LOG", "symlink", "x", 1, 0, "new", "q", [], None, 5, "t", 1, None), (4, "/fs/bb", "bb", "file", "x", 1, 0, "new", "q", [], None, 5, "t", 1, None),
    ]
    got = {r["id"]: r["v"] for r in spark.createDataFrame(rows, SCHEMA).select("id", C.compiled(T.condition(text), CONTEXT).alias("v")).collect()}
    assert {k: got[k] for k in want} == want


RULES = """
define_policy p { scope { type == file } }
FileClass logs { definition { iname == '*.log' } }
FileClass old { definition { last_mod > 1h } }
FileClass old_logs { definition { logs inter old } }
p_rules {
  ignore { owner == root and size == 0 }
  ignore_fileclass = old_logs;
  rule big { target_fileclass = logs; condition { size > 4KB } }
  rule default { condition { last_mod > 1d and status != synchro } }
}
"""


def test_prefilter_reaches_the_scan_and_changes_no_row(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).withColumn("invalid", F.lit(False)).write.parquet(str(tmp_path / "entries"))
    entries, rules = spark.read.parquet(str(tmp_path / "entries")), RuleSet.read(RULES)
    exact = P.candidates(entries, rules.policy("p", CONTEXT))
    fast = rules.candidates(entries, "p", CONTEXT)
    assert sorted(fast.select("id", "rule").collect()) == sorted(exact.select("id", "rule").collect()) != []
    plan = fast._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "EqualTo(type,file)" in pushed and "GreaterThan(size,4096)" in pushed and "LessThan(last_mod" in pushed


def test_only_stored_columns_are_pushed(spark):
    c = C.Context(now=NOW, stored=frozenset({"size"}))
    assert C.prefilter(T.condition("last_mod > 1h"), c) is None and C.prefilter(T.condition("last_mod > 1h and size > 1"), c) is not None
    assert C.prefilter(T.condition("last_mod > 1h or size > 1"), c) is None


def test_parameters_by_policy_trigger_rule_and_class(spark):
    rules = RuleSet.read(
        "define_policy p { scope = all; }\nFileClass big { definition { size > 4KB } p_action_params { level = 3; tag = '{fileclass}/{rule}'; } }\nFileClass logs { definition { name == '*.log' } }\n"
        "p_parameters { action_params { level = 0; by = policy; } }\np_trigger { trigger_on = periodic; check_interval = 1h; action_params { by = trigger; } }\n"
        "p_rules { rule r { target_fileclass = logs; target_fileclass = big; condition = true; action_params { level = 1; tag = x; } } rule default { condition = true; } }"
    )
    trigger = rules.policies["p"].triggers[0]
    df = spark.createDataFrame([(1, "a.log", 9000, "r"), (2, "b", 9000, "r"), (3, "c", 1, "default"), (4, "d", 1, None)], "id int, name string, size long, rule string")
    got = {r["id"]: (r["c"], r["m"]) for r in df.select("id", rules.target_class("p", CONTEXT).alias("c"), rules.parameters("p", CONTEXT, trigger).alias("m")).collect()}
    assert got == {
        1: ("logs", {"level": "1", "by": "trigger", "tag": "x"}), 2: ("big", {"level": "3", "by": "trigger", "tag": "big/r"}), 3: (None, {"level": "0", "by": "trigger"}), 4: (None, None),
    }
