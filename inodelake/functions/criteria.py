"""Conditions read from text, as Columns: the exact three-valued form, and a weaker one that reaches the scan.

``compiled`` gives the exact condition. ``prefilter`` gives one that is true wherever the exact one matches (it may be true
elsewhere), made only of comparisons, prefixes and null tests of plain columns, which Spark pushes into the scan; None where
there is no such condition.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr as X
from .ruletext import And, Constant, Named, Node, Not, Or, RuleError, Test

_WILD = re.compile(r"[*?\[\]]")
_NEGATED = {"==": "!=", "!=": "==", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}

# Criteria by the kind of their values, names of entry types, and words for booleans.
TEXTS = ("path", "tree", "name", "iname", "owner", "group", "fileclass", "ost_pool", "status")
NUMBERS = ("projid", "depth", "dircount", "nlink", "ost_index")
AGES = ("last_access", "last_mod", "last_mdchange", "creation", "rm_time")
TYPES = {"file": "file", "directory": "dir", "dir": "dir", "symlink": "symlink", "chr": "chr", "blk": "blk", "fifo": "fifo", "sock": "sock"}
BOOLEANS = {"0": False, "1": True, "false": False, "true": True, "no": False, "yes": True, "disabled": False, "enabled": True}


@dataclass(frozen=True)
class Info:
    """An attribute of a policy's own: its column and kind (text, number, size, boolean, moment)."""

    column: str
    kind: str


@dataclass(frozen=True)
class Context:
    """Where criteria are found. ``columns`` overrides the names of columns, ``stored`` are those that the scan itself has
    (all of them if None), ``root`` is the directory that relative paths are under, ``modify`` (factor, least) shortens
    durations before a maintenance, ``deleted`` allows rm_time, and ``infos`` are a policy's own attributes."""

    now: int
    columns: Mapping[str, str] = field(default_factory=dict)
    root: str = "/"
    numeric_ids: bool = False
    statuses: tuple[str, ...] | None = None
    deleted: bool = False
    modify: tuple[float, float] = (1.0, 0.0)
    infos: Mapping[str, Info] = field(default_factory=dict)
    stored: frozenset[str] | None = None

    def name(self, criterion: str) -> str:
        usual = {"tree": "path", "iname": "name", "owner": "uid", "group": "gid", "creation": "creation_time", "ost_index": "osts"}
        return self.columns.get(criterion, usual.get(criterion, criterion))

    def at(self, criterion: str) -> Column:
        return F.col(self.name(criterion))

    def has(self, criterion: str) -> bool:
        return self.stored is None or self.name(criterion) in self.stored

    def age(self, text: str) -> float:
        return X.time_modify(X.parse_duration(text), *self.modify)


def _literal(t: Test, parse, what: str):
    try:
        return parse(t.value)
    except (KeyError, ValueError):
        raise RuleError(t.line, f"{t.name}: {what} expected, not {t.value!r}") from None


def _number(text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise ValueError(text)
    return int(text)


def _only_equal(t: Test) -> None:
    if t.op not in ("==", "!="):
        raise RuleError(t.line, f"{t.name} is compared by == or != only")


def _signed(found: Column, op: str) -> Column:
    return ~found if op == "!=" else found


def checked(t: Test, c: Context) -> tuple[str, object]:
    """The criterion's lower-case name and its value; an error at its line if either makes no sense."""
    name = t.name.lower()
    if name.startswith("xattr."):
        _only_equal(t)
        return name, t.value
    if name in TEXTS:
        _only_equal(t)
        if name not in ("status", "ost_pool", "fileclass") and not t.value:
            raise RuleError(t.line, f"{t.name}: a text that isn't empty expected")
        if name in ("name", "iname", "fileclass") and "/" in t.value:
            raise RuleError(t.line, f"{t.name}: no slash expected")
        if name == "status":
            if _WILD.search(t.value):
                raise RuleError(t.line, "status takes no wildcard")
            if c.statuses is None or (t.value and t.value.lower() not in c.statuses):
                raise RuleError(t.line, f"status {t.value!r} is unknown here")
            return name, t.value.lower()
        if "**" in t.value and name not in ("path", "tree"):
            raise RuleError(t.line, f"{t.name}: ** not expected")
        if name in ("owner", "group") and c.numeric_ids:
            return name, _literal(t, _number, "a number")
        if name in ("path", "tree"):
            return name, _full_path(t, c)
        return name, t.value
    if name == "type":
        _only_equal(t)
        return name, _literal(t, lambda v: TYPES[v.lower()], "a type of entry")
    if name == "size":
        return name, _literal(t, X.parse_size, "a size")
    if name in NUMBERS:
        if name == "ost_index":
            _only_equal(t)
        return name, _literal(t, _number, "a number")
    if name in AGES:
        if name == "rm_time" and not c.deleted:
            raise RuleError(t.line, "rm_time is for deleted entries only")
        return name, int(_literal(t, c.age, "a duration"))
    if t.name in c.infos:
        kind = c.infos[t.name].kind
        parse = {"text": str, "number": _number, "size": X.parse_size, "boolean": lambda v: BOOLEANS[v.lower()], "moment": X.parse_duration}[kind]
        if kind in ("text", "boolean"):
            _only_equal(t)
        return t.name, _literal(t, parse, f"a {kind}")
    raise RuleError(t.line, f"unknown criterion {t.name}")


def _full_path(t: Test, c: Context) -> str:
    value = t.value.rstrip("/") or "/"
    if not (value.startswith("/") or ("**" in value and value.startswith("*"))):
        value = f"{c.root.rstrip('/')}/{value}"
    try:
        X.glob_regex(value, path=True)
    except ValueError as e:
        raise RuleError(t.line, str(e)) from None
    return value


def _text(column: Column, value: str, ignore_case: bool = False) -> Column:
    if _WILD.search(value) or ignore_case:
        return X.like_glob(column, value, ignore_case)
    return column == value


def test(t: Test, c: Context) -> Column:
    """The exact Column of one test."""
    name, value = checked(t, c)
    if name.startswith("xattr."):
        return _signed(X.xattr(c.at("xattr"), t.name.split(".", 1)[1], t.value), t.op)
    if name == "tree":
        return _signed(X.in_tree(c.at(name), value), t.op)
    if name == "path":
        return _signed(X.like_glob(c.at(name), value, path=True), t.op)
    if name in ("name", "iname"):
        return _signed(_text(c.at(name), value, name == "iname"), t.op)
    if name in ("owner", "group"):
        return X.compare(c.at(name), t.op, value) if c.numeric_ids else _signed(_text(c.at(name), value), t.op)
    if name == "fileclass":
        return X.has_class(c.at(name), value, t.op == "!=")
    if name == "ost_pool":
        is_file = c.at("type") == "file"
        return F.when(is_file, _signed(_text(c.at(name), value), t.op)).when(~is_file, F.lit(False))
    if name == "ost_index":
        return X.ost_index(c.at(name), value, t.op == "!=")
    if name == "status":
        return _signed(X.status(c.at(name), value), t.op)
    if name == "dircount":
        return X.dircount(c.at("type"), c.at(name), t.op, value)
    if name in AGES:
        return X.age(c.at(name), t.op, value, c.now)
    if t.name in c.infos:
        return _info(c.infos[t.name], t.op, value, c.now)
    return X.compare(c.at(name), t.op, value)


def _info(info: Info, op: str, value, now: int) -> Column:
    column = F.col(info.column)
    if info.kind == "moment":
        return X.duration_info(column, op, value, now)
    if info.kind == "text":
        return _signed(_text(F.coalesce(column, F.lit("")), value), op)
    return X.compare(column, op, value)


def compiled(node: Node, c: Context, classes: Mapping[str, Node] | None = None) -> Column:
    """The exact condition: true where it matches, null where an attribute that it came to is unknown."""
    if isinstance(node, Constant):
        return F.lit(node.value)
    if isinstance(node, Named):
        return compiled(_class(node, classes), c, classes)
    if isinstance(node, Not):
        return ~compiled(node.of, c, classes)
    if isinstance(node, Test):
        return test(node, c)
    return (X.and_ if isinstance(node, And) else X.or_)(compiled(node.left, c, classes), compiled(node.right, c, classes))


def _class(node: Named, classes: Mapping[str, Node] | None) -> Node:
    found = (classes or {}).get(node.name.lower())
    if found is None:
        raise RuleError(node.line, f"unknown class {node.name}")
    return found


def prefilter(node: Node, c: Context, classes: Mapping[str, Node] | None = None, negated: bool = False) -> Column | None:
    """What must hold of the scan's own columns wherever the condition (or, ``negated``, its contrary) matches.

    A match of ``a and b`` needs both, one of ``a or b`` either; the contrary of the one is the other of the contraries. A
    test of an unknown attribute matches neither way, as a comparison with null selects no row; where unknown counts as
    a value (status, texts and moments of a policy's own), null is let through. What can't be pushed bounds nothing."""
    if isinstance(node, Constant):
        return F.lit(node.value != negated)
    if isinstance(node, Named):
        return prefilter(_class(node, classes), c, classes, negated)
    if isinstance(node, Not):
        return prefilter(node.of, c, classes, not negated)
    if isinstance(node, Test):
        if negated and node.name.lower() in ("dircount", "ost_pool"):  # no entry of another type matches, so all of them match the contrary
            return None
        return _pushed(Test(node.name, _NEGATED[node.op] if negated else node.op, node.value, node.line), c)
    sides = [prefilter(n, c, classes, negated) for n in (node.left, node.right)]
    if isinstance(node, And) != negated:
        return both(*sides)
    return None if any(s is None for s in sides) else sides[0] | sides[1]


def both(*parts: Column | None) -> Column | None:
    """All of the parts that bound something."""
    some = [p for p in parts if p is not None]
    return X.all_of(some[0], *some[1:]) if some else None


def _starts(column: Column, value: str) -> Column | None:
    """The fixed start of a pattern, as a prefix."""
    if "\\" in value:
        return None
    fixed = _WILD.split(value)[0]
    return column.startswith(fixed) if fixed else None


def _pushed(t: Test, c: Context) -> Column | None:
    name, value = checked(t, c)
    if t.name in c.infos:
        info = c.infos[t.name]
        column = F.col(info.column)
        if c.stored is not None and info.column not in c.stored:
            return None
        if info.kind in ("number", "size", "boolean"):
            return X.compare(column, t.op, value)
        return None
    if name.startswith("xattr.") or not c.has(name):
        return None
    column = c.at(name)
    if name in ("size", "projid", "depth", "nlink", "type"):
        return X.compare(column, t.op, value)
    if name == "dircount":
        return X.compare(column, t.op, value)
    if name in AGES:
        return X.age(column, t.op, value, c.now)
    if name == "status":
        plain = X.compare(column, t.op, value)
        return plain | column.isNull() if (t.op == "==") == (value == "") else plain
    if name in ("owner", "group", "name", "ost_pool", "path"):
        if isinstance(value, int) or not _WILD.search(value):
            return X.compare(column, t.op, value) if isinstance(value, int) or "\\" not in value else None
        return _starts(column, value) if t.op == "==" else None
    if name == "tree" and t.op == "==":
        return _starts(column, value)
    return None
