"""Policies read from text: classes, scopes, ignore conditions, rules, parameters and triggers, ready to run.

``RuleSet.read`` checks what can be checked without data and names the line of what is wrong: names that repeat, unknown
classes, a class that two rules target or that is ignored too, thresholds that don't fit. Its policies are compiled
against a ``Context``; ``candidates`` puts the weaker form of all conditions before the exact one, so that the scan
reads less.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..functions import expr as X
from ..functions.criteria import BOOLEANS, Context
from ..functions.ruletext import And, Block, Constant, Named, Node, Not, Or, RuleError, Setting, read
from . import policy as P

# What a trigger watches, by its name in the text, and the attributes that order a run.
WATCHED = ("global_usage", "ost_usage", "pool_usage", "user_usage", "group_usage", "user_count", "group_count", "periodic", "scheduled", "scheduler")
ORDERS = ("none", "creation", "last_access", "last_mod", "last_mdchange", "rm_time", "size")
UNITS = ("pct", "vol", "cnt", "cntpct")


@dataclass(frozen=True)
class FileClass:
    name: str
    definition: Node
    reported: bool = True
    params: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    line: int = 0


@dataclass(frozen=True)
class RuleText:
    name: str
    condition: Node
    targets: tuple[str, ...] = ()
    action: str | None = None
    params: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Trigger:
    """``unit`` is pct, vol, cnt or cntpct; ``targets`` are the listed users, groups or pools (none: all)."""

    watched: str
    targets: tuple[str, ...]
    unit: str | None
    high: float | None
    low: float | None
    check_interval: int
    max_count: int = 0
    max_volume: int = 0
    params: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class PolicyText:
    name: str
    scope: Node = Constant(True)
    status_manager: str | None = None
    action: str | None = None
    order: tuple[str, ...] = ()
    ignore: tuple[Node, ...] = ()
    ignored: tuple[str, ...] = ()
    rules: tuple[RuleText, ...] = ()
    default: RuleText | None = None
    max_count: int = 0
    max_volume: int = 0
    params: Mapping[str, str] = field(default_factory=dict)
    triggers: tuple[Trigger, ...] = ()
    moments: tuple[str, ...] = ()  # attributes of its own that may order a run


def _parsed(s: Setting | None, parse: Callable, what: str, default=0):
    if s is None:
        return default
    try:
        return parse(s.value)
    except (KeyError, ValueError):
        raise RuleError(s.line, f"{s.name}: {what} expected, not {s.value!r}") from None


def _one(b: Block, name: str) -> Setting | None:
    b.setting(name)
    return next(iter(b.settings(name)), None)


def _params(b: Block) -> dict[str, str]:
    out: dict[str, str] = {}
    for s in b.items:
        if not isinstance(s, Setting):
            raise RuleError(s.line, f"{b.kind} holds settings only")
        out[s.name] = s.value
    return out


def _order(s: Setting | None, moments: tuple[str, ...] = ()) -> tuple[str, ...]:
    if s is None or s.value.lower() == "none":
        return ()
    if s.value.lower() not in (*ORDERS, *moments):
        raise RuleError(s.line, f"{s.name}: can't order by {s.value!r}")
    if len(s.args) > 1 or (s.args and s.args[0].lower() not in ("asc", "desc")):
        raise RuleError(s.line, f"{s.name}: asc or desc expected")
    column = "creation_time" if s.value.lower() == "creation" else s.value.lower()
    return (f"-{column}" if s.args and s.args[0].lower() == "desc" else column,)


def _node(b: Block, name: str) -> Node:
    if b.node is None:
        raise RuleError(b.line, f"{name} is empty" if not b.items else f"a condition expected in {name}")
    return b.node


def _only(b: Block, name: str) -> Node | None:
    """The condition of the one block ``name``, or the constant of a setting of that name."""
    found = b.blocks(name)
    constant = _one(b, name)
    if len(found) + (constant is not None) > 1:
        raise RuleError(found[-1].line, f"{name} is given twice in {b.kind} {b.name or ''}".rstrip())
    if found:
        return _node(found[0], name)
    if constant is None:
        return None
    if constant.value.lower() not in ("true", "all"):
        raise RuleError(constant.line, f"{name} = true, or a block, expected")
    return Constant(True)


def _class(b: Block) -> FileClass:
    if not b.name:
        raise RuleError(b.line, "a fileclass needs a name")
    if "+" in b.name:
        raise RuleError(b.line, f"class {b.name}: no + expected in a name")
    definition = _only(b, "definition")
    if definition is None:
        raise RuleError(b.line, f"class {b.name} has no definition")
    report = _parsed(_one(b, "report"), lambda v: BOOLEANS[v.lower()], "yes or no", True)
    params = {x.kind.lower().removesuffix("_action_params").removesuffix("_hints"): _params(x) for x in b.items if isinstance(x, Block) and x.kind.lower().endswith(("_action_params", "_hints"))}
    return FileClass(b.name, definition, report, params, b.line)


def _rule(b: Block) -> RuleText:
    if not b.name:
        raise RuleError(b.line, "a rule needs a name")
    condition = _only(b, "condition")
    targets = b.settings("target_fileclass")
    is_default = b.name.lower() == "default"
    if is_default and targets:
        raise RuleError(targets[0].line, "the default rule targets no class")
    if not is_default and not targets:
        raise RuleError(b.line, f"rule {b.name} targets no class")
    if condition is None:
        raise RuleError(b.line, f"rule {b.name} has no condition")
    params: dict[str, str] = {}
    for x in b.items:
        if isinstance(x, Block) and x.kind.lower().endswith(("action_params", "hints")):
            params |= _params(x)
        elif isinstance(x, Block) and x.kind.lower() != "condition":
            raise RuleError(x.line, f"{x.kind} isn't expected in rule {b.name}")
    return RuleText(b.name, condition, tuple(t.value for t in targets), b.setting("action"), params)


def _trigger(b: Block) -> Trigger:
    on = _one(b, "trigger_on")
    if on is None:
        raise RuleError(b.line, "trigger_on is missing")
    watched = on.value.lower()
    if watched not in WATCHED:
        raise RuleError(on.line, f"trigger_on: {on.value!r} is unknown")
    limits = {}
    for side in ("high", "low"):
        found = [(u, _one(b, f"{side}_threshold_{u}")) for u in UNITS]
        found = [(u, s) for u, s in found if s]
        if watched in ("periodic", "scheduled", "scheduler"):
            if found:
                raise RuleError(found[0][1].line, f"a {watched} trigger has no threshold")
            continue
        if len(found) != 1:
            raise RuleError(b.line, f"one {side} threshold expected, not {len(found)}")
        unit, s = found[0]
        parse = {"pct": lambda v: float(v.rstrip("%")), "cntpct": lambda v: float(v.rstrip("%")), "vol": X.parse_size, "cnt": int}[unit]
        limits[side] = unit, _parsed(s, parse, "a threshold")
    if limits and limits["high"][0] != limits["low"][0]:
        raise RuleError(b.line, "the thresholds are of different kinds")
    if limits and limits["low"][1] > limits["high"][1]:
        raise RuleError(b.line, "the low threshold is above the high one")
    interval = _one(b, "check_interval")
    if interval is None:
        raise RuleError(b.line, "check_interval is missing")
    unit, high = limits.get("high", (None, None))
    return Trigger(
        watched, on.args, unit, high, limits["low"][1] if limits else None, _parsed(interval, X.parse_duration, "a duration"), _parsed(_one(b, "max_action_count"), int, "a number"),
        _parsed(_one(b, "max_action_volume"), X.parse_size, "a size"), {k: v for x in b.blocks("action_params") for k, v in _params(x).items()},
    )


@dataclass(frozen=True)
class RuleSet:
    classes: Mapping[str, FileClass]
    policies: Mapping[str, PolicyText]

    @staticmethod
    def read(text: str, include: Callable[[str], str] | None = None, variables: Mapping[str, str] | None = None, policies: Mapping[str, PolicyText] | None = None) -> RuleSet:
        """All that a text says of classes and policies. ``policies`` are known beforehand; others it declares itself."""
        blocks = read(text, include, variables)
        classes: dict[str, FileClass] = {}
        for b in blocks:
            if b.kind.lower() == "fileclass":
                c = _class(b)
                if c.name.lower() in classes:
                    raise RuleError(b.line, f"class {c.name} is defined twice")
                _known_classes(c.definition, classes, b.line)
                classes[c.name.lower()] = c
        found = dict(policies or {})
        for b in blocks:
            if b.kind.lower() == "define_policy":
                p = _declared(b)
                if p.name.lower() in found and p.name.lower() not in (policies or {}):
                    raise RuleError(b.line, f"policy {p.name} is defined twice")
                found[p.name.lower()] = p
        for b in blocks:
            name, _, part = b.kind.lower().rpartition("_")
            if part not in ("rules", "policies", "parameters", "trigger") or name not in found:
                if part in ("rules", "trigger"):
                    raise RuleError(b.line, f"policy {name} is not defined")
                continue
            p = found[name]
            if part == "trigger":
                found[name] = replace(p, triggers=(*p.triggers, _trigger(b)))
            elif part == "parameters":
                found[name] = replace(
                    p, order=_order(_one(b, "lru_sort_attr"), p.moments) if b.settings("lru_sort_attr") else p.order, max_count=_parsed(_one(b, "max_action_count"), int, "a number"),
                    max_volume=_parsed(_one(b, "max_action_volume"), X.parse_size, "a size"), params={**p.params, **{k: v for x in b.blocks("action_params") for k, v in _params(x).items()}},
                    action=b.setting("action", p.action),
                )
            else:
                found[name] = _with_rules(p, b, classes)
        return RuleSet(classes, found)

    def definitions(self) -> dict[str, Node]:
        return {name: c.definition for name, c in self.classes.items()}

    def class_columns(self, context: Context) -> dict[str, Column]:
        """The exact conditions of all reported classes, in order, as ``policy.classes`` takes them."""
        nodes = self.definitions()
        return {c.name: C.compiled(c.definition, context, nodes) for c in self.classes.values() if c.reported}

    def _targets(self, rule: RuleText) -> Node | None:
        out: Node | None = None
        for name in rule.targets:
            out = Named(name) if out is None else Or(out, Named(name))
        return out

    def policy(self, name: str, context: Context) -> P.Policy:
        """The exact policy, for ``policy.matching_rule`` and what rests on it."""
        p, nodes = self.policies[name.lower()], self.definitions()
        compiled = lambda node: C.compiled(node, context, nodes)

        def rule(r: RuleText) -> P.Rule:
            # a class that can't be evaluated is no match, so that the next one is tried
            hits = [X.matched(compiled(Named(t))) for t in r.targets]
            target = None
            for h in hits:
                target = h if target is None else target | h
            params = {**p.params, **r.params, **({"action": r.action} if r.action else {})}
            return P.Rule(r.name, compiled(r.condition), target, params)

        ignore = [*map(compiled, p.ignore), *[compiled(Named(n)) for n in p.ignored]]
        return P.Policy(p.name, compiled(p.scope), [rule(r) for r in p.rules], ignore, rule(p.default) if p.default else None)

    def target_class(self, name: str, context: Context, rule: str = "rule") -> Column:
        """The class by which the row's rule (a column) took the entry: the first of the rule's targets that it is in."""
        p, nodes = self.policies[name.lower()], self.definitions()
        out = F.lit(None).cast("string")
        for r in p.rules:
            own = F.lit(None).cast("string")
            for t in reversed(r.targets):
                own = F.when(X.matched(C.compiled(Named(t), context, nodes)), F.lit(self.classes[t.lower()].name)).otherwise(own)
            out = F.when(F.col(rule) == r.name, own).otherwise(out)
        return out

    def parameters(self, name: str, context: Context, trigger: Trigger | None = None, rule: str = "rule") -> Column:
        """The action's parameters of each row, as a map: the policy's, over them the trigger's, the rule's and those that
        the class has for the policy. ``{rule}`` and ``{fileclass}`` in a value stand for their names."""
        p = self.policies[name.lower()]
        chosen = self.target_class(name, context, rule)
        out = F.lit(None).cast("map<string,string>")
        for r in [*p.rules, *([p.default] if p.default else [])]:
            base = {**p.params, **(trigger.params if trigger else {}), **r.params}
            own = _map(base, r.name, None)
            for t in r.targets:
                c = self.classes[t.lower()]
                own = F.when(chosen == c.name, _map({**base, **c.params.get(p.name.lower(), {})}, r.name, c.name)).otherwise(own)
            out = F.when(F.col(rule) == r.name, own).otherwise(out)
        return out

    def prefilter(self, name: str, context: Context) -> Column | None:
        """What every entry that the policy acts on fulfils, in the scan's terms: its scope, no ignore condition, and
        a rule (a target class and its condition, or the default's condition)."""
        p, nodes = self.policies[name.lower()], self.definitions()
        weak = lambda node, negated=False: C.prefilter(node, context, nodes, negated)
        any_rule: Column | None = F.lit(False)
        for r in [*p.rules, *([p.default] if p.default else [])]:
            target = self._targets(r)
            own = C.both(weak(target) if target else None, weak(r.condition))
            any_rule = None if own is None or any_rule is None else any_rule | own
        kept = [weak(Not(node)) for node in (*p.ignore, *map(Named, p.ignored))]
        return C.both(weak(p.scope), any_rule, *kept)

    def candidates(self, entries: DataFrame, name: str, context: Context, target: Column | None = None) -> DataFrame:
        """Entries that the policy acts on, with their rule: what ``policy.candidates`` gives, but reading less."""
        weak = self.prefilter(name, context)
        return P.candidates(entries if weak is None else entries.filter(weak), self.policy(name, context), target)


def _map(values: Mapping[str, str], rule: str, fileclass: str | None) -> Column:
    """A map of fixed texts with their placeholders replaced."""
    own = {"rule": rule, "fileclass": fileclass or ""}
    cells = [F.lit(x) for k, v in values.items() for x in (k, re.sub(r"\{(rule|fileclass)\}", lambda m: own[m[1]], v))]
    return F.create_map(*cells).cast("map<string,string>")


def _known_classes(node: Node, classes: Mapping[str, FileClass], line: int) -> None:
    if isinstance(node, Named) and node.name.lower() not in classes:
        raise RuleError(node.line, f"unknown class {node.name}")
    for part in (node.left, node.right) if isinstance(node, And | Or) else (node.of,) if isinstance(node, Not) else ():
        _known_classes(part, classes, line)


def _declared(b: Block) -> PolicyText:
    if not b.name:
        raise RuleError(b.line, "a policy needs a name")
    scope = _only(b, "scope")
    if scope is None:
        raise RuleError(b.line, f"policy {b.name} has no scope")
    manager = b.setting("status_manager", "none")
    return PolicyText(b.name, scope, None if manager.lower() == "none" else manager, b.setting("default_action"), _order(_one(b, "default_lru_sort_attr")))


def _with_rules(p: PolicyText, b: Block, classes: Mapping[str, FileClass]) -> PolicyText:
    rules: list[RuleText] = []
    default = p.default
    owner: dict[str, str] = {}
    for s in b.settings("ignore_fileclass"):
        if s.value.lower() not in classes:
            raise RuleError(s.line, f"unknown class {s.value}")
        owner[s.value.lower()] = "ignore_fileclass"
    for x in b.blocks("rule", "policy"):
        r = _rule(x)
        if r.name.lower() in [o.name.lower() for o in [*rules, *([default] if default else [])]]:
            raise RuleError(x.line, f"rule {r.name} is given twice")
        for t in x.settings("target_fileclass"):
            name = t.value.lower()
            if name not in classes:
                raise RuleError(t.line, f"unknown class {t.value}")
            if name in owner:
                raise RuleError(t.line, f"class {t.value} is in {owner[name]} already")
            owner[name] = f"rule {r.name}"
        if r.name.lower() == "default":
            default = r
        else:
            rules.append(r)
    return replace(
        p, rules=(*p.rules, *rules), default=default, ignore=(*p.ignore, *[_node(x, "ignore") for x in b.blocks("ignore")]), ignored=(*p.ignored, *[s.value for s in b.settings("ignore_fileclass")]),
    )
